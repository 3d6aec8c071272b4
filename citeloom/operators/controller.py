"""Query features and retrieval control: rules, supervision labels and a learned policy."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as tx

# Query feature patterns.
CAMEL = r"(?U)\b[a-zA-Z]*[a-z][A-Z][a-zA-Z0-9]*\b"
SNAKE = r"(?U)\b[a-zA-Z0-9]+_[a-zA-Z0-9_]+\b"
FLAG = r"(?:^|[\s])(?:--[a-zA-Z0-9_-]+|-[a-zA-Z0-9])(?:[\s]|$)"
DOTTED = r"(?U)\b[a-zA-Z_][a-zA-Z0-9_]*\.[a-zA-Z_][a-zA-Z0-9_.]*\b"
BACKTICKS = r"`[^`]+`"
COMPARISON = "vs|versus|compare|compared|comparison|difference|differ|differences|relative to"
TEMPORAL = "latest|current|deprecated|deprecate|version|v[0-9]+|newest|recent|recently|release"
MULTI_HOP = (
    "how to|step by step|prerequisites|prerequisite|relationship|depends on|integrate|pipeline|why"
)
CAPITALISED = r"(?U)\b[A-Z][a-z0-9]+\b"
GREETING = (
    r"(?i)^(?:(?:hi|hello|hey|good morning|good afternoon|good evening|thanks|thank you|howdy|greetings)"
    r"(?:\s+(?:there|everyone|all|friend|team))?[\s!.,]*)+$"
)
# Exact identifiers a reformulation must keep.
PROTECTED = (
    r"(?U)`[^`]+`|\"[^\"]+\"|--[\w-]+|(?:[A-Za-z]:)?/[\w./-]+|\b\w+[_.]\w[\w.]*|\b[A-Z][A-Z0-9_]{2,}\b"
)
REFORMULATION_SUFFIX = " documentation usage"
ACTIONS = ("stop", "direct_answer", "retrieve_sparse", "retrieve_dense", "retrieve_hybrid", "reformulate", "rerank", "abstain")
ROUTES = ("hybrid", "sparse", "dense")


def is_greeting(query: Column) -> Column:
    return tx.strip(query).rlike(GREETING)


def query_features(df: DataFrame, query: str = "query") -> DataFrame:
    """Add the nine feature columns of a query."""
    q = tx.strip(F.col(query))
    caps = F.regexp_extract_all(q, F.lit(CAPITALISED), F.lit(0))
    out = df.withColumn("_q", q).withColumn("_caps", caps)
    q = F.col("_q")
    leading = F.when((F.size("_caps") > 0) & F.startswith(q, F.get("_caps", F.lit(0))), 1).otherwise(0)
    marks = F.regexp_count(q, F.lit(r"\?"))
    out = out.withColumns({
        "token_count": tx.word_count(q),
        "question_count": marks,
        "has_code_terms": q.rlike(CAMEL) | q.rlike(SNAKE) | q.rlike(FLAG) | q.rlike(DOTTED) | q.rlike(BACKTICKS),
        "has_comparison_terms": q.rlike(tx.bounded(COMPARISON)),
        "has_temporal_terms": q.rlike(tx.bounded(TEMPORAL)),
        "has_multi_hop_terms": q.rlike(tx.bounded(MULTI_HOP)),
        "named_entity_count": F.greatest(F.lit(0), F.size("_caps") - leading),
    })
    out = out.withColumns({
        "estimated_subquestions": F.when(F.col("question_count") > 0, F.col("question_count")).when(F.col("has_comparison_terms"), 2).otherwise(1),
        "external_knowledge_probability": F.when(is_greeting(q), 0.05)
        .when(F.col("has_code_terms") | F.col("has_comparison_terms") | F.col("has_temporal_terms"), 0.95)
        .otherwise(0.80),
    })
    return out.drop("_q", "_caps")


def _decision(action: str, reason: Column | str, confidence: float, route: Column | str | None = None) -> Column:
    as_col = lambda v: F.lit(v) if isinstance(v, str) or v is None else v
    return F.struct(
        F.lit(action).alias("action") if isinstance(action, str) else action.alias("action"),
        as_col(route).cast("string").alias("route"),
        as_col(reason).alias("reason"),
        F.lit(confidence).cast("double").alias("confidence"),
    )


def untried_route(tried: Column) -> Column:
    """First of hybrid, sparse, dense that was not tried, or NULL."""
    return F.get(F.array_except(F.array(*[F.lit(r) for r in ROUTES]), tried), F.lit(0))


def rule_decision(
    *, calls: str = "retrieval_calls", rounds: str = "iteration_count", max_calls: str = "max_retrieval_calls",
    max_rounds: str = "max_iterations", status: str = "evidence_status", conflict: str = "conflict_score",
    route: str = "route", tried: str = "tried_routes", ready: str = "refinement_ready", cite: str = "require_citations",
) -> Column:
    """The six ordered rules as one struct ``(action, route, reason, confidence)`` over state columns.

    Feature columns come from :func:`query_features` on the active query.
    """
    at_calls, at_rounds = F.col(calls) >= F.col(max_calls), F.col(rounds) >= F.col(max_rounds)
    good = (F.col(status) == "sufficient") & (F.col(conflict) < 0.30)
    conflicted = (F.col(status) == "conflicting") | (F.col(conflict) >= 0.60)
    known = F.coalesce(F.col(tried), F.array().cast("array<string>"))
    every = F.array_union(known, F.when(F.col(route).isNotNull(), F.array(F.col(route))).otherwise(F.array().cast("array<string>")))
    other = untried_route(every)
    retrieve = lambda r: F.concat(F.lit("retrieve_"), r)
    return (
        F.when((at_calls | at_rounds) & good, _decision("stop", "stop_evidence_sufficient_at_budget", 0.85))
        .when(at_calls, _decision("abstain", "abstain_retrieval_budget_exhausted", 0.90))
        .when(at_rounds, _decision("abstain", "abstain_iteration_budget_exhausted", 0.90))
        .when(good, _decision("stop", "stop_evidence_sufficient", 0.95))
        .when(conflicted & other.isNotNull(), _decision(retrieve(other), F.concat(F.lit("route_conflict_alternate_"), other), 0.70, other))
        .when(conflicted, _decision("abstain", "abstain_conflicting_evidence_unresolvable", 0.85))
        .when(F.col(ready) & F.col(route).isNotNull() & (F.col(route) != "direct"), _decision(retrieve(F.col(route)), "route_refined_query", 1.0, F.col(route)))
        .when(F.col(calls) > F.col(rounds), _decision("reformulate", "reformulate_uncertain_evidence", 0.80))
        .when(~F.col(cite) & (F.col("external_knowledge_probability") < 0.20), _decision("direct_answer", "direct_answer_non_factual_greeting", 0.95, "direct"))
        .when(F.col("has_comparison_terms") | F.col("has_multi_hop_terms"), _decision("retrieve_hybrid", "route_hybrid_complex_query", 0.80, "hybrid"))
        .when(F.col("has_code_terms"), _decision("retrieve_sparse", "route_sparse_exact_identifier", 0.85, "sparse"))
        .otherwise(_decision("retrieve_dense", "route_dense_semantic_query", 0.80, "dense"))
    )


# ---------------------------------------------------------------- supervision


def best_action() -> Column:
    """The action a supervisor knowing the gold chunks would take, over sample and state columns:
    ``requires_abstention, sample_type, gold, retrieved, retrieval_calls, max_retrieval_calls,
    iteration_count, max_iterations, reformulated``."""
    missing = F.size(F.array_except("gold", "retrieved"))
    exhausted = (F.col("retrieval_calls") >= F.col("max_retrieval_calls")) | (F.col("iteration_count") >= F.col("max_iterations"))
    return (
        F.when(F.col("requires_abstention") | (F.col("sample_type") == "unanswerable"), _decision("abstain", "oracle_unanswerable_abstain", 1.0))
        .when((F.size("gold") > 0) & (missing == 0), _decision("stop", "oracle_gold_evidence_satisfied", 1.0))
        .when(exhausted & F.arrays_overlap("gold", "retrieved"), _decision("stop", "oracle_budget_partial_evidence_stop", 0.85))
        .when(exhausted, _decision("abstain", "oracle_budget_exhausted_abstain", 0.90))
        .when((F.col("retrieval_calls") == 0) & (F.col("sample_type") == "single_fact"), _decision("retrieve_sparse", "oracle_initial_single_fact_sparse", 0.95, "sparse"))
        .when((F.col("retrieval_calls") == 0) & F.col("sample_type").isin("multi_hop", "contrastive"), _decision("retrieve_hybrid", "oracle_initial_complex_hybrid", 0.95, "hybrid"))
        .when(F.col("retrieval_calls") == 0, _decision("retrieve_dense", "oracle_initial_dense", 0.90, "dense"))
        .when(~F.col("reformulated"), _decision("reformulate", "oracle_missing_gold_reformulate", 0.90))
        .otherwise(_decision("retrieve_hybrid", "oracle_subsequent_hybrid_fallback", 0.85, "hybrid"))
    )


def supervision_leaks(samples: DataFrame) -> DataFrame:
    """Samples outside the development split must never be labelled."""
    return samples.filter("split <> 'dev'").select(F.col("sample_id").cast("string").alias("entity_id"), F.lit("not_dev_split").alias("rule"))


FEATURE_NAMES = (
    "retrieval_calls", "iteration_count", "evidence_count", "conflict_score", "is_sufficient", "is_conflicting",
    "token_count", "has_code_terms", "has_multi_hop_terms", "has_comparison_terms",
)


def feature_vector() -> Column:
    """The ten numbers a decision is learned from."""
    flag = lambda c: c.cast("int").cast("double")
    return F.array(
        F.col("retrieval_calls").cast("double"), F.col("iteration_count").cast("double"), F.col("evidence_count").cast("double"),
        F.col("conflict_score").cast("double"), flag(F.col("evidence_status") == "sufficient"), flag(F.col("evidence_status") == "conflicting"),
        F.col("token_count").cast("double"), flag(F.col("has_code_terms")), flag(F.col("has_multi_hop_terms")), flag(F.col("has_comparison_terms")),
    )


def training_rows(samples: DataFrame) -> DataFrame:
    """Two or three decision points per development sample: start, gold found, attempts used up.

    ``samples``: ``sample_id, split, question, sample_type, requires_abstention, gold``.
    """
    none = F.array().cast("array<string>")

    def state(name: str, calls: int, rounds: int, status: str, got: Column, when: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(name).alias("state"), F.lit(calls).alias("retrieval_calls"), F.lit(rounds).alias("iteration_count"),
                F.lit(status).alias("evidence_status"), got.alias("retrieved"), F.size(got).alias("evidence_count"),
            ),
        )

    points = F.array(
        state("initial", 0, 0, "unknown", none, F.lit(True)),
        state("satisfied", 1, 1, "sufficient", F.col("gold"), ~F.col("requires_abstention") & (F.size("gold") > 0)),
        state("exhausted", 2, 2, "insufficient", none, F.col("requires_abstention")),
    )
    rows = query_features(samples.filter("split = 'dev'"), "question").select("*", F.explode(points).alias("s")).filter("s is not null")
    rows = rows.select("*", "s.*").drop("s").withColumns({
        "max_retrieval_calls": F.lit(3), "max_iterations": F.lit(3), "reformulated": F.lit(False), "conflict_score": F.lit(0.0),
    })
    return rows.select("sample_id", "state", feature_vector().alias("features"), best_action().alias("d")).select(
        "sample_id", "state", "features", F.col("d.action").alias("label"), F.col("d.reason").alias("reason")
    )


# ---------------------------------------------------------------- learned policy


def fit_policy(rows: DataFrame, *, balanced: bool = True, max_iter: int = 1000, reg: float = 1.0) -> DataFrame:
    """Multinomial logistic regression; returns the coefficients as ``(label, weights, intercept)``.

    Balanced weights are n / (classes * class size). The penalty is stated per row, so it is divided
    by the number of rows.
    """
    sizes = rows.groupBy("label").agg(F.count("*").alias("c"))
    total = sizes.agg(F.sum("c").alias("n"), F.count("*").alias("k")).head()
    weight = (F.lit(float(total.n)) / (F.lit(float(total.k)) * F.col("c"))) if balanced else F.lit(1.0)
    data = rows.join(sizes, "label").select(array_to_vector("features").alias("x"), "label", weight.alias("w"))
    indexer = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(data)
    model = LogisticRegression(
        featuresCol="x", labelCol="y", weightCol="w", family="multinomial", maxIter=max_iter,
        regParam=reg / max(1, total.n), standardization=False,
    ).fit(indexer.transform(data))
    # A handful of classes and ten features: the model is small by construction.
    matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    found = [(name, [float(v) for v in matrix[i]], float(bias[i])) for i, name in enumerate(indexer.labels)]
    return rows.sparkSession.createDataFrame(found, "label string, weights array<double>, intercept double")


def policy_problems(policy: DataFrame, *, allowed: tuple[str, ...] = ACTIONS, features: int = 10) -> DataFrame:
    """Checks before stored parameters are used: known unique labels, right size, finite values."""
    bad = F.exists("weights", lambda w: F.isnan(w) | (F.abs(w) == float("inf"))) | F.isnan("intercept") | (F.abs("intercept") == float("inf"))
    rule = (
        F.when(~F.col("label").isin(*allowed), "unknown_label")
        .when(F.size("weights") != features, "wrong_dimension")
        .when(bad, "non_finite_parameter")
    )
    single = policy.select(F.col("label").alias("entity_id"), rule.alias("rule")).filter("rule is not null")
    twice = policy.groupBy("label").count().filter("count > 1").select(F.col("label").alias("entity_id"), F.lit("duplicate_label").alias("rule"))
    return single.unionByName(twice)


def _checked(policy: DataFrame, features: int) -> DataFrame:
    broken = policy_problems(policy, features=features).limit(1).collect()
    if broken:
        raise ValueError(f"policy parameters are not usable: {broken[0].rule} for {broken[0].entity_id}")
    return policy


def save_policy(policy: DataFrame, path: str, *, features: int = 10) -> None:
    """Write checked parameters; an existing path is an error."""
    _checked(policy, features).write.mode("errorifexists").parquet(path)


def load_policy(spark: SparkSession, path: str, *, features: int = 10) -> DataFrame:
    """Read parameters and check them before use."""
    return _checked(spark.read.schema("label string, weights array<double>, intercept double").parquet(path), features)


def score_policy(rows: DataFrame, policy: DataFrame) -> DataFrame:
    """Add ``predicted`` and ``probability``. All classes sit in one small array on every row."""
    classes = policy.agg(F.array_sort(F.collect_list(F.struct("label", "weights", "intercept"))).alias("p")).scalar()
    logit = lambda c: c["intercept"] + F.aggregate(
        F.zip_with(c["weights"], F.col("features"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x
    )
    out = rows.withColumn("_p", classes)
    out = out.withColumn("_z", F.transform("_p", lambda c: F.struct(logit(c).alias("z"), c["label"].alias("label"))))
    peak = F.array_max(F.transform("_z", lambda z: z["z"]))
    out = out.withColumn("_m", peak)
    total = F.aggregate("_z", F.lit(0.0), lambda s, z: s + F.exp(z["z"] - F.col("_m")))
    first = F.get(F.filter("_z", lambda z: z["z"] == F.col("_m")), F.lit(0))
    return out.withColumn("predicted", first["label"]).withColumn("probability", F.lit(1.0) / total).drop("_p", "_z", "_m")


def learned_decision(*, threshold: float = 0.50) -> Column:
    """Learned action behind the budget guard, falling back to the rules when unsure.

    Needs the state and feature columns of :func:`rule_decision` and ``predicted, probability``
    (NULL when there is no usable model).
    """
    rule = rule_decision()
    spent = (F.col("retrieval_calls") >= F.col("max_retrieval_calls")) | (F.col("iteration_count") >= F.col("max_iterations"))
    good = (F.col("evidence_status") == "sufficient") & (F.col("conflict_score") < 0.30)
    fall = lambda prefix: F.struct(
        rule["action"].alias("action"), rule["route"].alias("route"), F.concat(F.lit(prefix), rule["reason"]).alias("reason"), rule["confidence"].alias("confidence")
    )
    route = F.when(F.col("predicted").startswith("retrieve_"), F.regexp_replace("predicted", "^retrieve_", ""))
    return (
        F.when(spent & good, _decision("stop", "learned_guardrail_budget_sufficient_stop", 0.90))
        .when(spent, _decision("abstain", "learned_guardrail_budget_exhausted_abstain", 0.95))
        .when(F.col("predicted").isNull(), fall("heuristic_fallback_"))
        .when(F.col("probability") < threshold, fall("heuristic_low_confidence_fallback_"))
        .otherwise(
            F.struct(F.col("predicted").alias("action"), route.alias("route"), F.lit("learned_model_prediction").alias("reason"), F.col("probability").alias("confidence"))
        )
    )


def diagnostics(decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Confusion counts, per-class figures and totals of ``(truth, predicted)`` rows."""
    cells = decisions.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    sides = cells.select(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    sides = sides.unionByName(cells.select(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit")))
    per = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = per.select(
        "label", "support", ratio(F.col("hit"), F.col("called")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), "hit"
    )
    both = F.col("precision") + F.col("recall")
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))
    totals = per.agg(F.sum("support").alias("total_decisions"), ratio(F.sum("hit"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"))
    return cells, per.drop("hit"), totals


# ---------------------------------------------------------------- reformulation


def squash(text: Column) -> Column:
    return F.array_join(tx.words(F.lower(text)), " ")


def reformulate(query: Column, previous: Column) -> Column:
    """Struct ``(query, problem)``: the widened query, or why it was refused."""
    wider = F.concat(F.rtrim(query, F.lit("?")), F.lit(REFORMULATION_SUFFIX))
    kept = F.forall(F.regexp_extract_all(query, F.lit(PROTECTED), F.lit(0)), lambda t: F.contains(wider, t))
    seen = F.array_union(F.transform(previous, lambda p: squash(p)), F.array(squash(query)))
    problem = (
        F.when(F.length(wider) > 1000, "invalid_length")
        .when(~kept, "lost_identifier")
        .when(F.array_contains(seen, squash(wider)), "duplicate_reformulation")
    )
    return F.struct(F.when(problem.isNull(), wider).alias("query"), problem.alias("problem"))
