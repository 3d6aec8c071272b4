"""The bounded retrieval loop over a whole query table.

Every step is a set operation on all queries that are still running; at most three rounds are
planned, and after each the state is written to the checkpoint folder, so neither the plan nor the
work to repeat after a lost executor grows with the rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions import text as tx
from citeloom.functions.checks import violations
from citeloom.operators import controller as ct
from citeloom.operators import evidence as ev
from citeloom.operators import fusion
from citeloom.session import cut_lineage

Search = Callable[[DataFrame], DataFrame]
#: A step of the loop that can be exchanged: it is given all queries at once and adds one column.
Step = Callable[[DataFrame], DataFrame]
ROUTES = ("sparse", "dense", "hybrid")
DECISION = T.StructType().add("action", "string").add("route", "string").add("reason", "string").add("confidence", "double")
REFINED = T.StructType().add("query", "string").add("problem", "string")


def query_features(df: DataFrame) -> DataFrame:
    """The extractor: feature columns of the active query."""
    return ct.query_features(df, "active_query")


def rule_controller(df: DataFrame) -> DataFrame:
    """``decision`` by the ordered rules."""
    return df.withColumn("decision", ct.rule_decision())


def learned_controller(policy: DataFrame, *, threshold: float = 0.50) -> Step:
    """``decision`` by stored or fitted parameters; unsure and spent queries fall back to the rules and guards."""

    def step(df: DataFrame) -> DataFrame:
        scored = ct.score_policy(df.withColumn("features", ct.feature_vector()), policy)
        return scored.withColumn("decision", ct.learned_decision(threshold=threshold)).drop("features", "predicted", "probability")

    return step


def widen(df: DataFrame) -> DataFrame:
    """The reformulator: ``refined`` holds the wider query, or why there is none; ``before`` lists what was asked."""
    return df.withColumn("refined", ct.reformulate(F.col("active_query"), F.col("before")))


def by_function(column: str, kind: T.DataType, function: Callable[[pd.DataFrame], Iterable]) -> Step:
    """A step made of a Python function: it is given a frame of rows and returns one value for each."""

    def step(df: DataFrame) -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField(column, kind)])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame.assign(**{column: pd.Series(list(function(frame)), index=frame.index, dtype=object)})

        return df.mapInPandas(run, schema)

    return step


def unusable_decision(decision: Column) -> Column:
    """Why a decision cannot be followed, or NULL."""
    action, route = decision["action"], decision["route"]
    asks = action.isin("retrieve_sparse", "retrieve_dense", "retrieve_hybrid")
    return F.when(action.isNull() | ~action.isin(*ct.ACTIONS), "unknown_action").when(
        asks & F.coalesce(F.concat(F.lit("retrieve_"), route) != action, F.lit(True)), "route_differs_from_action"
    ).when((action == "abstain") & decision["reason"].isNull(), "abstention_without_reason")


@dataclass(frozen=True)
class LoopLimits:
    max_iterations: int = 3
    max_retrieval_calls: int = 3
    top_k_context: int = 6
    max_context_chars: int = 24_000
    sufficient: float = ev.SUFFICIENT
    low: float = ev.LOW
    conflict: float = 0.60
    candidates: int = 20

    def __post_init__(self) -> None:
        if not (1 <= self.max_iterations <= 3 and 1 <= self.max_retrieval_calls <= 3):
            raise ValueError("the loop is bounded at three rounds")


def initial_state(queries: DataFrame, limits: LoopLimits = LoopLimits()) -> DataFrame:
    """``queries``: ``query_id, query`` and optional ``require_citations``."""
    cite = F.col("require_citations") if "require_citations" in queries.columns else F.lit(True)
    none = F.lit(None).cast("string")
    texts = F.array().cast("array<string>")
    return queries.select(
        "query_id", tx.strip(F.col("query")).alias("original_query"), tx.strip(F.col("query")).alias("active_query"), cite.alias("require_citations"),
        F.lit("running").alias("status"), none.alias("route"), none.alias("next_action"), none.alias("abstention_reason"),
        F.lit(0).alias("retrieval_calls"), F.lit(0).alias("iteration_count"),
        F.lit(limits.max_retrieval_calls).alias("max_retrieval_calls"), F.lit(limits.max_iterations).alias("max_iterations"),
        F.lit("unknown").alias("evidence_status"), F.lit(0.0).alias("sufficiency_score"), F.lit(0.0).alias("conflict_score"),
        F.lit(0).alias("evidence_count"), texts.alias("tried_routes"), texts.alias("attempts"), texts.alias("last_ids"), F.lit(False).alias("refinement_ready"), F.lit(False).alias("fallback_used"),
        F.lit("decide").alias("at"),
    )


def _stop(df: DataFrame, reason: Column) -> DataFrame:
    """Abstain where ``reason`` is not NULL and the query is still running."""
    now = (F.col("status") == "running") & reason.isNotNull()
    return df.withColumns({
        "abstention_reason": F.when(now, reason).otherwise(F.col("abstention_reason")),
        "status": F.when(now, "abstained").otherwise(F.col("status")),
        "next_action": F.when(now, None).otherwise(F.col("next_action")),
        "at": F.when(now, "done").otherwise(F.col("at")),
    })


def decide(state: DataFrame, available: tuple[str, ...] = ROUTES, *, extractor: Step = query_features, controller: Step = rule_controller) -> DataFrame:
    """Ask the controller about the running queries whose turn it is, and check the guards of a retrieval.

    Only they are given to the extractor and the controller; a decision that cannot be followed ends in
    an abstention for ``invalid_decision``.
    """
    columns = state.columns
    asked = (F.col("status") == "running") & (F.col("at") == "decide")
    judged = controller(extractor(state.filter(asked))).select(*columns, "decision")
    rest = state.filter(~asked).withColumn("decision", F.lit(None).cast(DECISION))
    df = judged.unionByName(rest).withColumn("turn", F.col("decision").isNotNull()).withColumn("d", F.col("decision"))
    turn = F.col("turn")
    bad = turn & unusable_decision(F.col("d")).isNotNull()
    df = df.withColumn("bad", bad).withColumns({
        "next_action": F.when(turn, F.when(F.col("bad"), "abstain").otherwise(F.col("d.action"))).otherwise(F.col("next_action")),
        "route": F.when(turn & ~F.col("bad"), F.coalesce("d.route", "route")).otherwise(F.col("route")),
        "reason_now": F.when(F.col("bad"), "invalid_decision").when(turn & (F.col("d.action") == "abstain"), F.col("d.reason")),
    }).withColumn("at", F.when(turn, edge_after_decision(F.col("abstention_reason"), F.col("next_action"))).otherwise(F.col("at")))
    df = _stop(df, F.col("reason_now"))
    df = _stop(df, F.when(F.col("at") == "abstain", "evidence_below_threshold"))
    # A route nobody serves costs no call and is replaced once by the first untried one.
    missing = (F.col("at") == "retrieve") & ~F.col("route").isin(*available)
    untried = F.get(F.array_except(F.array(*[F.lit(r) for r in available]), F.array_union("tried_routes", F.array("route"))), F.lit(0))
    df = df.withColumn("other", F.when(missing & ~F.col("fallback_used"), untried)).withColumn("fallback_used", F.col("fallback_used") | missing)
    df = _stop(df, F.when(missing & F.col("other").isNull(), "retrieval_unavailable"))
    df = df.withColumn("route", F.coalesce("other", "route")).withColumn("next_action", F.when(F.col("other").isNotNull(), F.concat(F.lit("retrieve_"), "other")).otherwise(F.col("next_action")))
    asks = F.col("at") == "retrieve"
    guard = (
        F.when(asks & (F.col("retrieval_calls") >= F.col("max_retrieval_calls")), "retrieval_budget_exhausted")
        .when(asks & (F.col("iteration_count") >= F.col("max_iterations")), "iteration_budget_exhausted")
        .when(asks & F.array_contains("attempts", F.concat_ws("\x1f", "route", "active_query")), "repeated_query_route")
    )
    return _stop(df, guard).select(*columns)


def record_retrieval(state: DataFrame, candidates: DataFrame, limits: LoopLimits) -> DataFrame:
    """Count the call, compare with the evidence of the round before and look for contradictions.

    ``candidates`` are hydrated rows of this round. Contradictions are searched in all of them, before
    reranking may drop a witness.
    """
    found = candidates.groupBy("query_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("new_ids"))
    clash = ev.conflict_scores(ev.conflict_pairs(candidates.withColumn("position", F.col("rank")))).select("query_id", F.col("conflict_score").alias("clash"))
    df = state.join(found, "query_id", "left").join(clash, "query_id", "left")
    went = (F.col("status") == "running") & (F.col("at") == "retrieve")
    new_ids = F.coalesce("new_ids", F.array().cast("array<string>"))
    same = went & (F.col("retrieval_calls") > 0) & (new_ids == F.col("last_ids"))
    df = df.withColumn("same", same).withColumns({
        "retrieval_calls": F.col("retrieval_calls") + went.cast("int"),
        "attempts": F.when(went, F.concat("attempts", F.array(F.concat_ws("\x1f", "route", "active_query")))).otherwise(F.col("attempts")),
        "tried_routes": F.when(went, F.array_union("tried_routes", F.array("route"))).otherwise(F.col("tried_routes")),
        "refinement_ready": F.when(went, False).otherwise(F.col("refinement_ready")),
        "last_ids": F.when(went, new_ids).otherwise(F.col("last_ids")),
        "conflict_score": F.when(went & ~same, F.greatest("conflict_score", F.coalesce("clash", F.lit(0.0)))).otherwise(F.col("conflict_score")),
    })
    hot = F.col("conflict_score") >= limits.conflict
    df = _stop(df, F.when(F.col("same") & hot, "conflicting_evidence").when(F.col("same"), "unchanged_evidence"))
    df = df.withColumn("evidence_status", F.when(went & hot, "conflicting").otherwise(F.col("evidence_status")))
    df = _stop(df, F.when((F.col("at") == "retrieve") & hot, "conflicting_evidence"))
    return df.drop("new_ids", "clash", "same")


def evaluate(state: DataFrame, candidates: DataFrame, scores: DataFrame | None, limits: LoopLimits) -> tuple[DataFrame, DataFrame]:
    """Rerank, pack and score the evidence; returns the new state and the packed evidence rows."""
    alive = state.filter("status = 'running' and at = 'retrieve'").select("query_id", "original_query")
    rows = candidates.join(alive.select("query_id"), "query_id", "left_semi")
    if scores is not None:
        kept = fusion.reorder(rows.select("query_id", "chunk_id", "rank", "score"), scores, limits.top_k_context)
        rows = kept.select("query_id", "chunk_id", "retrieval_rank", "retrieval_score", "rerank_score").join(rows.drop("rank", "score"), ["query_id", "chunk_id"])
    else:
        rows = rows.withColumnsRenamed({"rank": "retrieval_rank", "score": "retrieval_score"}).withColumn("rerank_score", F.lit(None).cast("double"))
    packed = ev.pack_context(rows, max_chunks=limits.top_k_context, max_characters=limits.max_context_chars)
    picked = packed.select("query_id", F.posexplode_outer("selected").alias("at", "chunk_id")).filter("chunk_id is not null")
    chosen = rows.join(picked, ["query_id", "chunk_id"]).withColumn("position", F.col("at") + 1).drop("at")
    chosen = cut_lineage(chosen.withColumn("citation_id", F.concat(F.lit("C"), "position")))
    scored = ev.sufficiency(alive.withColumnRenamed("original_query", "query"), chosen, sufficient=limits.sufficient, low=limits.low)
    sizes = chosen.groupBy("query_id").agg(F.count("*").cast("int").alias("ec"))
    df = state.join(scored.select("query_id", F.col("score").alias("s"), F.col("status").alias("es")), "query_id", "left").join(sizes, "query_id", "left")
    here = F.col("s").isNotNull()
    df = df.withColumns({
        "sufficiency_score": F.when(here, F.col("s")).otherwise(F.col("sufficiency_score")),
        "evidence_status": F.when(here, F.col("es")).otherwise(F.col("evidence_status")),
        "evidence_count": F.when(here, F.coalesce("ec", F.lit(0))).otherwise(F.col("evidence_count")),
    })
    after = edge_after_evaluation(
        F.col("abstention_reason"), F.col("evidence_status"), F.col("iteration_count"), F.col("max_iterations"), F.col("retrieval_calls"), F.col("max_retrieval_calls")
    )
    df = df.withColumn("at", F.when(here, after).otherwise(F.col("at"))).drop("s", "es", "ec")
    return _stop(df, F.when(F.col("at") == "abstain", "evidence_below_threshold")), chosen


def refine(state: DataFrame, reformulator: Step = widen) -> DataFrame:
    """Widen the active query of everything waiting for it; a refused, empty or repeated query ends in an abstention."""
    columns = state.columns
    asked = (F.col("status") == "running") & (F.col("at") == "reformulate")
    before = F.concat(F.transform("attempts", lambda a: F.substring_index(a, "\x1f", -1)), F.array("original_query", "active_query"))
    waiting = reformulator(state.filter(asked).withColumn("before", before)).select(*columns, "refined")
    df = waiting.unionByName(state.filter(~asked).withColumn("refined", F.lit(None).cast(REFINED)))
    turn = F.col("at") == "reformulate"
    spent = F.when(F.col("retrieval_calls") >= F.col("max_retrieval_calls"), "retrieval_budget_exhausted").when(F.col("iteration_count") >= F.col("max_iterations"), "iteration_budget_exhausted")
    df = _stop(df, F.when(turn, spent))
    none = F.col("refined").isNull() | F.col("refined.problem").isNotNull() | tx.is_blank(F.col("refined.query")) | (F.length("refined.query") > 1000)
    again = F.array_contains(F.transform(before, ct.squash), ct.squash(F.col("refined.query")))
    df = _stop(df, F.when((F.col("at") == "reformulate") & (none | F.coalesce(again, F.lit(False))), "duplicate_reformulation"))
    go = (F.col("at") == "reformulate") & (F.col("status") == "running")
    df = df.withColumn("go", go).withColumns({
        "active_query": F.when(F.col("go"), F.col("refined.query")).otherwise(F.col("active_query")),
        "iteration_count": F.col("iteration_count") + F.col("go").cast("int"),
        "refinement_ready": F.col("refinement_ready") | F.col("go"),
        "at": F.when(F.col("go"), "decide").otherwise(F.col("at")),
    })
    return _stop(df, F.when(F.col("go") & (F.col("iteration_count") >= F.col("max_iterations")), "iteration_budget_exhausted")).select(*columns)


def run_loop(
    queries: DataFrame, search: dict[str, Search], chunks: DataFrame, *, rerank: Callable[[DataFrame], DataFrame] | None = fusion.overlap_scores,
    limits: LoopLimits = LoopLimits(), extractor: Step = query_features, controller: Step = rule_controller, reformulator: Step = widen,
) -> tuple[DataFrame, DataFrame]:
    """Final states and packed evidence of all queries.

    ``extractor``, ``controller`` and ``reformulator`` are steps over all waiting queries, made of column
    expressions or of a Python function (``by_function``). A controller may ask for a reformulation before
    any search, so there are at most as many rounds as searches and reformulations together.

    ``search`` maps a route to a function from ``(query_id, query)`` to ``(query_id, chunk_id, rank,
    score)``; each round calls it once per route for all queries on that route. ``chunks``:
    ``chunk_id, document_id, title, source_uri, text``.
    """
    available = tuple(r for r in ROUTES if r in search)
    state = cut_lineage(initial_state(queries, limits))
    evidence: DataFrame | None = None
    for _ in range(limits.max_retrieval_calls + limits.max_iterations):
        state = cut_lineage(decide(state, available, extractor=extractor, controller=controller))
        asking = state.filter("status = 'running' and at = 'retrieve'").select("query_id", "route", "active_query", "original_query")
        places = state.filter("status = 'running' and at in ('retrieve', 'reformulate')").select("at", "route").distinct().collect()  # a few names
        waiting = {row.route for row in places if row["at"] == "retrieve"}
        if not places:
            break
        if not waiting:
            state = cut_lineage(refine(state, reformulator))
            continue
        results = None
        for route in sorted(waiting):
            part = search[route](asking.filter(F.col("route") == route).select("query_id", F.col("active_query").alias("query")))
            part = part.filter(F.col("rank") <= limits.candidates).select("query_id", "chunk_id", "rank", "score")
            results = part if results is None else results.unionByName(part)
        candidates = cut_lineage(fusion.hydrate(results, chunks))
        scores = None
        if rerank is not None:
            scores = rerank(candidates.join(asking.select("query_id", F.col("original_query").alias("query")), "query_id"))
        state = cut_lineage(record_retrieval(state, candidates, limits))
        state, chosen = evaluate(state, candidates, scores, limits)
        state = cut_lineage(refine(state, reformulator))
        # The newest evidence of a query replaces the older one; at most three small tables are joined.
        evidence = chosen if evidence is None else evidence.join(
            chosen.select("query_id").distinct(), "query_id", "left_anti"
        ).unionByName(chosen)
    if evidence is None:
        evidence = chunks.limit(0).select(F.lit(None).cast("long").alias("query_id"), "*")
    return state, evidence


# ---------------------------------------------------------------- edges and gates


def edge_after_decision(reason: Column, action: Column) -> Column:
    return (
        F.when(reason.isNotNull(), "abstain")
        .when(action.isin("direct_answer", "stop"), "generate")
        .when(action.isin("retrieve_sparse", "retrieve_dense", "retrieve_hybrid"), "retrieve")
        .when(action == "reformulate", "reformulate")
        .otherwise("abstain")
    )


def edge_after_evaluation(reason: Column, status: Column, rounds: Column, max_rounds: Column, calls: Column, max_calls: Column, pending: Column | None = None) -> Column:
    waiting = F.lit(False) if pending is None else pending
    return (
        F.when(reason.isNotNull(), "abstain")
        .when(waiting, "retrieve")
        .when(status == "sufficient", "generate")
        .when((rounds < max_rounds) & (calls < max_calls), "reformulate")
        .otherwise("abstain")
    )


def edge_after_citations(status: Column, failed: Column, attempts: Column) -> Column:
    return F.when(status == "abstained", "abstain").when(~failed, "finalize").when(attempts < 2, "generate").otherwise("abstain")


def answer_gate(evidence_count: Column, limits: LoopLimits = LoopLimits()) -> Column:
    """Why no answer may be generated, or NULL, over state columns."""
    direct = (F.col("next_action") == "direct_answer") & ~F.col("require_citations") & ct.is_greeting(F.col("original_query"))
    return F.when(~F.coalesce(direct, F.lit(False)),
        F.when(F.col("conflict_score") >= 0.30, "conflicting_evidence")
        .when(evidence_count == 0, "evidence_below_threshold")
        .when((F.col("evidence_status") != "sufficient") | (F.round("sufficiency_score", 9) < limits.sufficient), "evidence_below_threshold"),
    )


def finish(state: DataFrame, evidence: DataFrame, answers: DataFrame, limits: LoopLimits = LoopLimits()) -> DataFrame:
    """Gate supplied answers: ``answers`` is ``query_id, first, second`` (NULL when none was made).

    The second attempt is only looked at when the citations of the first are invalid.
    """
    cites = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list("citation_id")).alias("allowed"), F.count("*").alias("n"))
    df = state.join(cites, "query_id", "left").join(answers, "query_id", "left")
    allowed = F.coalesce("allowed", F.array().cast("array<string>"))
    df = _stop(df, answer_gate(F.coalesce("n", F.lit(0)), limits))
    df = _stop(df, F.when(F.col("first").isNull(), "generator_unavailable"))
    needed = F.coalesce(F.col("route") != "direct", F.lit(True))
    valid = lambda c: F.coalesce(F.size(ev.citation_errors(F.col(c), allowed, required=needed)) == 0, F.lit(False))
    df = df.withColumn("answer", F.when(valid("first"), F.col("first")).when(valid("second"), F.col("second")))
    df = df.withColumn("generation_attempts", F.when(F.col("status") != "running", 0).when(valid("first"), 1).otherwise(2))
    df = _stop(df, F.when(F.col("answer").isNull(), "invalid_citations"))
    done = F.col("status") == "running"
    refused = F.concat(F.lit("Unable to provide a grounded answer: "), "abstention_reason", F.lit("."))
    df = df.withColumn("answer", F.when(done, F.col("answer")).otherwise(refused)).withColumn("citations", F.when(done, ev.inline_citations(F.col("answer"))).otherwise(F.array().cast("array<string>")))
    return df.withColumns({"status": F.when(done, "completed").otherwise(F.col("status")), "next_action": F.lit(None).cast("string")}).drop("first", "second", "allowed", "n", "at")


# Metadata that may leave the service.
PUBLIC_METADATA = ("source_type", "heading_path", "all_routes", "sparse_rank", "dense_rank", "sparse_score", "dense_score")


def public_metadata(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda k, v: k.isin(*PUBLIC_METADATA))


def state_problems(states: DataFrame) -> DataFrame:
    """Broken invariants of final states; ``allowed`` lists the citation ids of the evidence."""
    terminal = F.col("status").isin("completed", "abstained", "failed")
    cited = ev.inline_citations(F.col("answer"))
    complete = F.col("status") == "completed"
    factual = complete & F.coalesce(F.col("route") != "direct", F.lit(True))
    rules = {
        "too_many_rounds": F.col("iteration_count") > F.col("max_iterations"),
        "too_many_calls": F.col("retrieval_calls") > F.col("max_retrieval_calls"),
        "terminal_with_action": terminal & F.col("next_action").isNotNull(),
        "completed_without_answer": complete & F.coalesce(tx.strip(F.col("answer")) == "", F.lit(True)),
        "completed_without_citation": factual & (F.size(cited) == 0),
        "citation_not_allowed": factual & (F.size(F.array_except(cited, F.col("allowed"))) > 0),
        "citations_differ": factual & (F.array_sort(cited) != F.array_sort("citations")),
        "abstained_without_reason": (F.col("status") == "abstained") & F.coalesce(tx.strip(F.col("abstention_reason")) == "", F.lit(True)),
    }
    return violations(states, F.col("query_id"), rules)
