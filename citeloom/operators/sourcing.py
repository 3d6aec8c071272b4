"""Source planning for context packages: cues, policies, budgets and consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as tx

# Planner cues.
FRESHNESS = "latest|current|today|recent|news|newest|this week|this month|this year|as of"
LOCAL_REFERENCE = "this project|this codebase|our docs|our documentation|local docs|internal docs"
TIME_REFERENCE = (
    r"19[0-9][0-9]|20[0-9][0-9]|[0-9]{4}-[0-9]{2}-[0-9]{2}|january|february|march|april|may|june|july|august"
    "|september|october|november|december|yesterday|tomorrow"
)
WALL_CLOCK_WARNING = "Wall-clock budget was exceeded after retrieval completed."
LOCAL, WEB = "local_document", "web_search_snippet"
# Classifier cues.
ROUTER_FRESH = "latest|recent|release|current|update|new|announcements"
ROUTER_LOCAL = r"docs/|src/|config\.json|\.md"


def planner_features(df: DataFrame, query: str = "query") -> DataFrame:
    q = F.lower(tx.strip(F.col(query)))
    return df.withColumns({
        "normalized_length": F.length(tx.strip(F.col(query))),
        "token_like_count": tx.word_count(F.col(query)),
        "has_freshness_cue": q.rlike(tx.bounded(FRESHNESS)),
        "has_local_reference_cue": q.rlike(tx.bounded(LOCAL_REFERENCE)),
        "has_explicit_time_reference": q.rlike(tx.bounded(TIME_REFERENCE)),
    })


def default_budget(df: DataFrame) -> DataFrame:
    """Fill missing budgets from profile and consent."""
    open_web = (F.col("execution_profile") == "hybrid") & F.coalesce("allow_external_query", F.lit(False))
    return df.withColumns({
        "max_retrieval_calls": F.coalesce("max_retrieval_calls", F.lit(1)),
        "max_web_calls": F.coalesce("max_web_calls", F.when(open_web, 1).otherwise(0)),
        "max_cost": F.coalesce("max_cost", F.when(open_web, 1_000_000).otherwise(0)),
    })


def _best(sources: DataFrame, kind: str) -> DataFrame:
    """The default source of a kind, else the first registered one."""
    row = sources.filter(F.col("source_kind") == kind).agg(
        F.min_by(
            F.struct("source_id", "enabled", "profiles", "cost"),
            F.struct((~F.col("is_default")).alias("a"), F.col("registered").alias("b")),
        ).alias("s")
    )
    return row


def plan_sources(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Choose local, web or blocked for every request, with the selected source and reason codes.

    ``requests``: planner features, ``execution_profile, allow_external_query, max_retrieval_calls,
    max_web_calls, max_cost, wanted_source``. ``sources``: ``source_id, source_kind, enabled, profiles,
    cost, is_default, registered``. The three fallback descriptors are single rows and enter as
    scalar values; only an explicitly wanted source is joined.
    """
    wanted = sources.select(
        F.col("source_id").alias("wanted_source"), F.col("source_kind").alias("w_kind"), F.col("enabled").alias("w_enabled"),
        F.col("profiles").alias("w_profiles"), F.col("cost").alias("w_cost"),
    )
    df = requests.join(wanted, "wanted_source", "left").withColumns({
        "_local": _best(sources, LOCAL).scalar(),
        "_web": _best(sources, WEB).scalar(),
        "_default_kind": sources.filter("is_default").agg(F.min("source_kind").alias("k")).scalar(),
    })
    profile, consent = F.col("execution_profile"), F.coalesce("allow_external_query", F.lit(False))
    result = lambda route, source, *reasons: F.struct(
        F.lit(route).alias("route"), source.cast("string").alias("source_id"), F.concat_ws(",", *reasons).alias("reasons")
    )
    nothing = F.lit(None)
    blocked = lambda reason: result("blocked", nothing, reason)

    def web_refusal(usable: Column, cost: Column, *, source_first: bool) -> Column:
        """Why a web source may not be asked. Explicit and default sources check availability first."""
        gone = F.when(~usable, F.lit("web_source_unavailable"))
        rules = [
            F.when(profile != "hybrid", F.lit("invalid_profile")),
            F.when(~consent, F.lit("external_query_not_allowed")),
            F.when(F.col("max_web_calls") < 1, F.lit("web_call_budget_exhausted")),
            F.when(F.col("max_cost") < cost, F.lit("external_cost_budget_exhausted")),
        ]
        return F.coalesce(*([gone, *rules] if source_first else [*rules[:2], gone, *rules[2:]]))

    local, web = F.col("_local"), F.col("_web")
    has_local = local["source_id"].isNotNull()
    supported = F.array_contains(local["profiles"], profile)
    local_ok = F.coalesce(has_local & local["enabled"] & supported, F.lit(False))
    local_refusal = F.when(has_local & ~supported, F.lit("invalid_profile")).otherwise(F.lit("local_source_unavailable"))
    web_usable = F.coalesce(web["enabled"], F.lit(False))
    web_no = web_refusal(web_usable, web["cost"], source_first=False)
    wanted_no = web_refusal(F.col("w_enabled"), F.col("w_cost"), source_first=True)
    default_local = F.lit("default_local")
    to_local = lambda *reasons: result("local", local["source_id"], *reasons)

    explicit = (
        F.when(F.col("w_kind").isNull() & (F.col("wanted_source") == "web_search"), blocked(F.lit("web_source_unavailable")))
        .when(F.col("w_kind").isNull(), result("unknown_source", nothing, F.lit("unknown_source")))
        .when((F.col("w_kind") == WEB) & wanted_no.isNotNull(), blocked(wanted_no))
        .when(F.col("w_kind") == WEB, result("web", F.col("wanted_source"), F.lit("caller_selected_source")))
        .when(~F.col("w_enabled"), blocked(F.lit("local_source_unavailable")))
        .when(~F.array_contains("w_profiles", profile), blocked(F.lit("invalid_profile")))
        .otherwise(result("local", F.col("wanted_source"), F.lit("caller_selected_source")))
    )
    plan = (
        F.when(F.col("max_retrieval_calls") == 0, blocked(F.lit("retrieval_budget_exhausted")))
        .when(F.col("wanted_source").isNotNull(), explicit)
        .when(F.col("has_local_reference_cue") & local_ok, to_local(default_local))
        .when(F.col("has_local_reference_cue"), blocked(local_refusal))
        .when(F.col("has_freshness_cue") & web_no.isNull(), result("web", web["source_id"], F.lit("freshness_cue")))
        .when(F.col("has_freshness_cue") & local_ok, to_local(web_no, default_local))
        .when(F.col("has_freshness_cue"), blocked(web_no))
        .when((F.col("_default_kind") == WEB) & web_no.isNull(), result("web", web["source_id"], default_local))
        .when(F.col("_default_kind") == WEB, blocked(web_no))
        .when(local_ok, to_local(default_local))
        .otherwise(blocked(local_refusal))
    )
    return df.withColumn("plan", plan).drop("_local", "_web", "_default_kind", "w_kind", "w_enabled", "w_profiles", "w_cost")


def resolve_sources(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Resolve wanted (or default) sources: ``found``, or why not."""
    default = sources.filter("is_default").agg(F.min("source_id").alias("d")).scalar()
    asked = requests.withColumn("source_id", F.coalesce("wanted_source", default))
    got = asked.join(sources.select("source_id", "enabled", "profiles", F.lit(True).alias("known")), "source_id", "left")
    problem = (
        F.when(F.col("source_id").isNull(), "no_default_source")
        .when(F.col("known").isNull(), "unknown_source")
        .when(~F.col("enabled"), "source_disabled")
        .when(~F.array_contains("profiles", F.col("execution_profile")), "profile_not_supported")
    )
    return got.withColumn("problem", problem).drop("known", "enabled", "profiles")


def registration_problems(sources: DataFrame) -> DataFrame:
    """Ids registered twice; more than one default."""
    twice = sources.groupBy("source_id").count().filter("count > 1").select(F.col("source_id").alias("entity_id"), F.lit("duplicate_source_id").alias("rule"))
    many = sources.filter("is_default").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("*").alias("entity_id"), F.lit("several_defaults").alias("rule"))
    return twice.unionByName(many)


def preflight(route: Column, reasons: Column, kind: Column, cost: Column) -> Column:
    """Struct ``(allowed, reason)`` of the last check before a source is asked."""
    is_web = (route == "web") | F.coalesce(kind == WEB, F.lit(False))
    dear = F.coalesce((cost > 0) | is_web, F.lit(False)) & F.coalesce(F.col("max_cost") < cost, F.lit(False))
    reason = (
        F.when(route == "blocked", F.coalesce(F.nullif(F.substring_index(reasons, ",", 1), F.lit("")), F.lit("retrieval_budget_exhausted")))
        .when(F.col("max_retrieval_calls") < 1, "retrieval_budget_exhausted")
        .when(is_web & (F.col("max_web_calls") < 1), "web_call_budget_exhausted")
        .when(dear, "external_cost_budget_exhausted")
    )
    return F.struct(reason.isNull().alias("allowed"), reason.alias("reason"))


def budget_used(retrieval_calls: Column, web_calls: Column, elapsed_ms: Column, cost: Column) -> Column:
    """Consumption as a map; cost is charged for web calls that were really made."""
    return F.create_map(
        F.lit("estimated_external_cost_microusd"), (F.coalesce(cost, F.lit(0)) * web_calls).cast("long"),
        F.lit("retrieval_calls"), retrieval_calls.cast("long"),
        F.lit("wall_clock_ms"), F.floor(elapsed_ms).cast("long"),
        F.lit("web_calls"), web_calls.cast("long"),
    )


def wall_clock(elapsed_ms: Column, limit_ms: Column, stop_reason: Column, warnings: Column) -> Column:
    """Struct ``(stop_reason, warnings)`` after the clock was compared with its limit."""
    over = elapsed_ms > limit_ms
    return F.struct(
        F.when(over, "budget_exceeded").otherwise(stop_reason).alias("stop_reason"),
        F.when(over, F.array_union(warnings, F.array(F.lit(WALL_CLOCK_WARNING)))).otherwise(warnings).alias("warnings"),
    )


def source_rules() -> dict[str, Column]:
    """Consistency of a registered source."""
    local, web = F.col("source_kind") == LOCAL, F.col("source_kind") == WEB
    slug = r"^[a-z0-9_-]+$"
    return {
        "bad_source_id": ~F.col("source_id").rlike(slug),
        "bad_adapter_id": ~F.col("adapter_id").rlike(slug),
        "blank_name": tx.is_blank(F.col("display_name")),
        "unknown_kind": ~F.col("source_kind").isin(LOCAL, WEB),
        "local_not_private": local & (F.col("privacy") != "private"),
        "local_not_snapshot": local & (F.col("freshness") != "snapshot"),
        "local_without_local_only": local & ~F.array_contains("profiles", "local_only"),
        "web_not_public": web & (F.col("privacy") != "public_web"),
        "web_not_live": web & (F.col("freshness") != "live"),
        "web_not_hybrid_only": web & (F.array_join("profiles", ",") != "hybrid"),
    }


def decision_rules() -> dict[str, Column]:
    """Consistency of a plan and of the candidates it led to."""
    return {
        "blocked_with_source": (F.col("route") == "blocked") & F.col("source_id").isNotNull(),
        "route_without_source": F.col("route").isin("local", "web") & tx.is_blank(F.col("source_id")),
        "budget_keys": F.array_join(F.array_sort(F.map_keys("budget_used")), ",") != "estimated_external_cost_microusd,retrieval_calls,wall_clock_ms,web_calls",
        "negative_budget": F.exists(F.map_values("budget_used"), lambda v: v < 0),
    }


def candidate_rules() -> dict[str, Column]:
    from citeloom.operators.fusion import https_problem

    return {
        "local_with_url": (F.col("source_kind") == LOCAL) & F.col("canonical_url").isNotNull(),
        "web_without_url": (F.col("source_kind") == WEB) & F.col("canonical_url").isNull(),
        "web_bad_url": (F.col("source_kind") == WEB) & https_problem(F.col("canonical_url")).isNotNull(),
        "kind_not_permitted": F.col("source_kind") != F.col("resolved_kind"),
        "source_mismatch": F.col("source_id") != F.col("resolved_source_id"),
    }


# ---------------------------------------------------------------- route classifier


def router_features(df: DataFrame, query: str = "query") -> DataFrame:
    """The eight inputs of the offline route classifier as ``features``."""
    q = F.lower(query)
    flag = lambda c: c.cast("int").cast("double")
    budget = (F.col("max_retrieval_calls") > 0) & (~F.col("allow_external_query") | ((F.col("max_web_calls") > 0) & (F.col("max_cost") > 0)))
    return df.withColumn(
        "features",
        F.array(
            F.least(F.length(query) / 200.0, F.lit(1.0)), F.least(tx.word_count(F.col(query)) / 30.0, F.lit(1.0)),
            flag(q.rlike(ROUTER_FRESH)), flag(q.rlike(ROUTER_LOCAL)), flag(q.rlike(tx.bounded("202[0-9]"))),
            flag(F.col("wanted_source").isNotNull()), flag(F.col("allow_external_query")), flag(budget),
        ),
    )


def gate_report(scored: DataFrame) -> DataFrame:
    """Accuracy of learned and rule routes per split, measured on real counts."""
    return scored.groupBy("split").agg(
        F.count("*").alias("samples"),
        F.avg((F.col("predicted") == F.col("expected_route")).cast("int")).alias("learned_accuracy"),
        F.avg((F.col("rule_route") == F.col("expected_route")).cast("int")).alias("rule_accuracy"),
    )
