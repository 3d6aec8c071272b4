"""Seven retrieval baselines over a case table, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.operators.packages import blocked_stop


def baseline_results(cases: DataFrame, hits: DataFrame, *, local_source: str, web_source: str, web_cost: int) -> DataFrame:
    """``case_id, split, baseline_name, route, source_id, ...`` for every case and baseline.

    ``cases`` carries the policy columns, the rule plan ``plan struct<route, source_id, reasons>`` and
    the learned ``predicted_route``; ``hits`` is ``case_id, retriever, evidence_id, chars`` for the
    retrievers ``local, web, local_compressed, web_compressed, corpus``. Each baseline is a choice of
    route and retriever per case, so all of them share one join with the hits. Expected labels are
    never read here.
    """
    calls, consent = F.col("max_retrieval_calls") > 0, F.col("allow_external_query")
    paid = (F.col("max_web_calls") > 0) & (F.col("max_cost") > 0)

    def choice(name: str, route: Column, source: Column, stop: Column, retriever: Column) -> Column:
        return F.struct(
            F.lit(name).alias("baseline_name"), route.cast("string").alias("route"), source.cast("string").alias("source_id"),
            stop.cast("string").alias("blocked_stop"), retriever.cast("string").alias("retriever"),
        )

    local_stop = F.when(~calls, "budget_exceeded")
    web_stop = F.when(~consent, "unsupported_profile").when(~paid, "budget_exceeded")
    plan = F.col("plan")
    plan_stop = F.when(plan["route"] == "blocked", blocked_stop(plan["reasons"])).when(plan["route"] == "unknown_source", "source_unavailable")
    learned_stop = (
        F.when(F.col("predicted_route") == "blocked", "unsupported_profile")
        .when(F.col("predicted_route") == "web", web_stop)
        .otherwise(local_stop)
    )
    fixed = lambda name, stop, route, source: choice(
        name, F.when(stop.isNull(), route).otherwise("blocked"), F.when(stop.isNull(), source), stop, F.when(stop.isNull(), route)
    )
    planned = lambda name, local, web: choice(
        name, F.when(plan_stop.isNull(), plan["route"]).otherwise("blocked"), F.when(plan_stop.isNull(), plan["source_id"]), plan_stop,
        F.when(plan_stop.isNull(), F.when(plan["route"] == "web", web).otherwise(local)),
    )
    guess = F.when(F.col("predicted_route") == "web", "web").otherwise("local")
    options = F.array(
        choice("no_retrieval", F.lit("no_retrieval"), F.lit(None), F.lit(None), F.lit(None)),
        fixed("fixed_local", local_stop, F.lit("local"), F.lit(local_source)),
        fixed("fixed_web", web_stop, F.lit("web"), F.lit(web_source)),
        planned("heuristic_planner", "local", "web"),
        planned("heuristic_plus_compression", "local_compressed", "web_compressed"),
        fixed("learned_planner", learned_stop, guess, F.when(guess == "web", web_source).otherwise(local_source)),
        planned("corpus_adapter", "corpus", "web"),
    )
    rows = cases.select("case_id", "split", F.explode(options).alias("b")).select("case_id", "split", "b.*")
    found = hits.groupBy("case_id", "retriever").agg(
        F.count("*").alias("evidence_count"), F.sum("chars").alias("context_characters"), F.sum(F.ceil(F.col("chars") / 4)).alias("estimated_tokens"),
        F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"),
    )
    out = rows.join(found, ["case_id", "retriever"], "left")
    got = F.coalesce("evidence_count", F.lit(0))
    asked = F.col("retriever").isNotNull()
    web = F.coalesce(F.col("route") == "web", F.lit(False))
    return out.select(
        "case_id", "split", "baseline_name", "route", "source_id",
        got.alias("evidence_count"),
        F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"),
        F.coalesce("context_characters", F.lit(0)).alias("context_characters"), F.coalesce("estimated_tokens", F.lit(0)).alias("estimated_tokens"),
        F.coalesce("blocked_stop", F.when(got > 0, "success").otherwise("no_evidence")).alias("stop_reason"),
        asked.cast("long").alias("retrieval_calls"), web.cast("long").alias("web_calls"), (web.cast("long") * web_cost).alias("cost"),
        F.forall(F.coalesce("evidence_ids", F.array().cast("array<string>")), lambda e: ~tx.is_blank(e)).alias("citations_valid"),
        ((got == 0) | F.col("source_id").isNotNull()).alias("provenance_preserved"),
    )
