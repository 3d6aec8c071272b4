"""Answer gates over packages and supplied answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.evidence import package_citations

# Texts given instead of an answer.
TEXTS = {
    "no_evidence": "Insufficient evidence to generate an answer.",
    "unspecified": "No generation provider was specified.",
    "unavailable": "Configured generation provider is unavailable or disabled.",
    "external": "External generation is not permitted by policy.",
    "private": "Private evidence export to hosted provider is not permitted by policy.",
    "failed": "Generation request failed.",
    "invalid": "Answer contained missing, malformed, or unknown citations.",
}


def gate_answers(packages: DataFrame, answers: DataFrame, providers: DataFrame) -> DataFrame:
    """Decide the status of an answer for every package.

    ``packages``: ``package_id, evidence, wanted_provider, allow_external, allow_private_export`` and the
    generation settings; ``answers``: ``package_id, answer`` (missing means the provider failed);
    ``providers``: ``provider_id, location, model_id, enabled``.
    """
    known = providers.filter("enabled").select(F.col("provider_id").alias("wanted_provider"), "location", "model_id")
    cites = packages.select("package_id", F.explode_outer("evidence").alias("e")).filter("e is not null").select("package_id", "e.citation_id", "e.evidence_id")
    checked = package_citations(answers, cites)
    df = packages.join(answers, "package_id", "left").join(known, "wanted_provider", "left").join(checked, "package_id", "left")
    hosted = F.col("location") == "hosted"
    private = F.exists("evidence", lambda e: e["source_kind"] == "local_document")
    outcome = lambda status, reason, text, model=False: F.struct(
        F.lit(status).alias("status"), F.lit(reason).cast("string").alias("abstention_reason"),
        (F.lit(TEXTS[text]) if text else F.col("answer")).alias("text"), F.lit(model).alias("has_model"),
    )
    gate = (
        F.when(F.size("evidence") == 0, outcome("abstained", "no_evidence", "no_evidence"))
        .when(F.col("wanted_provider").isNull(), outcome("provider_unavailable", "provider_not_configured", "unspecified"))
        .when(F.col("location").isNull(), outcome("provider_unavailable", "provider_not_configured", "unavailable"))
        .when(hosted & ~F.col("allow_external"), outcome("policy_blocked", "external_generation_not_allowed", "external", True))
        .when(hosted & private & ~F.col("allow_private_export"), outcome("policy_blocked", "private_evidence_export_not_allowed", "private", True))
        .when(F.col("answer").isNull(), outcome("generation_failed", "provider_failure", "failed", True))
        .when(~F.coalesce("is_valid", F.lit(False)), outcome("invalid_citations", "invalid_citations", "invalid", True))
        .otherwise(outcome("success", None, None, True))
    )
    df = df.withColumn("g", gate).select("*", "g.*").drop("g")
    judged = F.col("status").isin("success", "invalid_citations")
    df = df.withColumn("cited_evidence_ids", F.when(judged, F.col("valid_evidence_ids")).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("citation_valid", F.col("status") == "success")
    return df.withColumn("answer_id", answer_id())


def answer_id() -> Column:
    """Identity of an answer from its stable inputs; the text enters as its raw digest."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("")).cast("binary")
    flag = lambda c: F.when(c, "True").otherwise("False").cast("binary")
    seen = F.col("status") != "abstained"
    provider = F.when(seen, F.col("wanted_provider"))
    model = F.when(F.col("has_model"), F.col("model_id"))
    whole = F.concat(
        text(F.col("package_id")), text(provider), text(model), text(F.col("wanted_provider")), text(F.col("temperature")),
        text(F.col("max_output_tokens")), text(F.col("timeout_ms")), flag(F.col("allow_external")), flag(F.col("allow_private_export")),
        F.unhex(F.sha2("text", 256)), text(F.col("status")), text(F.col("abstention_reason")),
        text(F.array_join(F.array_sort("cited_evidence_ids"), "")),
    )
    return F.concat(F.lit("ans_"), F.substring(F.sha2(whole, 256), 1, 24))


def capabilities(sources: DataFrame, providers: DataFrame) -> DataFrame:
    """Public facts about sources and providers; adapters, limits and costs stay out."""
    s = sources.select(F.lit("source").alias("kind"), F.col("source_id").alias("id"), F.col("source_kind").alias("type"), "enabled", F.array_join("profiles", ",").alias("detail"))
    p = providers.select(F.lit("provider").alias("kind"), F.col("provider_id").alias("id"), F.col("location").alias("type"), "enabled", F.col("model_id").alias("detail"))
    return s.unionByName(p)
