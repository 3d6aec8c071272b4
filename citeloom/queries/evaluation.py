"""Score cards, resampling tests, dataset checks, inspection and fixture baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.functions.quantiles import exact_quantiles
from citeloom.operators import compression, controller, fusion, markup, metrics, resampling, samples, scoring, sourcing
from citeloom.operators import sourcing as so
from citeloom.plans.baselines import baseline_results
from citeloom.queries import control
from citeloom.queries import inputs as inp
from citeloom.queries.base import fragment, register, sql
from citeloom.queries import packaging, retrieval
from citeloom.session import cut_lineage



def by_mode(spark, folder):
    return retrieval.by_mode(inp.runs(spark, folder))


# ---------------------------------------------------------------- system outputs


def system_rows(spark, folder):
    """Outputs of four systems: the answer quotes the first chunk and cites one, two or a wrong id."""
    modes = by_mode(spark, folder)
    first = modes.filter("rank = 1").select("mode", "query_id", "chunk_id").join(inp.chunks(spark, folder).select("chunk_id", "text"), "chunk_id")
    q, size = F.col("query_id"), F.length("mode")
    kind = (q + size) % 7
    status = F.when(kind == 0, "failed").when(kind == 1, "abstained").otherwise("completed")
    tail = F.when(q % 3 == 0, " [C1]").when(q % 3 == 1, " [C2] [C1]").otherwise(" [C9]")
    return first.select(
        F.col("mode").alias("system_name"), "query_id", F.concat("text", tail).alias("answer"),
        F.when(q % 4 == 0, F.array(F.lit("C3"))).otherwise(F.array().cast("array<string>")).alias("citations"), status.alias("status"),
        ((q * 13 + size * 7) % 100 + 0.5).alias("latency_ms"), (q % 3 + 1).alias("retrieval_calls"), (q % 2).alias("iterations"),
    )


fragment("system_rows", """SELECT mode AS system_name, query_id, text || CASE query_id % 3 WHEN 0 THEN ' [C1]' WHEN 1 THEN ' [C2] [C1]' ELSE ' [C9]' END AS answer,
    CASE WHEN query_id % 4 = 0 THEN ['C3'] ELSE []::VARCHAR[] END AS citations, CASE (query_id + length(mode)) % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'abstained' ELSE 'completed' END AS status,
    (query_id * 13 + length(mode) * 7) % 100 + 0.5::DOUBLE AS latency_ms, query_id % 3 + 1 AS retrieval_calls, query_id % 2 AS iterations
    FROM by_mode JOIN chunks USING (chunk_id) WHERE rank = 1""", "by_mode", "chunks")


def fact_rows(spark, folder):
    """Sentences of the gold passage as facts."""
    return inp.queries(spark, folder).select("query_id", F.posexplode(F.split("query", r"\.\s*")).alias("fact_id", "statement")).filter("statement <> ''")


fragment("fact_rows", """SELECT query_id, fact_id, statement FROM (SELECT query_id, unnest(range(len(p))) AS fact_id, unnest(p) AS statement FROM (
    SELECT query_id, regexp_split_to_array(query, '\\.\\s*') AS p FROM bench_queries)) WHERE statement <> ''""", "bench_queries")
FACT_STOP = "[" + ",".join(f"'{w}'" for w in metrics.FACT_STOPWORDS) + "]"
fragment("fact_scores", f"""SELECT system_name, query_id, matched, CASE WHEN facts > 0 THEN matched / facts ELSE 0 END AS recall,
    CASE WHEN matched = 0 THEN 0 WHEN matched = facts THEN CASE WHEN least(1, matched * 150 / greatest(chars, 1)) < 0.5 THEN 0.5::DOUBLE ELSE 1 END ELSE least(1, matched * 150 / greatest(chars, 1)) END AS precision FROM (
    SELECT s.system_name, s.query_id, length(any_value(s.answer)) AS chars, count(f.fact_id) AS facts,
      count(*) FILTER (len(fw) > 0 AND len(list_intersect(fw, aw)) / len(fw) >= 0.5) AS matched
    FROM (SELECT *, list_distinct({inp.sql_ascii_words('lower(answer)')}) AS aw FROM system_rows) s LEFT JOIN
      (SELECT *, list_filter(list_distinct({inp.sql_ascii_words('lower(statement)')}), lambda w: NOT list_contains({FACT_STOP}, w)) AS fw FROM fact_rows) f USING (query_id) GROUP BY 1, 2)""", "system_rows", "fact_rows")
fragment("fact_f1", "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM fact_scores", "fact_scores")


@register("fact_overlap", "J7", sql(
    "SELECT system_name, query_id, matched AS matched_facts, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM fact_f1", "fact_f1"))
def fact_overlap(spark, folder):
    return metrics.fact_metrics(system_rows(spark, folder), fact_rows(spark, folder), scoring.KEYS)


def citation_map(spark, folder):
    return by_mode(spark, folder).select(F.col("mode").alias("system_name"), "query_id", F.concat(F.lit("C"), "rank").alias("citation_id"), "chunk_id")


def retrieved(spark, folder):
    return by_mode(spark, folder).withColumnRenamed("mode", "system_name")


fragment("cite_scores", """SELECT system_name, query_id, count(*) AS cited, count(chunk_id) AS valid, count(gold) AS grounded, count(DISTINCT gold) AS gold_chunks FROM (
    SELECT c.system_name, c.query_id, m.chunk_id, g.chunk_id AS gold FROM (SELECT system_name, query_id, unnest(list_distinct(list_concat(list_transform(regexp_extract_all(answer, '\\[C([0-9]+)\\]', 1), lambda n: 'C' || n), citations))) AS cid FROM system_rows) c
    LEFT JOIN by_mode m ON m.mode = c.system_name AND m.query_id = c.query_id AND 'C' || m.rank = c.cid LEFT JOIN qrels g ON g.query_id = c.query_id AND g.chunk_id = m.chunk_id) GROUP BY 1, 2""", "system_rows", "by_mode", "qrels")
fragment("gold_counts", "SELECT query_id, count(*) AS n FROM qrels GROUP BY 1", "qrels")
fragment("cite_rates", """SELECT system_name, query_id, cited, valid / cited AS validity, grounded / cited AS precision, coalesce(gold_chunks / n, 0) AS recall, valid = cited AS all_valid FROM cite_scores LEFT JOIN gold_counts USING (query_id)""", "cite_scores", "gold_counts")


@register("citation_quality", "J8", sql(
    """SELECT system_name, query_id, cited, round(validity, 6) AS citation_validity_rate, round(precision, 6) AS citation_precision, round(recall, 6) AS citation_recall, all_valid AS all_citations_valid FROM cite_rates""", "cite_rates"))
def citation_quality(spark, folder):
    return metrics.citation_metrics(system_rows(spark, folder), citation_map(spark, folder), retrieved(spark, folder), inp.qrels(spark, folder), scoring.KEYS)


def sample_rows(spark, folder):
    gold = inp.qrels(spark, folder).join(inp.chunks(spark, folder).select("chunk_id", "document_id"), "chunk_id").groupBy("query_id").agg(F.count_distinct("document_id").alias("gold_documents"))
    return inp.queries(spark, folder).select("query_id").join(gold, "query_id", "left").select(
        "query_id", F.col("gold_documents").isNull().alias("requires_abstention"), F.coalesce("gold_documents", F.lit(0)).alias("gold_documents")
    )


def wanted(spark, folder):
    names = F.explode(F.array(*[F.lit(m) for m in ("sparse", "dense", "hybrid", "reranked")]))
    return inp.queries(spark, folder).select("query_id", names.alias("system_name"))


fragment("eval_samples", """SELECT q.query_id, d.n IS NULL AS requires_abstention, coalesce(d.n, 0) AS gold_documents FROM bench_queries q LEFT JOIN
    (SELECT query_id, count(DISTINCT document_id) AS n FROM qrels JOIN chunks USING (chunk_id) GROUP BY 1) d USING (query_id)""", "bench_queries", "qrels", "chunks")
OUTCOME = """CASE WHEN status NOT IN ('completed', 'abstained') THEN 'execution_failed' WHEN requires_abstention AND status = 'abstained' THEN 'true_positive' WHEN NOT requires_abstention AND status <> 'abstained' THEN 'true_negative'
    WHEN status = 'abstained' THEN 'false_positive' ELSE 'false_negative' END"""


@register("abstention_outcomes", "J9, J16", sql(
    f"""SELECT system_name, query_id, status, {OUTCOME} AS outcome FROM (SELECT w.system_name, q.query_id, requires_abstention, coalesce(CASE WHEN q.query_id % 6 = 5 THEN NULL ELSE status END, 'failed') AS status
        FROM eval_samples q, (VALUES ('sparse'), ('dense'), ('hybrid'), ('reranked')) w(system_name) LEFT JOIN system_rows s ON s.system_name = w.system_name AND s.query_id = q.query_id)""", "eval_samples", "system_rows"))
def abstention_outcomes(spark, folder):
    partial = system_rows(spark, folder).filter("query_id % 6 <> 5")
    rows = scoring.isolate_failures(wanted(spark, folder), partial).join(sample_rows(spark, folder), "query_id")
    return rows.select("system_name", "query_id", "status", metrics.abstention_outcome(F.col("status"), F.col("requires_abstention")).alias("outcome"))


def cards(spark, folder):
    return inp.stored(spark, folder, "cards", lambda: fresh_cards(spark, folder))


def fresh_cards(spark, folder):
    outputs = scoring.isolate_failures(wanted(spark, folder), system_rows(spark, folder))
    return scoring.score_cards(sample_rows(spark, folder), outputs, retrieved(spark, folder), citation_map(spark, folder), inp.qrels(spark, folder), fact_rows(spark, folder))


fragment("cards", f"""SELECT s.system_name, s.query_id, coalesce(h1 / g.n, 0) AS recall_at_1, coalesce(h3 / g.n, 0) AS recall_at_3, coalesce(h5 / g.n, 0) AS recall_at_5, coalesce(h10 / g.n, 0) AS recall_at_10, coalesce(1.0::DOUBLE / fr, 0) AS mrr,
    coalesce(dcg / list_sum(list_transform(range(1, least(g.n, 10) + 1), lambda r: 1.0::DOUBLE / log2(r + 1))), 0) AS ndcg_at_10, f.f1 AS fact_f1, c.validity, c.precision AS citation_precision, c.recall AS citation_recall,
    {OUTCOME} AS outcome, CASE WHEN g.n > 0 AND NOT requires_abstention THEN coalesce(hall, 0) = g.n END AS complete_support, gold_documents > 1 AS multi_source, requires_abstention, status = 'completed' AS answered, latency_ms, retrieval_calls, iterations
    FROM system_rows s JOIN eval_samples e USING (query_id) LEFT JOIN gold_counts g USING (query_id) JOIN fact_f1 f USING (system_name, query_id) JOIN cite_rates c USING (system_name, query_id)
    LEFT JOIN (SELECT mode AS system_name, query_id, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5, count(*) AS h10, count(*) AS hall, min(rank) AS fr, sum(1.0::DOUBLE / log2(rank + 1)) AS dcg
      FROM by_mode JOIN qrels USING (query_id, chunk_id) GROUP BY 1, 2) h USING (system_name, query_id)""", "system_rows", "eval_samples", "gold_counts", "fact_f1", "cite_rates", "by_mode", "qrels")


@register("sample_score_cards", "J10", sql(
    """SELECT system_name, query_id, round(recall_at_1, 6) AS recall_at_1, round(mrr, 6) AS mrr, round(ndcg_at_10, 6) AS ndcg_at_10, round(fact_f1, 6) AS fact_f1, round(citation_precision, 6) AS citation_precision,
        outcome AS abstention_outcome, complete_support, multi_source, answered, latency_ms FROM cards""", "cards"))
def sample_score_cards(spark, folder):
    return fresh_cards(spark, folder).select(
        "system_name", "query_id", "recall_at_1", "mrr", "ndcg_at_10", "fact_f1", "citation_precision", "abstention_outcome", "complete_support", "multi_source", "answered", "latency_ms"
    )


fragment("report", """SELECT system_name, count(*) AS sample_count, avg(recall_at_1) AS r1, avg(recall_at_10) AS r10, avg(mrr) AS mrr, avg(ndcg_at_10) AS ndcg, avg(fact_f1) AS ff1, avg(validity) AS val, avg(citation_precision) AS cp, avg(latency_ms) AS lat,
    avg((outcome LIKE 'true%')::INT) AS acc, avg(answered::INT) AS coverage, avg((outcome = 'false_positive')::INT) FILTER (NOT requires_abstention) AS far, avg(answered::INT) FILTER (requires_abstention) AS uar,
    avg(complete_support::INT) FILTER (multi_source AND complete_support IS NOT NULL) AS mss, count(*) FILTER (outcome = 'execution_failed') AS failed_count, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95, quantile_cont(latency_ms, 0.99) AS p99
    FROM cards GROUP BY system_name""", "cards")


@register("system_report", "J11", sql(
    """SELECT system_name, sample_count, round(r1, 6) AS mean_recall_at_1, round(r10, 6) AS mean_recall_at_10, round(mrr, 6) AS mean_mrr, round(ndcg, 6) AS mean_ndcg_at_10, round(acc, 6) AS abstention_accuracy, round(coverage, 6) AS answer_coverage,
        round(far, 6) AS false_abstention_rate, round(uar, 6) AS unsupported_answer_rate, round(mss, 6) AS multi_source_complete_support_rate, failed_count, round(p50, 6) AS p50_latency_ms, round(p95, 6) AS p95_latency_ms, round(p99, 6) AS p99_latency_ms FROM report""", "report"))
def system_report(spark, folder):
    return scoring.aggregate_cards(cards(spark, folder)).select(
        "system_name", "sample_count", "mean_recall_at_1", "mean_recall_at_10", "mean_mrr", "mean_ndcg_at_10", "abstention_accuracy", "answer_coverage", "false_abstention_rate",
        "unsupported_answer_rate", "multi_source_complete_support_rate", "failed_count", "p50_latency_ms", "p95_latency_ms", "p99_latency_ms",
    )


@register("leaderboard", "J15, A15", sql(
    """SELECT system_name, round(ndcg, 6) AS mean_ndcg_at_10, concat_ws(' | ', system_name, printf('%.3f', r1), printf('%.3f', mrr), printf('%.3f', ndcg), printf('%.3f', ff1), printf('%.3f', val), printf('%.3f', cp), printf('%.3f', acc), printf('%.1f', lat)) AS line FROM report""", "report"))
def leaderboard(spark, folder):
    return scoring.leaderboard(scoring.aggregate_cards(cards(spark, folder)))


# ---------------------------------------------------------------- resampling


def resampling_sql(scores: str, baseline: str, resamples: int, needs: str):
    """The same draws and patterns in SQL. Samples are numbered in md5 order."""
    return sql(
        f"""SELECT o.system_name, o.metric, o.n, round(bm, 6) AS baseline_mean, round(sm, 6) AS system_mean, round(dm, 6) AS difference, round(lo, 6) AS ci_lower, round(hi, 6) AS ci_upper, round(p, 6) AS p_value,
            p < 0.05 AND (lo > 0 OR hi < 0) AS significant FROM (
          SELECT o.*, b.lo, b.hi, CASE WHEN o.n <= 12 THEN t.extreme / t.tried ELSE (t.extreme + 1) / (t.tried + 1) END AS p FROM (
            SELECT system_name, metric, avg(base) AS bm, avg(score) AS sm, avg(d) AS dm, count(*) AS n FROM {scores}_pairs GROUP BY 1, 2) o
          JOIN (SELECT system_name, metric, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (
            SELECT x.r, p.system_name, p.metric, avg(p.d) AS m FROM (SELECT r, CAST('0x' || substr(md5(r || ':' || i || ':42'), 1, 8) AS BIGINT) % n AS j FROM range({resamples}) t(r), (SELECT i, count(*) OVER () AS n FROM {scores}_index)) x
            JOIN {scores}_index ix ON ix.i = x.j JOIN {scores}_pairs p USING (sample_id) GROUP BY ALL) GROUP BY 1, 2) b USING (system_name, metric)
          JOIN (SELECT f.system_name, f.metric, count(*) AS tried, count(*) FILTER (abs(f.m) >= abs(o.dm) - 1e-12) AS extreme FROM (
              SELECT p.system_name, p.metric, k.pat, avg(p.d * (1 - 2 * CASE WHEN n <= 12 THEN (k.pat >> i) & 1 ELSE CAST('0x' || substr(md5('s:' || k.pat || ':' || i || ':42'), 1, 1) AS BIGINT) % 2 END)) AS m
              FROM {scores}_pairs p JOIN {scores}_index USING (sample_id), (SELECT count(*) AS n FROM {scores}_index), LATERAL (SELECT unnest(range(CASE WHEN n <= 12 THEN (1 << n)::BIGINT ELSE {resamples} END)) AS pat) k GROUP BY ALL) f
            JOIN (SELECT system_name, metric, avg(d) AS dm FROM {scores}_pairs GROUP BY 1, 2) o USING (system_name, metric) GROUP BY 1, 2) t USING (system_name, metric)) o""",
        needs + "_pairs", needs + "_index",
    )


def pair_fragments(name: str, scores: str, baseline: str) -> None:
    fragment(f"{name}_pairs", f"""SELECT s.sample_id, s.system_name, s.metric, s.score, b.score AS base, s.score - b.score AS d FROM {scores} s JOIN {scores} b USING (sample_id, metric)
        WHERE s.system_name <> '{baseline}' AND b.system_name = '{baseline}'""", scores)
    fragment(f"{name}_index", f"SELECT sample_id, row_number() OVER (ORDER BY md5(CAST(sample_id AS VARCHAR)), sample_id) - 1 AS i FROM (SELECT DISTINCT sample_id FROM {name}_pairs)", f"{name}_pairs")


fragment("user_scores", """SELECT user_id AS sample_id, event_type AS system_name, unnest(['mean_value', 'max_value']) AS metric, unnest([avg(value), max(value)]) AS score FROM events GROUP BY user_id, event_type""")
pair_fragments("us", "user_scores", "click")
fragment("day_scores", """SELECT dayofweek(ts) AS sample_id, event_type AS system_name, 'mean_value' AS metric, avg(value) AS score FROM events GROUP BY 1, 2""")
pair_fragments("ds", "day_scores", "click")
fragment("card_scores", "SELECT query_id AS sample_id, system_name, unnest(['recall_at_1','mrr','ndcg_at_10','fact_f1','citation_precision','abstention_correct']) AS metric, unnest([recall_at_1, mrr, ndcg_at_10, fact_f1, citation_precision, (outcome LIKE 'true%')::INT::DOUBLE]) AS score FROM cards", "cards")
pair_fragments("cs", "card_scores", "dense")


@register("paired_bootstrap_per_user", "J12, J13", resampling_sql("us", "click", 200, "us"))
def paired_bootstrap_per_user(spark, folder):
    """Per user, mean and highest value of every other event type against clicks (random sign flips)."""
    e = inp.table(spark, folder, "events")
    per = e.groupBy(F.col("user_id").alias("sample_id"), F.col("event_type").alias("system_name")).agg(F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))
    return resampling.paired_tests(per.unpivot(["sample_id", "system_name"], ["mean_value", "max_value"], "metric", "score"), "click", resamples=200)


@register("paired_exact_sign_flip", "J13", resampling_sql("ds", "click", 200, "ds"))
def paired_exact_sign_flip(spark, folder):
    """Seven weekdays: every sign pattern is tried."""
    e = inp.table(spark, folder, "events")
    per = e.groupBy((F.dayofweek("ts") - 1).alias("sample_id"), F.col("event_type").alias("system_name")).agg(F.avg("value").alias("score"))
    return resampling.paired_tests(per.withColumn("metric", F.lit("mean_value")), "click", resamples=200)


@register("systems_against_baseline", "J14", resampling_sql("cs", "dense", 100, "cs"))
def systems_against_baseline(spark, folder):
    return resampling.paired_tests(scoring.paired_metrics(cards(spark, folder)), "dense", resamples=100)


# ---------------------------------------------------------------- datasets


def labelled_samples(spark, folder):
    """Conversation turns as samples of one fact family per conversation, some of them broken."""
    a, b = F.col("conv_id"), F.col("turn")
    rows = inp.table(spark, folder, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("sample_id"), F.when((a % 9 == 4) & (b == 1), " ").otherwise(F.concat(F.lit(" fam-"), a)).alias("fact_family_id"),
        F.when((a % 10 == 3) & (b == 2), "test").when(a % 3 == 0, "dev").when(a % 3 == 1, "val").otherwise("test").alias("split"),
        F.col("role").alias("sample_type"), (b % 5 == 4).alias("requires_abstention"), F.when(a % 4 == 0, F.array(F.lit("c1"))).otherwise(F.array().cast("array<string>")).alias("gold"), "text",
    )
    return rows.unionByName(rows.filter("sample_id like '%:3'"))


fragment("labelled", """SELECT * FROM (SELECT conv_id || ':' || turn AS sample_id, CASE WHEN conv_id % 9 = 4 AND turn = 1 THEN ' ' ELSE ' fam-' || conv_id END AS fact_family_id,
    CASE WHEN conv_id % 10 = 3 AND turn = 2 THEN 'test' ELSE ['dev', 'val', 'test'][conv_id % 3 + 1] END AS split, role AS sample_type, turn % 5 = 4 AS requires_abstention, conv_id % 4 = 0 AS has_gold, text,
    unnest(CASE WHEN turn = 3 THEN [1, 2] WHEN turn > 9 AND turn % 10 = 3 THEN [1] ELSE [1] END) AS copy FROM conversations)""")


@register("dataset_validation", "J1", sql(
    """SELECT sample_id AS entity_id, 'duplicate_sample_id' AS rule FROM labelled GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT sample_id, 'blank_family' FROM labelled WHERE trim(fact_family_id) = ''
       UNION ALL SELECT trim(fact_family_id), 'family_in_several_splits' FROM labelled WHERE trim(fact_family_id) <> '' GROUP BY 1 HAVING count(DISTINCT split) > 1
       UNION ALL SELECT sample_id, 'unanswerable_with_gold' FROM labelled WHERE requires_abstention AND has_gold""", "labelled"))
def dataset_validation(spark, folder):
    return samples.dataset_problems(labelled_samples(spark, folder))


@register("dataset_identity", "J2, J3, J19", sql(
    """SELECT count(*) AS sample_count, (SELECT string_agg(split || '=' || n, ',' ORDER BY split || '=' || n) FROM (SELECT split, count(*) AS n FROM labelled WHERE split <> 'val' GROUP BY 1)) AS split_counts,
        (SELECT string_agg(sample_type || '=' || n, ',' ORDER BY sample_type || '=' || n) FROM (SELECT sample_type, count(*) AS n FROM labelled WHERE split <> 'val' GROUP BY 1)) AS type_counts,
        (SELECT sha256(string_agg(b || ':' || h, ',' ORDER BY b)) FROM (SELECT substr(d, 1, 3) AS b, sha256(string_agg(d || '*' || n, ',' ORDER BY d || '*' || n)) AS h FROM (
           SELECT sha256(sample_id || chr(31) || split || chr(31) || text) AS d, count(*) AS n FROM labelled WHERE split <> 'val' GROUP BY 1) GROUP BY 1)) AS fingerprint
       FROM labelled WHERE split <> 'val'""", "labelled"))
def dataset_identity(spark, folder):
    rows = labelled_samples(spark, folder)
    both = samples.split_of(rows, "dev").unionByName(samples.split_of(rows, "test"))
    return samples.dataset_identity(both, "sample_id", "split", "text")


@register("split_integrity", "J20", sql(
    """SELECT CAST(item_id AS VARCHAR) AS entity_id, rule FROM (SELECT item_id, unnest(list_filter([CASE WHEN item_id % 7 = 1 THEN 'not_declared' END, CASE WHEN item_id % 7 = 2 THEN 'wrong_split_label' END, CASE WHEN item_id % 7 = 3 THEN 'in_several_splits' END,
        CASE WHEN item_id % 7 = 3 THEN 'wrong_split_label' END], lambda r: r IS NOT NULL)) AS rule FROM benchmark)
       UNION ALL SELECT 'x' || item_id, 'no_such_case' FROM benchmark WHERE item_id % 7 = 4"""))
def split_integrity(spark, folder):
    i = F.col("item_id")
    cases = inp.table(spark, folder, "benchmark").select(i.cast("string").alias("case_id"), F.when(i % 2 == 0, "train").otherwise("test").alias("split"), "item_id")
    other = F.when(F.col("split") == "train", "test").otherwise("train")
    declared = cases.filter(i % 7 != 1).select("case_id", F.explode(F.when(i % 7 == 2, F.array(other)).when(i % 7 == 3, F.array("split", other)).otherwise(F.array("split"))).alias("split"))
    extra = cases.filter(i % 7 == 4).select(F.concat(F.lit("x"), "case_id").alias("case_id"), "split")
    declared = declared.unionByName(extra)
    counts = declared.groupBy("split").agg(F.count("*").alias("count"))
    return samples.split_problems(cases.select("case_id", "split"), declared, counts)


@register("latency_distribution", "J17", sql(
    """SELECT event_type, count(*) AS sample_count, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.9), 6) AS p90_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, min(value) AS min_ms, max(value) AS max_ms FROM events GROUP BY 1"""))
def latency_distribution(spark, folder):
    e = inp.table(spark, folder, "events")
    plain = e.groupBy("event_type").agg(F.count("*").alias("sample_count"), F.avg("value").alias("mean_ms"), F.min("value").alias("min_ms"), F.max("value").alias("max_ms"))
    return plain.join(exact_quantiles(e, ["event_type"], "value", {"p50_ms": 0.5, "p90_ms": 0.9, "p95_ms": 0.95}), "event_type")


# ---------------------------------------------------------------- inspection


@register("mode_inspection", "J25", sql(
    """SELECT mode, count(*) AS questions, round(avg(coalesce(h1, 0) / g.n), 6) AS recall_at_1, round(avg(coalesce(h5, 0) / g.n), 6) AS recall_at_5, round(avg(coalesce(h10, 0) / g.n), 6) AS recall_at_10, round(avg(coalesce(1.0::DOUBLE / fr, 0)), 6) AS mrr
       FROM gold_counts g CROSS JOIN (SELECT DISTINCT mode FROM by_mode) LEFT JOIN (SELECT mode, query_id, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 5) AS h5, count(*) AS h10, min(rank) AS fr FROM by_mode JOIN qrels USING (query_id, chunk_id) GROUP BY 1, 2) USING (mode, query_id) GROUP BY mode""", "gold_counts", "by_mode", "qrels"))
def mode_inspection(spark, folder):
    names = F.explode(F.array(*[F.lit(m) for m in ("sparse", "dense", "hybrid", "reranked")]))
    rows = inp.queries(spark, folder).select(names.alias("mode"), "query_id")
    return scoring.mode_summary(metrics.ranking_metrics(rows, by_mode(spark, folder), inp.qrels(spark, folder), ["mode", "query_id"]))


@register("multi_source_support", "J26", sql(
    """SELECT mode, count(*) AS questions, count(*) FILTER (hits > 0) AS any_support, count(*) FILTER (hits = n) AS complete_support, round(sum(hits) / sum(n), 6) AS pooled_recall FROM (
        SELECT m.mode, g.query_id, g.n, (SELECT count(*) FROM by_mode b JOIN qrels USING (query_id, chunk_id) WHERE b.mode = m.mode AND b.query_id = g.query_id AND b.rank <= 5) AS hits
        FROM gold_counts g, (SELECT DISTINCT mode FROM by_mode) m WHERE g.n > 1) GROUP BY mode""", "gold_counts", "by_mode", "qrels"))
def multi_source_support(spark, folder):
    return scoring.multi_source_support(by_mode(spark, folder), inp.qrels(spark, folder))


@register("provenance_completeness", "J27", sql(
    """SELECT mode, count(*) AS results, round(avg((CASE WHEN doc_id % 9 = 0 THEN NULL ELSE document_id END IS NOT NULL)::INT), 6) AS complete_rate FROM by_mode JOIN chunks USING (chunk_id) GROUP BY mode""", "by_mode", "chunks"))
def provenance_completeness(spark, folder):
    c = inp.chunks(spark, folder).select("chunk_id", F.when(F.col("doc_id") % 9 != 0, F.col("document_id")).alias("document_id"), "source_uri")
    return scoring.provenance_rate(by_mode(spark, folder).join(c, "chunk_id"), ["chunk_id", "document_id", "source_uri"])


fragment("gold_ranks", """SELECT query_id, min(rank) FILTER (mode = 'reranked') AS rr, min(rank) FILTER (mode = 'hybrid') AS hr FROM by_mode JOIN qrels USING (query_id, chunk_id) GROUP BY 1""", "by_mode", "qrels")
fragment("queue", """SELECT q.query_id, CASE WHEN g.n IS NULL THEN 'unanswerable_incorrectly_retrieved' WHEN rr <= 1 THEN 'gold_hit_at_1' WHEN rr <= 5 THEN 'gold_hit_at_5' WHEN hr <= 10 THEN 'gold_hit_at_10' ELSE 'gold_not_retrieved' END AS automatic_diagnostic,
    'pending_human_review' AS human_judgment, t.chunk_id AS top_chunk_id FROM bench_queries q LEFT JOIN gold_counts g USING (query_id) LEFT JOIN gold_ranks USING (query_id) LEFT JOIN (SELECT query_id, chunk_id FROM by_mode WHERE mode = 'reranked' AND rank = 1) t USING (query_id)""",
    "bench_queries", "gold_counts", "gold_ranks", "by_mode")


@register("judgment_queue", "J28, J29", sql("SELECT * FROM queue", "queue"))
def judgment_queue(spark, folder):
    return scoring.judgment_queue(inp.queries(spark, folder), by_mode(spark, folder), inp.qrels(spark, folder))


@register("diagnostic_histogram", "J29", sql("SELECT automatic_diagnostic, count(*) AS n FROM queue GROUP BY 1", "queue"))
def diagnostic_histogram(spark, folder):
    q = scoring.judgment_queue(inp.queries(spark, folder), by_mode(spark, folder), inp.qrels(spark, folder))
    return q.groupBy("automatic_diagnostic").agg(F.count("*").alias("n"))


@register("review_sheet", "J30", sql(
    f"""SELECT query_id, mode, rank, chunk_id, title, is_gold, replace(CASE WHEN length(t) > 220 THEN substr(t, 1, 220) || '...' ELSE t END, '|', '\\|') AS excerpt FROM (
        SELECT b.query_id, b.mode, b.rank, b.chunk_id, c.title, g.chunk_id IS NOT NULL AS is_gold, array_to_string({inp.sql_words('c.text')}, ' ') AS t FROM by_mode b JOIN chunks c USING (chunk_id) LEFT JOIN qrels g ON g.query_id = b.query_id AND g.chunk_id = b.chunk_id WHERE b.rank <= 3)""",
    "by_mode", "chunks", "qrels"))
def review_sheet(spark, folder):
    return scoring.review_sheet(by_mode(spark, folder), inp.chunks(spark, folder), inp.qrels(spark, folder))


# ---------------------------------------------------------------- fixture baselines


def case_queries(spark, folder):
    return inp.queries(spark, folder)


_RSTOP = "[" + ",".join(f"'{w}'" for w in samples.RELEVANCE_STOPWORDS) + "]"


def relevance_fragment(name: str, evidence: str) -> None:
    fragment(
        name,
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS rank FROM (
              SELECT q.query_id, e.evidence_id, e.position, list_sum(list_transform(q.w, lambda t: CASE WHEN contains(e.low_title, t) THEN 2 WHEN contains(e.low_text, t) THEN 1 ELSE 0 END))::DOUBLE AS score
              FROM (SELECT query_id, list_filter(list_distinct(regexp_extract_all(lower(query), '[a-z0-9_.\\-]+')), lambda t: length(t) > 1 AND NOT list_contains({_RSTOP}, t)) AS w FROM bench_queries) q CROSS JOIN {evidence} e) WHERE score > 0) WHERE rank <= 6""",
        "bench_queries", evidence,
    )


fragment("local_evidence", "SELECT chunk_id AS evidence_id, title || ' ' || lang AS title, text, lower(title || ' ' || lang) AS low_title, lower(text) AS low_text, doc_id * 100 + ordinal AS position FROM chunks", "chunks")
fragment("web_evidence", "SELECT CAST(page_id AS VARCHAR) AS evidence_id, url AS title, html AS text, lower(url) AS low_title, lower(html) AS low_text, page_id AS position FROM pages")
relevance_fragment("local_hits", "local_evidence")
relevance_fragment("web_hits", "web_evidence")


def local_evidence(spark, folder):
    return inp.chunks(spark, folder).select(
        F.col("chunk_id").alias("evidence_id"), F.concat_ws(" ", "title", "lang").alias("title"), "text", (F.col("doc_id") * 100 + F.col("ordinal")).alias("position")
    )


def web_evidence(spark, folder):
    return inp.table(spark, folder, "pages").select(F.col("page_id").cast("string").alias("evidence_id"), F.col("url").alias("title"), F.col("html").alias("text"), F.col("page_id").alias("position"))


@register("substring_relevance", "C11", sql("SELECT query_id, evidence_id, score, rank FROM local_hits", "local_hits"))
def substring_relevance(spark, folder):
    return samples.substring_relevance(case_queries(spark, folder), local_evidence(spark, folder), 6)


@register("substring_relevance_web", "C11", sql("SELECT query_id, evidence_id, score, rank FROM web_hits", "web_hits"))
def substring_relevance_web(spark, folder):
    return samples.substring_relevance(case_queries(spark, folder), web_evidence(spark, folder), 6)


def case_hits(spark, folder):
    return inp.stored(spark, folder, "case_hits", lambda: fresh_case_hits(spark, folder))


def flat(text):
    return F.regexp_replace(tx.strip(text), rf"[{tx.SPACE}]+", " ")


KEEP = 3  # sentences that compression leaves of an item


def fresh_case_hits(spark, folder):
    """Hits of every retriever a baseline may choose. Compression keeps the best sentences of each hit."""
    asked = case_queries(spark, folder)
    words = asked.select("query_id", F.array_distinct(tx.unicode_words(F.lower("query"))).alias("qw"))
    pages = inp.table(spark, folder, "pages").select(F.col("page_id").cast("string").alias("evidence_id"), F.col("html").alias("text"))
    texts = {"local": local_evidence(spark, folder).select("evidence_id", "text"), "web": pages, "corpus": inp.chunks(spark, folder).select(F.col("chunk_id").alias("evidence_id"), "text")}
    found = {
        "local": samples.substring_relevance(asked, local_evidence(spark, folder), 6), "web": samples.substring_relevance(asked, web_evidence(spark, folder), 6),
        "corpus": inp.run(spark, folder, "sparse").filter("rank <= 6").withColumnRenamed("chunk_id", "evidence_id"),
    }
    out = None
    for name, hits in found.items():
        # A few rows per query are written first; texts are made plain only where they are hits.
        rows = cut_lineage(hits.select("query_id", "evidence_id")).join(texts[name], "evidence_id")
        if name == "web":
            rows = markup.with_visible_text(rows.withColumnRenamed("text", "html"), F.col("html"), "text").drop("html")
        rows = rows.withColumn("text", flat(F.col("text"))).join(words, "query_id")
        short = compression.best_sentences(compression.boundaries_in_row(F.col("text")), F.col("text"), F.col("qw"), KEEP)
        sizes = {"": F.length("text")} | ({"_compressed": F.length(short)} if name != "corpus" else {})
        for suffix, size in sizes.items():
            part = rows.select(F.col("query_id").alias("case_id"), F.lit(name + suffix).alias("retriever"), "evidence_id", size.alias("chars"))
            out = part if out is None else out.unionByName(part)
    return out


def _flat_sql(text: str) -> str:
    return f"regexp_replace({inp.sql_strip(text)}, '[{tx.SPACE}]+', ' ', 'g')"


fragment("hit_texts", f"""SELECT 'local' AS kind, h.query_id, h.evidence_id, {_flat_sql('e.text')} AS text FROM local_hits h JOIN local_evidence e USING (evidence_id)
    UNION ALL SELECT 'web', h.query_id, h.evidence_id, {_flat_sql('p.t')} FROM web_hits h JOIN page_text p ON CAST(p.page_id AS VARCHAR) = h.evidence_id
    UNION ALL SELECT 'corpus', query_id, chunk_id, {_flat_sql('text')} FROM bq_sparse JOIN chunks USING (chunk_id) WHERE rank <= 6""", "local_hits", "local_evidence", "web_hits", "page_text", "bq_sparse", "chunks")
packaging.sentences_fragment("hit_sentences", "hit_texts", "kind, query_id, evidence_id", "text")
fragment("hit_best", f"""SELECT kind, query_id, evidence_id, any_value(n) AS n, string_agg(sentence || CASE WHEN last THEN '' WHEN sep = '' THEN ' ' ELSE sep END, '' ORDER BY idx) AS joined FROM (
    SELECT *, idx = max(idx) OVER (PARTITION BY kind, query_id, evidence_id) AS last FROM (
      SELECT s.*, row_number() OVER (PARTITION BY kind, query_id, evidence_id ORDER BY len(list_filter(regexp_extract_all(lower(sentence), '[{tx.WORD}]+'), lambda w: list_contains(qw, w))) DESC, idx) AS r
      FROM hit_sentences s JOIN (SELECT query_id, list_distinct(regexp_extract_all(lower(query), '[{tx.WORD}]+')) AS qw FROM bench_queries) USING (query_id)) WHERE r <= {KEEP}) GROUP BY ALL""", "hit_sentences", "bench_queries")
fragment("case_hits", f"""SELECT query_id AS case_id, kind AS retriever, evidence_id, length(text) AS chars FROM hit_texts
    UNION ALL SELECT t.query_id, t.kind || '_compressed', t.evidence_id, CASE WHEN b.n IS NULL OR b.n <= {KEEP} THEN length(t.text) ELSE length(b.joined) END FROM hit_texts t LEFT JOIN hit_best b USING (kind, query_id, evidence_id) WHERE t.kind <> 'corpus'""", "hit_texts", "hit_best")

# Fixed coefficients of a learned router over three of the request's features and a constant.
ROUTER = {"blocked": (0.0, 0.0, -2.0, 1.0), "local": (-1.0, 1.0, 0.5, 0.0), "web": (2.0, -2.0, 1.0, -1.5)}


def case_rows(spark, folder):
    """Cases of the benchmark queries: planned by the rules, predicted by the router, labelled by the gold chunks.

    Profile, consent and budgets come from the query id; a case with gold chunks is to be answered locally,
    one without from the web where consent and budget allow it.
    """
    i = F.col("query_id")
    asked = inp.queries(spark, folder).select(i.cast("string").alias("request_id"), "query", i.alias("conv_id"), (i % 5).alias("turn"))
    plans = sourcing.plan_sources(control.shaped_requests(asked), control.source_table(spark))
    open_web = F.col("allow_external_query") & (F.col("max_web_calls") > 0) & (F.col("max_cost") > 0)
    features = F.array(F.col("has_freshness_cue").cast("double"), F.col("has_local_reference_cue").cast("double"), open_web.cast("double"), F.lit(1.0))
    policy = spark.createDataFrame([(k, list(v), 0.0) for k, v in ROUTER.items()], "label string, weights array<double>, intercept double")
    rows = controller.score_policy(plans.withColumn("features", features), policy)
    gold = inp.qrels(spark, folder).select(F.col("query_id").alias("conv_id")).distinct().withColumn("gold", F.lit(True))
    rows = rows.join(gold, "conv_id", "left").withColumn("gold", F.coalesce("gold", F.lit(False)))
    wanted = F.when(F.col("gold"), "local").when(open_web, "web").otherwise("blocked")
    return rows.select(
        F.col("conv_id").alias("case_id"), F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("conv_id") % 3 + 1).cast("int")).alias("split"),
        "max_retrieval_calls", "allow_external_query", "max_web_calls", "max_cost", "plan", F.col("predicted").alias("predicted_route"),
        wanted.alias("expected_route"), F.when(wanted == "web", "web_main").when(wanted == "local", "docs_main").alias("expected_source_id"),
        (wanted != "blocked").alias("expected_answerable"), F.lit(None).cast("string").alias("expected_stop_reason"),
    )


fragment("case_requests", "SELECT CAST(query_id AS VARCHAR) AS request_id, query_id AS conv_id, query_id % 5 AS turn, query FROM bench_queries", "bench_queries")
control.request_fragments("case_", "case_requests")
_x = lambda w: f"({w[0]} * fresh::INT + {w[1]} * localref::INT + {w[2]} * open_budget::INT + {w[3]})"
fragment("case_rows", f"""SELECT *, CASE WHEN zb >= zl AND zb >= zw THEN 'blocked' WHEN zl >= zw THEN 'local' ELSE 'web' END AS predicted, CASE expected WHEN 'web' THEN 'web_main' WHEN 'local' THEN 'docs_main' END AS expected_source
    FROM (SELECT *, {_x(ROUTER['blocked'])} AS zb, {_x(ROUTER['local'])} AS zl, {_x(ROUTER['web'])} AS zw, CASE WHEN gold THEN 'local' WHEN open_budget THEN 'web' ELSE 'blocked' END AS expected FROM (
      SELECT conv_id AS case_id, ['train', 'validation', 'test'][conv_id % 3 + 1] AS split, p_calls > 0 AS calls, allow_external_query AS consent, p_web > 0 AND p_cost > 0 AS paid, fresh, localref,
        allow_external_query AND p_web > 0 AND p_cost > 0 AS open_budget, route, source_id AS src, conv_id IN (SELECT query_id FROM qrels) AS gold,
        CASE WHEN route = 'unknown_source' THEN 'source_unavailable' WHEN route = 'blocked' THEN CASE split_part(reasons, ',', 1) WHEN 'invalid_profile' THEN 'unsupported_profile' WHEN 'external_query_not_allowed' THEN 'unsupported_profile'
          WHEN 'local_source_unavailable' THEN 'source_unavailable' WHEN 'web_source_unavailable' THEN 'source_unavailable' ELSE 'budget_exceeded' END END AS plan_stop FROM case_planned))""", "case_planned", "qrels")
fragment("base_choice", """SELECT case_id, split, b, CASE WHEN stop IS NULL THEN r ELSE 'blocked' END AS route, CASE WHEN stop IS NULL THEN s END AS source_id, stop, CASE WHEN stop IS NULL THEN rt END AS retriever FROM (
    SELECT case_id, split, 'no_retrieval' AS b, 'no_retrieval' AS r, NULL AS s, NULL AS stop, NULL AS rt FROM case_rows
    UNION ALL SELECT case_id, split, 'fixed_local', 'local', 'docs_main', CASE WHEN NOT calls THEN 'budget_exceeded' END, 'local' FROM case_rows
    UNION ALL SELECT case_id, split, 'fixed_web', 'web', 'web_main', CASE WHEN NOT consent THEN 'unsupported_profile' WHEN NOT paid THEN 'budget_exceeded' END, 'web' FROM case_rows
    UNION ALL SELECT case_id, split, 'heuristic_planner', route, src, plan_stop, CASE WHEN route = 'web' THEN 'web' ELSE 'local' END FROM case_rows
    UNION ALL SELECT case_id, split, 'heuristic_plus_compression', route, src, plan_stop, CASE WHEN route = 'web' THEN 'web_compressed' ELSE 'local_compressed' END FROM case_rows
    UNION ALL SELECT case_id, split, 'learned_planner', CASE WHEN predicted = 'web' THEN 'web' ELSE 'local' END, CASE WHEN predicted = 'web' THEN 'web_main' ELSE 'docs_main' END, CASE WHEN predicted = 'blocked' THEN 'unsupported_profile' WHEN predicted = 'web' THEN CASE WHEN NOT consent THEN 'unsupported_profile' WHEN NOT paid THEN 'budget_exceeded' END WHEN NOT calls THEN 'budget_exceeded' END, CASE WHEN predicted = 'web' THEN 'web' ELSE 'local' END FROM case_rows
    UNION ALL SELECT case_id, split, 'corpus_adapter', route, src, plan_stop, CASE WHEN route = 'web' THEN 'web' ELSE 'corpus' END FROM case_rows)""", "case_rows")
fragment("base_results", """SELECT c.case_id, c.split, c.b AS baseline_name, c.route, c.source_id, coalesce(h.n, 0) AS evidence_count, coalesce(h.chars, 0)::BIGINT AS context_characters, coalesce(h.toks, 0)::BIGINT AS estimated_tokens,
    coalesce(c.stop, CASE WHEN h.n > 0 THEN 'success' ELSE 'no_evidence' END) AS stop_reason, (c.retriever IS NOT NULL)::INT::BIGINT AS retrieval_calls, (c.route = 'web')::INT::BIGINT AS web_calls, ((c.route = 'web')::INT * 800)::BIGINT AS cost, h.least_id
    FROM base_choice c LEFT JOIN (SELECT case_id, retriever, count(*) AS n, sum(chars) AS chars, sum(ceil(chars / 4.0)) AS toks, min(trim(evidence_id)) AS least_id FROM case_hits GROUP BY 1, 2) h USING (case_id, retriever)""", "base_choice", "case_hits")


def baselines(spark, folder):
    return baseline_results(case_rows(spark, folder), case_hits(spark, folder), local_source="docs_main", web_source="web_main", web_cost=800)


@register("baseline_results", "J23", sql("SELECT * EXCLUDE (least_id) FROM base_results", "base_results"))
def baselines_query(spark, folder):
    return baselines(spark, folder).drop("evidence_ids", "citations_valid", "provenance_preserved")


fragment("expected_evidence", "SELECT query_id AS case_id, chunk_id AS evidence_id FROM qrels", "qrels")


def expected_evidence(spark, folder):
    return inp.qrels(spark, folder).select(F.col("query_id").alias("case_id"), F.col("chunk_id").alias("evidence_id"))


fragment("base_recall", """SELECT c.case_id, c.b AS baseline_name, CASE WHEN g.n IS NULL THEN 1 ELSE round(coalesce(h.n, 0) / g.n, 4) END AS evidence_recall FROM base_choice c LEFT JOIN (SELECT case_id, count(*) AS n FROM expected_evidence GROUP BY 1) g USING (case_id)
    LEFT JOIN (SELECT case_id, retriever, count(*) AS n FROM case_hits JOIN expected_evidence USING (case_id, evidence_id) GROUP BY 1, 2) h USING (case_id, retriever)""", "base_choice", "expected_evidence", "case_hits")


@register("baseline_evidence_recall", "J21", sql("SELECT * FROM base_recall", "base_recall"))
def baseline_evidence_recall(spark, folder):
    rows = baselines(spark, folder)
    hits = rows.select("case_id", "baseline_name", F.explode_outer("evidence_ids").alias("evidence_id")).filter("evidence_id is not null")
    return metrics.evidence_recall(rows, hits, expected_evidence(spark, folder), ["case_id", "baseline_name"])


def flagged(spark, folder):
    """Baseline rows with their evidence recall, beside their cases."""
    rows = baselines(spark, folder).join(baseline_evidence_recall(spark, folder), ["case_id", "baseline_name"])
    cases = case_rows(spark, folder).select("case_id", "expected_route", "expected_source_id", "expected_answerable", "expected_stop_reason")
    return samples.case_flags(rows, cases)


@register("fixture_metrics", "J18", sql(
    """SELECT baseline_name, coalesce(split, 'overall') AS split, count(*) AS case_count, round(avg((route = er)::INT), 6) AS route_accuracy, round(avg((source_id IS NOT DISTINCT FROM es)::INT), 6) AS source_accuracy, round(avg(evidence_recall), 6) AS evidence_recall,
        round(avg(((stop_reason = 'success' AND evidence_count > 0) = ea)::INT), 6) AS answerability, round(avg((CASE WHEN er = 'blocked' THEN route = 'blocked' AND stop_reason = coalesce(esr, stop_reason) ELSE true END)::INT), 6) AS blocked_correctness,
        round(avg((CASE WHEN er = 'blocked' THEN route = 'blocked' AND stop_reason = coalesce(esr, stop_reason) ELSE route <> 'blocked' END)::INT), 6) AS blocked_correctness_strict, sum(retrieval_calls)::BIGINT AS retrieval_calls, sum(web_calls)::BIGINT AS web_calls, sum(cost)::BIGINT AS cost,
        round(avg(context_characters), 6) AS avg_characters, round(avg((coalesce(least_id, 'none') <> '')::INT), 6) AS citation_rate, round(avg((evidence_count = 0 OR source_id IS NOT NULL)::INT), 6) AS provenance_rate
       FROM (SELECT b.*, r.evidence_recall, c.expected AS er, c.expected_source AS es, c.expected <> 'blocked' AS ea, NULL AS esr FROM base_results b JOIN case_rows c USING (case_id) JOIN base_recall r USING (case_id, baseline_name))
       GROUP BY GROUPING SETS ((baseline_name, split), (baseline_name))""", "base_results", "case_rows", "base_recall"))
def fixture_metrics(spark, folder):
    return samples.fixture_metrics(flagged(spark, folder))


@register("fixture_stop_reasons", "J18", sql("SELECT baseline_name, split, stop_reason, count(*) AS n FROM base_results GROUP BY ALL", "base_results"))
def fixture_stop_reasons(spark, folder):
    return samples.stop_reasons(baselines(spark, folder))


@register("determinism_digest", "J19", sql(
    """SELECT sha256(string_agg(b || ':' || h, ',' ORDER BY b)) AS fingerprint FROM (SELECT substr(d, 1, 3) AS b, sha256(string_agg(d || '*' || n, ',' ORDER BY d || '*' || n)) AS h FROM (
        SELECT sha256(baseline_name || chr(31) || case_id || chr(31) || route || chr(31) || stop_reason || chr(31) || context_characters) AS d, count(*) AS n FROM base_results GROUP BY 1) GROUP BY 1)""", "base_results"))
def determinism_digest(spark, folder):
    return samples.determinism_digest(baselines(spark, folder), "baseline_name", "case_id", "route", "stop_reason", "context_characters", "duration_ms")


fragment("gate_before", "SELECT query_id AS case_id, chunk_id AS evidence_id, length(text) AS chars FROM pkg_evidence", "pkg_evidence")
fragment("gate_after", "SELECT query_id AS case_id, chunk_id AS evidence_id, CASE WHEN untouched THEN length(text) ELSE length(kept) END AS chars FROM pkg_held WHERE held", "pkg_held")


@register("compression_gate", "J24", sql(
    """SELECT count(*) AS eligible, count(k.case_id) AS preserved, CASE WHEN count(*) > 0 THEN round(count(k.case_id) / count(*), 4) ELSE 1 END AS support_rate,
        ((SELECT sum(chars) FROM gate_before) - (SELECT sum(chars) FROM gate_after))::DOUBLE AS chars_removed,
        round(((SELECT sum(chars) FROM gate_before) - (SELECT sum(chars) FROM gate_after)) / (SELECT sum(chars) FROM gate_before) * 100, 2) AS reduction_pct, count(*) = count(k.case_id) AS gate_open
       FROM (SELECT DISTINCT case_id FROM gate_before JOIN expected_evidence USING (case_id, evidence_id)) h LEFT JOIN (SELECT DISTINCT case_id FROM gate_after JOIN expected_evidence USING (case_id, evidence_id)) k USING (case_id)""",
    "gate_before", "gate_after", "expected_evidence"))
def compression_gate(spark, folder):
    """What the compressed packages keep of the packages' evidence."""
    packages = cut_lineage(packaging.compressed(spark, folder).select("query_id", "evidence", "compressed"))  # read several times
    items = lambda c: packages.select(F.col("query_id").alias("case_id"), F.explode(c).alias("e")).select(
        "case_id", F.col("e.chunk_id").alias("evidence_id"), F.length("e.excerpt").alias("chars"))
    return samples.compression_gate(items("evidence"), items("compressed"), expected_evidence(spark, folder))


@register("evidence_flags", "J22", sql(
    """SELECT query_id, query_id % 4 <> 1 AS citations_valid, query_id % 4 <> 2 AS provenance_preserved FROM (SELECT DISTINCT query_id FROM bq_hybrid)""", "bq_hybrid"))
def evidence_flags(spark, folder):
    m = F.col("query_id") % 4
    e = F.struct(
        F.when((m == 1) & (F.col("rank") == 2), " ").otherwise(F.concat(F.lit("C"), "rank")).alias("citation_id"), F.lit("docs").alias("source_id"), F.col("chunk_id").alias("document_id"),
        F.when((m == 2) & (F.col("rank") == 3), "web_search_snippet").otherwise("local_document").alias("source_kind"), F.lit(None).cast("string").alias("canonical_url"),
    )
    rows = inp.hybrid_top(spark, folder).groupBy("query_id").agg(F.collect_list(e).alias("e"))
    return rows.select("query_id", samples.citations_ok(F.col("e")).alias("citations_valid"), samples.provenance_ok(F.col("e")).alias("provenance_preserved"))
