"""Ingest queries over documents and pages, and the streaming jobs over files of the same tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citeloom.functions.checks import violations
from citeloom.operators import chunking, ingest, markup
from citeloom.queries import inputs as inp
from citeloom.queries import service
from citeloom.queries.base import fragment, register, sql
from citeloom.session import checkpoint_root
from citeloom.sources import files, tables
from citeloom.streaming import jobs


def raw_sources(spark, folder):
    """Documents as files: text and Markdown by turns, with CRLF, a byte order mark, bad types and empty files."""
    i = F.col("doc_id")
    ext = F.when(i % 10 == 3, ".md").when(i % 25 == 7, ".pdf").when(i % 25 == 8, ".TXT").otherwise(".txt")
    head = F.when(i % 10 == 3, F.concat(F.lit("# Heading "), i, F.lit(" ##\r\n\r\n"))).when(i % 7 == 1, "﻿").otherwise("")
    body = F.when(i % 40 == 9, " \n").when(i % 40 == 10, None).otherwise(F.concat(head, "text"))
    return inp.table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("file://data/raw/"), "source", F.lit("/"), i, ext).alias("source_uri"),
        F.when(i % 50 == 11, 20_000_000).otherwise(F.octet_length("text")).cast("long").alias("byte_size"), body.alias("content"),
    )


_ext = "CASE WHEN doc_id % 10 = 3 THEN '.md' WHEN doc_id % 25 = 7 THEN '.pdf' WHEN doc_id % 25 = 8 THEN '.TXT' ELSE '.txt' END"
fragment("raw_sources", f"""SELECT doc_id, 'file://data/raw/' || source || '/' || doc_id || {_ext} AS source_uri, CASE WHEN doc_id % 50 = 11 THEN 20000000 ELSE strlen(text) END AS byte_size,
    CASE WHEN doc_id % 10 = 3 THEN 'markdown' WHEN doc_id % 25 = 7 THEN NULL ELSE 'text' END AS source_type,
    CASE WHEN doc_id % 40 = 9 THEN ' ' || chr(10) WHEN doc_id % 40 = 10 THEN NULL ELSE CASE WHEN doc_id % 10 = 3 THEN '# Heading ' || doc_id || ' ##' || chr(10) || chr(10) ELSE '' END || regexp_replace(text, '\\r\\n?', chr(10), 'g') END AS raw FROM documents""")
fragment("ingested", f"""SELECT *, CASE WHEN source_type IS NULL THEN 'unsupported_source' WHEN byte_size > 10000000 THEN 'source_too_large' WHEN raw IS NULL THEN 'invalid_encoding' WHEN {inp.sql_strip('raw')} = '' THEN 'empty_source' END AS code FROM raw_sources""", "raw_sources")


@register("ingested_documents", "A3, A4, B10", sql(
    f"""SELECT source_uri, sha256(source_uri || ':' || sha256(raw)) AS document_id, CASE WHEN source_type = 'markdown' THEN 'Heading ' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS title, source_type, sha256(raw) AS content_sha256, length({inp.sql_strip('raw')}) AS chars FROM ingested WHERE code IS NULL""", "ingested"))
def ingested_documents(spark, folder):
    docs, _ = ingest.prepare(raw_sources(spark, folder))
    return docs.select("source_uri", "document_id", "title", "source_type", "content_sha256", F.length("text").alias("chars"))


@register("ingest_failures", "A2, B10", sql("SELECT source_uri, code FROM ingested WHERE code IS NOT NULL", "ingested"))
def ingest_failures(spark, folder):
    return ingest.prepare(raw_sources(spark, folder))[1]


# ---------------------------------------------------------------- chunk rules in SQL

# Fixed value: a heading line.
_HEAD = r"^\s{0,3}(#{1,6})[ \t]+(.+?)(?:[ \t]+#+)?[ \t]*\n?$"


def window_fragment(name: str, docs: str) -> None:
    """Strict word windows of ``docs`` (document_id, text)."""
    fragment(name, f"""SELECT document_id, ordinal, text, start_char, start_char + length(text) AS end_char, words AS token_estimate, '' AS heading_path,
            sha256(document_id || ':' || ordinal || ':' || text) AS chunk_id
        FROM (SELECT document_id, i AS ordinal, regexp_replace(array_to_string(p[i*540+1 : i*540+600], ''), '[{inp.WS}]+$', '') AS text,
                CASE WHEN i = 0 THEN 0 ELSE length(array_to_string(p[1 : i*540], '')) END AS start_char, len(p[i*540+1 : i*540+600]) AS words
            FROM (SELECT *, unnest(range(CAST(greatest(1, ceil((len(p) - 60) / 540.0)) AS BIGINT))) AS i
                FROM (SELECT document_id, regexp_extract_all(text, '[^{inp.WS}]+[{inp.WS}]*') AS p FROM {docs})))""", docs)


def paragraph_fragments(p: str, docs: str) -> None:
    """Paragraph-aware chunks of ``docs`` (document_id, stripped text): the fold is a recursion over the parts."""
    marked = f"regexp_replace(text, '([^{inp.WS}])(\\n[{inp.WS}]*\\n[{inp.WS}]*)', '\\1\\2' || chr(6), 'g')"
    marked = f"regexp_replace({marked}, '(^|\\x06)([^{inp.WS}][{inp.WS}]*)\\x06', '\\1\\2', 'g')"
    fragment(f"{p}_cut", f"""SELECT document_id, j, r, array_to_string(w[r*540+1 : r*540+540], '') AS t, len(w[r*540+1 : r*540+540]) AS n
        FROM (SELECT document_id, j, regexp_extract_all(par, '[^{inp.WS}]+[{inp.WS}]*') AS w
            FROM (SELECT document_id, pars, unnest(range(1, len(pars) + 1)) AS j, unnest(pars) AS par FROM (SELECT document_id, string_split({marked}, chr(6)) AS pars FROM {docs}))),
            range(CAST(ceil(len(w) / 540.0) AS BIGINT)) AS u(r)""", docs)
    fragment(f"{p}_parts", f"""SELECT document_id, list(n ORDER BY j, r) AS w, list_prepend(0, list(c ORDER BY j, r)) AS c, list_prepend(0, list(e ORDER BY j, r)) AS e, list(t ORDER BY j, r) AS t
        FROM (SELECT *, sum(n) OVER o AS c, sum(length(t)) OVER o AS e FROM {p}_cut WINDOW o AS (PARTITION BY document_id ORDER BY j, r)) GROUP BY document_id""", f"{p}_cut")
    tail = lambda first, last: f"greatest({first}, len(list_filter(c, lambda x: x <= c[{last} + 1] - 60)))"
    fragment(f"{p}_walk", f"""SELECT document_id, w, c, 0 AS i, 1::BIGINT AS first, NULL::BIGINT AS a, NULL::BIGINT AS b FROM {p}_parts
        UNION ALL
        SELECT document_id, w, c, i, CASE WHEN b IS NOT NULL THEN {tail('b', 'i')} ELSE f1 END AS first, a, b FROM (
            SELECT document_id, w, c, i, f1, a, CASE WHEN c[i + 1] - c[f1] >= 500 THEN f1 END AS b FROM (
                SELECT document_id, w, c, i + 1 AS i, CASE WHEN a IS NOT NULL THEN {tail('a', 'i')} ELSE first END AS f1, a FROM (
                    SELECT *, CASE WHEN first < i + 1 AND c[i + 1] - c[first] + w[i + 1] > 600 THEN first END AS a FROM (SELECT * EXCLUDE (a, b) FROM {p}_walk WHERE i < len(w)))))""", f"{p}_parts")
    fragment(f"{p}_groups", f"""SELECT document_id, i, 1 AS o, a AS x, i - 1 AS y FROM {p}_walk WHERE a IS NOT NULL UNION ALL SELECT document_id, i, 2, b, i FROM {p}_walk WHERE b IS NOT NULL
        UNION ALL SELECT document_id, i, 3, first, i FROM {p}_walk WHERE i = len(w) AND first <= i AND b IS DISTINCT FROM first""", f"{p}_walk")
    fragment(f"{p}_chunks", f"""SELECT *, start_char + length(text) AS end_char, sha256(document_id || ':' || ordinal || ':' || text) AS chunk_id, len({inp.sql_words('text')}) AS token_estimate
        FROM (SELECT g.document_id, row_number() OVER (PARTITION BY g.document_id ORDER BY i, o) - 1 AS ordinal, e[x] AS start_char,
            regexp_replace(array_to_string(t[x : y], ''), '[{inp.WS}]+$', '') AS text FROM {p}_groups g JOIN {p}_parts p USING (document_id))""", f"{p}_groups", f"{p}_parts")


def markdown_fragments(p: str, docs: str) -> None:
    """Structure-aware chunks of ``docs`` (document_id, stripped text), whose texts hold no fences."""
    blank = f"{inp.sql_strip('line')} = ''"
    fragment(f"{p}_lines", f"""SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "at",
            length(regexp_extract(line, '{_HEAD}', 1)) AS level, {inp.sql_strip(f"regexp_extract(line, '{_HEAD}', 2)")} AS name, {blank} AS blank
        FROM (SELECT document_id, i, l[i] || CASE WHEN i < len(l) THEN chr(10) ELSE '' END AS line FROM (SELECT document_id, string_split(text, chr(10)) AS l FROM {docs}), range(1, len(l) + 1) AS u(i))""", docs)
    last = ", ".join(f"last_value(CASE WHEN level = {k} THEN name END IGNORE NULLS) OVER up AS n{k}, max(CASE WHEN level = {k} THEN i END) OVER up AS h{k}" for k in range(1, 7))
    fragment(f"{p}_marked", f"""SELECT *, sum(CASE WHEN level = 0 AND (i = 1 OR blank OR before > 0) THEN 1 ELSE 0 END) OVER up AS block FROM (
            SELECT *, lag(level) OVER (PARTITION BY document_id ORDER BY i) AS before, {last} FROM {p}_lines WINDOW up AS (PARTITION BY document_id ORDER BY i))
        WINDOW up AS (PARTITION BY document_id ORDER BY i)""", f"{p}_lines")
    names = ", ".join(f"CASE WHEN h{k} > coalesce(greatest({', '.join(['0', *(f'h{j}' for j in range(1, k))])}), 0) THEN {{'d': {k}, 'n': n{k}}} END" for k in range(1, 7))
    fragment(f"{p}_blocks", f"""SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY block) AS p FROM (
            SELECT document_id, block, min("at") AS s, max("at" + length(line)) AS e, len({inp.sql_words("string_agg(line, '' ORDER BY i)")}) AS n,
                arg_min(list_filter([{names}], lambda x: x IS NOT NULL), i) AS heads FROM {p}_marked WHERE level = 0 GROUP BY document_id, block) WHERE n > 0""", f"{p}_marked")
    fragment(f"{p}_walk", f"""SELECT document_id, list(n ORDER BY p) AS w, 0::BIGINT AS i, 0::BIGINT AS g, 601::BIGINT AS total FROM {p}_blocks GROUP BY document_id
        UNION ALL SELECT document_id, w, i + 1, CASE WHEN total + w[i + 1] > 600 THEN g + 1 ELSE g END, CASE WHEN total + w[i + 1] > 600 THEN w[i + 1] ELSE total + w[i + 1] END FROM {p}_walk WHERE i < len(w)""", f"{p}_blocks")
    fragment(f"{p}_grouped", f"""SELECT b.*, g, coalesce(sum(n) OVER (PARTITION BY document_id, g ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 60 AS tail
        FROM {p}_blocks b JOIN {p}_walk w USING (document_id) WHERE w.i = b.p""", f"{p}_blocks", f"{p}_walk")
    fragment(f"{p}_spans", f"""SELECT o.document_id, o.g - 1 AS ordinal, coalesce(t.s, o.s) AS s, o.e, o.heads, coalesce(t.n, 0) AS overlap_words
        FROM (SELECT document_id, g, min(s) AS s, max(e) AS e, arg_min(heads, p) AS heads FROM {p}_grouped GROUP BY document_id, g) o
        LEFT JOIN (SELECT document_id, g + 1 AS g, min(s) AS s, sum(n) AS n FROM {p}_grouped WHERE tail GROUP BY document_id, g) t USING (document_id, g)""", f"{p}_grouped")
    titles = "list_transform(heads, lambda h: repeat('#', h.d) || ' ' || h.n)"
    prefix = f"CASE WHEN len(heads) > 0 AND NOT starts_with(regexp_replace(source, '^[{inp.WS}]+', ''), {titles}[-1]) THEN array_to_string(list_transform({titles}, lambda t: t || chr(10) || chr(10)), '') ELSE '' END"
    fragment(f"{p}_chunks", f"""SELECT *, sha256(document_id || ':' || ordinal || ':' || text) AS chunk_id, greatest(1, word_count) AS token_estimate FROM (
            SELECT document_id, ordinal, s AS start_char, e AS end_char, overlap_words, array_to_string(list_transform(heads, lambda h: h.n), ' > ') AS heading_path,
                len({inp.sql_words('source')}) AS word_count, {prefix} || source AS text
            FROM (SELECT s.*, substr(d.text, s.s::BIGINT + 1, (s.e - s.s)::BIGINT) AS source FROM {p}_spans s JOIN {docs} d USING (document_id)))""", f"{p}_spans", docs)


fragment("ingested_docs", f"SELECT source_type, source_uri, sha256(source_uri || ':' || sha256(raw)) AS document_id, {inp.sql_strip('raw')} AS text FROM ingested WHERE code IS NULL", "ingested")
fragment("ingested_plain", "SELECT * FROM ingested_docs WHERE source_type = 'text'", "ingested_docs")
fragment("ingested_marked", "SELECT * FROM ingested_docs WHERE source_type = 'markdown'", "ingested_docs")
window_fragment("plain_chunks", "ingested_plain")
markdown_fragments("md", "ingested_marked")
_by_type = ", ".join(("document_id", "ordinal", "chunk_id", "token_estimate", "heading_path", "start_char", "end_char"))
fragment("chunks_by_type", f"SELECT {_by_type} FROM plain_chunks UNION ALL SELECT {_by_type} FROM md_chunks", "plain_chunks", "md_chunks")


@register("ingest_run_counts", "A7, B10", sql(
    """SELECT 'run-1' AS run_id, (SELECT count(*) FROM ingested_docs) AS document_count, (SELECT count(*) FROM chunks_by_type) AS chunk_count, f AS failed_count, CASE WHEN f > 0 THEN 'failed' ELSE 'completed' END AS status
       FROM (SELECT count(*) AS f FROM ingested WHERE code IS NOT NULL)""", "ingested", "ingested_docs", "chunks_by_type"))
def ingest_run_counts(spark, folder):
    docs, failures = ingest.prepare(raw_sources(spark, folder))
    run, _ = ingest.manifest("run-1", docs, ingest.chunk_documents(docs), failures)
    return run


@register("ingest_chunks_by_type", "B2, B3, B4, B5, B10", sql("SELECT * FROM chunks_by_type", "chunks_by_type"))
def ingest_chunks_by_type(spark, folder):
    """Text by words and Markdown by structure, dispatched on the source type."""
    docs, _ = ingest.prepare(raw_sources(spark, folder))
    out = ingest.chunk_documents(docs)
    return out.select("document_id", "ordinal", "chunk_id", "token_estimate", "heading_path", "start_char", "end_char")


_tag = r"(?:[\s/][^>]*)?>"
_hidden = "|".join(rf"<{t}{_tag}.*?(?:</{t}\s*>|\z)" for t in markup.HIDDEN)
_marks = "regexp_replace(html, '(?s)<!--.*?-->|<[!?][^>]*>', '', 'g')"
_marks = f"regexp_replace({_marks}, '(?is){_hidden}', '', 'g')"
for _level in range(1, 7):
    _marks = f"regexp_replace({_marks}, '(?is)<h{_level}{_tag}', chr(10) || chr(10) || '{'#' * _level} ', 'g')"
_marks = f"regexp_replace({_marks}, '(?is)<li{_tag}', chr(10) || '- ', 'g')"
_blocks = "|".join(markup.BLOCKS)
_marks = f"regexp_replace({_marks}, '(?is)<(?:{_blocks}){_tag}|</(?:{_blocks}|h[^\\s/>]*)(?:[\\s/][^>]*)?>', chr(10) || chr(10), 'g')"
_marks = f"regexp_replace({_marks}, '(?is)</?[a-z][^>]*>', '', 'g')"
for _ref, _char in (("&quot;", '"'), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;?", "&")):
    _marks = f"regexp_replace({_marks}, '{_ref}', '{_char}', 'g')"
# The pages hold no preformatted blocks, no element hidden in another one, and no other character references.
fragment("page_text", f"""SELECT page_id, {inp.sql_strip("regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS t
    FROM (SELECT page_id, {_marks} AS t FROM pages)""")


@register("html_to_text", "B1", sql("SELECT page_id, length(t) AS chars, sha256(t) AS digest FROM page_text", "page_text"))
def html_to_text(spark, folder):
    t = markup.with_visible_text(inp.table(spark, folder, "pages").select("page_id", "html"), F.col("html"), "t")
    return t.select("page_id", F.length("t").alias("chars"), F.sha2("t", 256).alias("digest"))


fragment("page_docs", "SELECT CAST(page_id AS VARCHAR) AS document_id, t AS text FROM page_text", "page_text")
markdown_fragments("page", "page_docs")


@register("html_structure_chunks", "B1, B2, B3, B4, B5", sql(
    "SELECT document_id, ordinal, chunk_id, heading_path, word_count, overlap_words, start_char, end_char FROM page_chunks", "page_chunks"))
def html_structure_chunks(spark, folder):
    pages = inp.table(spark, folder, "pages").select(F.col("page_id").cast("string").alias("document_id"), "html")
    pages = markup.with_visible_text(pages, F.col("html"), "text")
    return chunking.markdown_chunks(pages).select("document_id", "ordinal", "chunk_id", "heading_path", "word_count", "overlap_words", "start_char", "end_char")


@register("word_window_chunks", "B6, B7, B9", sql(
    "SELECT document_id, ordinal, chunk_id, start_char, end_char, token_estimate, CASE WHEN ordinal = 0 THEN 0 ELSE least(60, token_estimate) END AS overlap_words FROM chunks", "chunks"))
def word_window_chunks(spark, folder):
    return inp.fresh_chunks(spark, folder).select("document_id", "ordinal", "chunk_id", "start_char", "end_char", "token_estimate", "overlap_words")


paragraph_fragments("para", "docs")
_paragraph = "SELECT document_id, ordinal, chunk_id, start_char, end_char, token_estimate FROM {}"


@register("paragraph_chunks", "B6, B7, B8", sql(_paragraph.format("para_chunks"), "para_chunks"))
def paragraph_chunks(spark, folder):
    return chunking.paragraph_chunks(inp.docs(spark, folder)).select("document_id", "ordinal", "chunk_id", "start_char", "end_char", "token_estimate")


fragment("spaced_docs", "SELECT document_id, regexp_replace(text, '\\n', chr(10) || ' ' || chr(10), 'g') AS text FROM docs", "docs")
paragraph_fragments("line", "spaced_docs")


@register("line_paragraph_chunks", "B6, B7, B8", sql(_paragraph.format("line_chunks"), "line_chunks"))
def line_paragraph_chunks(spark, folder):
    """Documents whose every line is a paragraph, so that groups and overlaps are made of many parts."""
    spaced = inp.docs(spark, folder).select("document_id", F.regexp_replace("text", "\n", "\n \n").alias("text"))
    return chunking.paragraph_chunks(spaced).select("document_id", "ordinal", "chunk_id", "start_char", "end_char", "token_estimate")


@register("write_dispositions", "A5", sql(
    """SELECT document_id, CASE WHEN doc_id % 3 = 2 THEN 'created' WHEN doc_id % 3 = 0 THEN 'unchanged' WHEN doc_id % 2 = 0 THEN 'overwritten' ELSE 'conflict' END AS disposition FROM docs""", "docs"))
def write_dispositions(spark, folder):
    new = inp.docs(spark, folder).select("doc_id", "document_id", F.sha2("text", 256).alias("payload_hash"))
    old = new.filter("doc_id % 3 <> 2").select("document_id", F.when(F.col("doc_id") % 3 == 0, F.col("payload_hash")).otherwise("other").alias("payload_hash"))
    return ingest.dispositions(new, old, overwrite=F.col("doc_id") % 2 == 0).select("document_id", "disposition")


@register("run_identity_problems", "B11", sql(
    """SELECT source_uri AS entity_id, 'duplicate_source' AS rule, 2 AS copies FROM docs WHERE doc_id % 9 = 2 UNION ALL SELECT document_id, 'duplicate_document', 2 FROM docs WHERE doc_id % 9 = 2
       UNION ALL SELECT chunk_id, 'duplicate_chunk', 2 FROM chunks WHERE ordinal = 2""", "docs", "chunks"))
def run_identity_problems(spark, folder):
    d, c = inp.docs(spark, folder), inp.chunks(spark, folder)
    return ingest.identity_problems(d.unionByName(d.filter("doc_id % 9 = 2")), c.unionByName(c.filter("ordinal = 2")))


@register("manifest_problems", "B12", sql(
    """SELECT run_id AS entity_id, unnest(list_filter([CASE WHEN m = 1 THEN 'bad_run_id' END, CASE WHEN m = 2 THEN 'completed_before_start' END, CASE WHEN m = 3 THEN 'completed_without_time' END, CASE WHEN m = 4 THEN 'failed_without_failure' END,
        CASE WHEN m = 5 THEN 'completed_with_failure' END, CASE WHEN m = 6 THEN 'document_count' END, CASE WHEN m = 7 THEN 'chunk_count' END], lambda r: r IS NOT NULL)) AS rule
       FROM (SELECT CASE WHEN conv_id % 8 = 1 THEN '.run' ELSE 'run' END || conv_id AS run_id, conv_id % 8 AS m FROM (SELECT DISTINCT conv_id FROM conversations))"""))
def manifest_problems(spark, folder):
    """Every conversation as an ingest run whose turns are its sources."""
    c = inp.table(spark, folder, "conversations")
    m = F.col("conv_id") % 8
    name = F.concat(F.when(m == 1, ".run").otherwise("run"), "conv_id")
    sources = c.select(name.alias("run_id"), (F.col("turn") + 1).alias("chunk_count"))
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp")
    runs = c.groupBy("conv_id").agg(F.count("*").alias("d"), F.sum(F.col("turn") + 1).alias("k")).select(
        name.alias("run_id"), F.when(m == 4, "failed").otherwise("completed").alias("status"), t0.alias("started_at"),
        F.when(m == 2, t0 - F.expr("interval 1 hour")).when(m != 3, t0 + F.expr("interval 1 hour")).alias("completed_at"),
        (F.col("d") + (m == 6).cast("int")).alias("document_count"), (F.col("k") + (m == 7).cast("int")).alias("chunk_count"), (m == 5).cast("int").alias("failures"), F.lit(0).alias("warnings"),
    )
    return ingest.manifest_problems(runs, sources)


@register("artifact_integrity", "B13", sql(
    """SELECT chunk_id AS entity_id, 'orphan_chunk' AS rule FROM chunks WHERE doc_id % 10 = 1 UNION ALL SELECT chunk_id, 'outside_text' FROM chunks WHERE doc_id % 10 = 2 AND ordinal = (SELECT max(ordinal) FROM chunks x WHERE x.document_id = chunks.document_id)
       UNION ALL SELECT document_id || ':' || ordinal, 'repeated_position' FROM chunks WHERE ordinal = 1""", "chunks"))
def artifact_integrity(spark, folder):
    d = inp.docs(spark, folder).filter("doc_id % 10 <> 1")
    c = inp.chunks(spark, folder)
    last = c.groupBy("document_id").agg(F.max("ordinal").alias("last"))
    c = c.join(last, "document_id").withColumn("end_char", F.col("end_char") + F.when((F.col("doc_id") % 10 == 2) & (F.col("ordinal") == F.col("last")), 5).otherwise(0))
    again = c.filter("ordinal = 1").withColumns({"chunk_id": F.concat("chunk_id", F.lit("-again"))})
    found = ingest.artifact_problems(d, c.unionByName(again))
    return found.filter(~F.col("entity_id").endswith("-again"))


@register("unordered_offsets", "B13", sql(
    """SELECT chunk_id AS entity_id, 'unordered_offsets' AS rule FROM (SELECT *, lag(s) OVER (PARTITION BY document_id ORDER BY ordinal) AS b FROM (SELECT *, CASE WHEN ordinal % 4 = 2 THEN start_char - 9000 ELSE start_char END AS s FROM chunks)) WHERE s < b""", "chunks"))
def unordered_offsets(spark, folder):
    c = inp.chunks(spark, folder).withColumn("start_char", F.when(F.col("ordinal") % 4 == 2, F.col("start_char") - 9000).otherwise(F.col("start_char")))
    return ingest.unordered_offsets(c)


@register("record_contracts", "B14", sql(
    """SELECT document_id AS entity_id, unnest(list_filter([CASE WHEN doc_id % 6 = 1 THEN 'blank_title' END, CASE WHEN doc_id % 6 = 2 THEN 'bad_hash' END, CASE WHEN doc_id % 6 = 3 THEN 'negative_size' END], lambda r: r IS NOT NULL)) AS rule FROM docs
       UNION ALL SELECT chunk_id, unnest(CASE WHEN doc_id % 6 = 4 THEN ['end_before_start'] WHEN doc_id % 6 = 5 THEN ['no_tokens'] ELSE [] END) FROM chunks""", "docs", "chunks"))
def record_contracts(spark, folder):
    m = F.col("doc_id") % 6
    d = inp.docs(spark, folder).withColumns({
        "title": F.when(m == 1, "  ").otherwise(F.col("title")), "content_sha256": F.when(m == 2, "xyz").otherwise(F.col("content_sha256")), "byte_size": F.when(m == 3, -1).otherwise(1),
    })
    c = inp.chunks(spark, folder).withColumns({
        "end_char": F.when(m == 4, F.col("start_char") - 1).otherwise(F.col("end_char")), "token_estimate": F.when(m == 5, 0).otherwise(F.col("token_estimate")),
    })
    c = c.withColumn("end_char", F.when((m == 4) & (F.col("start_char") == 0), 0).otherwise(F.col("end_char"))).withColumn("start_char", F.when(m == 4, F.col("start_char") + 1).otherwise(F.col("start_char")))
    return violations(d, F.col("document_id"), ingest.document_rules()).unionByName(violations(c, F.col("chunk_id"), ingest.chunk_rules()))


@register("chunk_summary", "A14", sql(
    """SELECT document_id, count(*) AS chunk_count, string_agg(ordinal || ':' || chunk_id || ':' || substr(text, 1, 300), '|' ORDER BY ordinal) AS listing FROM chunks GROUP BY document_id""", "chunks"))
def chunk_summary(spark, folder):
    s = ingest.chunk_summary(inp.chunks(spark, folder))
    line = F.array_join(F.transform("chunks", lambda c: F.concat_ws(":", c["ordinal"].cast("string"), c["chunk_id"], c["snippet"])), "|")
    return s.select("document_id", "chunk_count", line.alias("listing"))


@register("file_hash_check", "A12, A13", sql(
    """SELECT 'f' || doc_id AS entity_id, CASE WHEN doc_id % 8 = 1 THEN 'missing' WHEN doc_id % 8 = 2 THEN 'undeclared' ELSE 'hash_mismatch' END AS rule FROM documents WHERE doc_id % 8 IN (1, 2, 3)"""))
def file_hash_check(spark, folder):
    i = F.col("doc_id") % 8
    base = inp.table(spark, folder, "documents").select(F.concat(F.lit("f"), "doc_id").alias("name"), F.col("text").cast("binary").alias("content"), i.alias("m"), F.sha2(markup.unix_lines(F.col("text")), 256).alias("h"))
    declared = base.filter("m <> 2").select("name", F.when(F.col("m") == 3, "0").otherwise(F.upper("h")).alias("sha256"))
    return files.hash_problems(base.filter("m <> 1"), declared, normalise_lines=True)


@register("case_files", "A10, A11", sql(
    """SELECT CAST(item_id AS VARCHAR) AS case_id, text AS query, CASE WHEN item_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, item_id % 3 = 0 AS allow_external_query FROM benchmark"""))
def case_files(spark, folder):
    """Write the questions as JSON lines and read them back with the declared schema."""
    i = F.col("item_id")
    path = f"{checkpoint_root(spark)}/cases-{uuid.uuid4().hex}"
    inp.table(spark, folder, "benchmark").select(
        i.cast("string").alias("case_id"), F.col("text").alias("query"), F.when(i % 2 == 0, "train").otherwise("test").alias("split"), (i % 3 == 0).alias("allow_external_query")
    ).write.json(path)
    return files.read_cases(spark, path).select("case_id", "query", "split", "allow_external_query")


@register("guarded_paths", "A1", sql(
    """SELECT doc_id, ['/data/raw/' || source || '/' || doc_id || '.txt', NULL][1 + (code IS NOT NULL)::INT] AS resolved, code FROM (SELECT doc_id, source,
        CASE doc_id % 8 WHEN 1 THEN 'outside_root' WHEN 2 THEN 'outside_root' WHEN 3 THEN 'outside_root' WHEN 4 THEN 'missing' WHEN 5 THEN 'unsupported_source' END AS code FROM documents)"""))
def guarded_paths(spark, folder):
    """Requested paths, some of which climb out of the root, name nothing, or name a file of another type."""
    i, m = F.col("doc_id"), F.col("doc_id") % 8
    docs = inp.table(spark, folder, "documents").select("doc_id", "source")
    name = F.concat(i.cast("string"), F.when(m == 5, ".pdf").otherwise(".txt"))
    listing = docs.select(F.concat(F.lit("file:///data/raw/"), "source", F.lit("/"), name).alias("path"))
    path = (
        F.when(m == 1, F.concat(F.lit("../"), name)).when(m == 2, F.concat(F.lit("/data/raw/../raws/"), name)).when(m == 3, F.concat(F.lit("a/../../../../../../"), name))
        .when(m == 4, F.concat("source", F.lit("/none/"), name)).when(m == 6, F.concat(F.lit("file:///data//raw/./"), "source", F.lit("/x/../"), name)).otherwise(F.concat("source", F.lit("/"), name))
    )
    good, bad = files.guarded_paths(docs.select("doc_id", path.alias("path")), listing, "/data/raw")
    paths = docs.select("doc_id", path.alias("path"))
    return good.select("doc_id", "resolved", F.lit(None).cast("string").alias("code")).unionByName(paths.join(bad, "path").select("doc_id", F.lit(None).cast("string").alias("resolved"), "code"))


@register("artifact_reads", "A6", sql(
    """SELECT document_id, CASE doc_id % 9 WHEN 1 THEN 'artifact_invalid' WHEN 2 THEN 'artifact_invalid' WHEN 3 THEN 'artifact_not_found' WHEN 4 THEN 'artifact_invalid' ELSE 'read' END AS code,
        CASE doc_id % 9 WHEN 1 THEN 'malformed' WHEN 2 THEN 'bad_hash' WHEN 4 THEN 'blank_title' ELSE '' END AS detail FROM docs""", "docs"))
def artifact_reads(spark, folder):
    """Stored documents read back: torn lines, broken records and documents that were never written become issues."""
    m = F.col("doc_id") % 9
    docs = inp.docs(spark, folder).withColumn("byte_size", F.octet_length("text").cast("long"))
    stored = docs.filter(m != 3).withColumns({"content_sha256": F.when(m == 2, "xyz").otherwise(F.col("content_sha256")), "title": F.when(m == 4, " ").otherwise(F.col("title"))})
    fields = [c.split()[0] for c in tables.ARTIFACT_SCHEMA.split(", ")]
    line = F.to_json(F.struct(*fields))
    path = f"{checkpoint_root(spark)}/artifacts-{uuid.uuid4().hex}"
    stored.select(F.when(m == 1, F.substr(line, F.lit(1), F.length(line) - 9)).otherwise(line).alias("value")).write.text(path)
    good, issues = tables.read_artifacts(spark, path, docs.select("document_id"))
    return good.select("document_id", F.lit("read").alias("code"), F.lit("").alias("detail")).unionByName(issues)


# ---------------------------------------------------------------- streaming


def _paths(spark, name):
    root = f"{checkpoint_root(spark)}/stream-{name}-{uuid.uuid4().hex}"
    return f"{root}/table", f"{root}/checkpoint"


def document_stream(spark, folder):
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    raw = jobs.table_stream(spark, folder, "documents.parquet", schema)
    return inp.as_documents(raw)


@register("stream_ingest", "S1", sql("SELECT document_id, ordinal, chunk_id FROM chunks", "chunks"))
def stream_ingest(spark, folder):
    return jobs.ingest_stream(document_stream(spark, folder), *_paths(spark, "ingest")).select("document_id", "ordinal", "chunk_id")


def run_stream(spark, folder):
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    runs = service.as_runs(jobs.table_stream(spark, folder, "events.parquet", schema))
    return runs.withColumn("ts", F.col("ts").cast("timestamp"))


def plain_times(df, *columns):
    """Back to the time type of the table."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


_windows = "SELECT {start} AS window_start, status, count(*) AS n, round(avg(latency_ms), 6) AS average_latency_ms, max(latency_ms) AS max_latency_ms FROM run_rows GROUP BY ALL"


@register("hourly_metrics", "S2", sql(_windows.format(start="date_trunc('hour', ts)"), "run_rows"))
def hourly_metrics(spark, folder):
    return jobs.windowed_metrics(service.run_rows(spark, folder)).drop("window_end", "p95_approx")


@register("sliding_metrics", "S2", sql(
    """SELECT time_bucket(INTERVAL 15 minutes, ts) - to_minutes(15 * k) AS window_start, status, count(*) AS n, round(avg(latency_ms), 6) AS average_latency_ms, max(latency_ms) AS max_latency_ms FROM run_rows, range(4) t(k) GROUP BY ALL""", "run_rows"))
def sliding_metrics(spark, folder):
    return jobs.windowed_metrics(service.run_rows(spark, folder), slide="15 minutes").drop("window_end", "p95_approx")


@register("stream_hourly_metrics", "S2", sql(
    "SELECT * FROM (" + _windows.format(start="date_trunc('hour', ts)") + ") WHERE window_start + INTERVAL 1 hour <= (SELECT max(ts) FROM run_rows) - INTERVAL 10 minutes", "run_rows"))
def stream_hourly_metrics(spark, folder):
    """Windows the watermark has closed."""
    return jobs.run_to_table(jobs.windowed_metrics(run_stream(spark, folder)), *_paths(spark, "metrics")).drop("window_end", "p95_approx").transform(plain_times, "window_start")


fragment("repeat_keys", """SELECT sha256(user_id || ':' || action || ':' || status) AS cache_key, list({'t': ts, 'r': run_id} ORDER BY ts, run_id) AS l FROM run_rows GROUP BY ALL""", "run_rows", stored=True)
fragment("repeat_walk", """SELECT cache_key, l, l[1] AS x FROM repeat_keys
    UNION ALL SELECT * FROM (SELECT cache_key, l, list_filter(l, lambda y: y.t >= x.t + INTERVAL 300 seconds)[1] AS x FROM repeat_walk) WHERE x IS NOT NULL""", "repeat_keys")


@register("stream_repeat_suppression", "S3", sql("SELECT cache_key, x.r AS run_id, x.t AS ts FROM repeat_walk", "repeat_walk"))
def stream_repeat_suppression(spark, folder):
    """Requests that no answer of the last five minutes serves; a chain of times per key in SQL."""
    keyed = jobs.cache_key(run_stream(spark, folder), "user_id", "action", "status")
    return jobs.run_to_table(jobs.suppress_repeats(keyed), *_paths(spark, "repeats")).transform(plain_times, "ts")


fragment("session_rows", """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 5 minutes AS session_end, count(*) AS events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, run_id) AS s FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, run_id) <= INTERVAL 5 minutes THEN 0 ELSE 1 END AS fresh FROM run_rows)) GROUP BY user_id, s""", "run_rows")


@register("user_sessions", "S4", sql("SELECT * FROM session_rows", "session_rows"))
def user_sessions(spark, folder):
    return jobs.user_sessions(service.run_rows(spark, folder))


@register("stream_user_sessions", "S4", sql(
    "SELECT * FROM session_rows WHERE session_end <= (SELECT max(ts) FROM run_rows) - INTERVAL 10 minutes", "session_rows"))
def stream_user_sessions(spark, folder):
    """Sessions the watermark has closed."""
    return jobs.run_to_table(jobs.user_sessions(run_stream(spark, folder)), *_paths(spark, "sessions")).transform(plain_times, "session_start", "session_end")


@register("stream_last_handles", "S4", sql(
    "SELECT user_id, place, run_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, run_id DESC) AS place FROM run_rows) WHERE place <= 3", "run_rows"))
def stream_last_handles(spark, folder):
    return jobs.run_to_latest(jobs.last_handles(run_stream(spark, folder)), "user_id", *_paths(spark, "handles"))
