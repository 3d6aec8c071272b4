"""Chunk rules on hand-made documents, and the word windows against a plain loop."""

import hashlib
import random
import re

import pytest

from citeloom.operators import chunking as ch
from citeloom.operators.markup import with_visible_text


def docs(spark, *texts):
    rows = [(f"d{i}", "T", "u", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "document_id string, title string, source_uri string, text string")


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_word_windows_match_a_plain_loop(spark):
    texts = [words(10), words(600), words(601), "a\n b\t\tc", words(1700).replace(" w100 ", "\n\nw100  ")]
    got = {(r.document_id, r.ordinal): r for r in ch.word_windows(docs(spark, *texts)).collect()}
    want = {}
    for i, text in enumerate(texts):
        pieces = [m.span() for m in re.finditer(r"\S+", text)]
        count = max(1, -(-(len(pieces) - 60) // 540))
        for k in range(count):
            part = pieces[k * 540 : k * 540 + 600]
            want[(f"d{i}", k)] = (part[0][0], part[-1][1], text[part[0][0] : part[-1][1]], len(part))
    assert {k: (r.start_char, r.end_char, r.text, r.token_estimate) for k, r in got.items()} == want
    for (doc, ordinal), r in got.items():
        assert r.chunk_id == hashlib.sha256(f"{doc}:{ordinal}:{r.text}".encode()).hexdigest()


def test_paragraph_rule_keeps_every_word(spark):
    rows = ch.paragraph_chunks(docs(spark, words(713))).orderBy("ordinal").collect()
    assert set(" ".join(r.text for r in rows).split()) == set(words(713).split())
    sizes = [r.token_estimate for r in ch.paragraph_chunks(docs(spark, words(700))).orderBy("ordinal").collect()]
    assert sizes == [540, 540, 700, 160]


def test_markdown_headings_code_and_overlap(spark):
    simple = ch.markdown_chunks(docs(spark, "# Retrieval\n\n## Sparse\n\nBM25 finds exact terms.\n")).collect()
    assert len(simple) == 1 and simple[0].heading_path == "Retrieval > Sparse"
    assert simple[0].text.startswith("# Retrieval\n\n## Sparse\n\n")
    code = ch.markdown_chunks(docs(spark, "# A\n\n```python\n# not a heading\n```\n")).collect()[0]
    assert code.code_languages == ["python"] and code.heading_path == "A" and not code.unclosed_fence
    two = ch.markdown_chunks(docs(spark, words(400, "a") + "\n\n" + words(300, "b"))).orderBy("ordinal").collect()
    assert len(two) == 2 and two[1].overlap_words >= 50
    open_fence = ch.markdown_chunks(docs(spark, "~~~\n" + words(700) + "\n")).collect()[0]
    assert open_fence.unclosed_fence and open_fence.oversized and open_fence.oversized_reason == "fenced_code_block"


def test_html_becomes_markdown_like_text(spark):
    html = (
        "<head><title>x</title></head><h2>Use &amp; care</h2><p>One</p><ul><li>a</li><li>b</li></ul><script>no()</script>"
        "<pre><code class='big language-py'>x ~~~ y\n</code></pre><div>end  </div>\n\n\n\n"
    )
    df = spark.createDataFrame([(html,)], "html string")
    got = with_visible_text(df, df.html, "t").head().t
    assert got == "## Use & care\n\nOne\n\n- a\n- b\n\n~~~~py\nx ~~~ y\n~~~~\n\nend"


def test_control_characters_of_a_text_are_no_marks(spark):
    text = "a\x06b " + words(400, "w") + "\n\n\x06 " + words(300, "v") + "\n\nend \x06\x05\x06 last"
    plain = text.replace("\x06", "x")
    got, want = (ch.paragraph_chunks(docs(spark, t)).orderBy("ordinal").collect() for t in (text, plain))
    place = lambda rows: [(r.ordinal, r.start_char, r.end_char) for r in rows]
    assert place(got) == place(want) and got[-1].end_char == len(text)
    assert all(r.text == text[r.start_char : r.end_char] for r in got)


def test_sizes_are_checked():
    with pytest.raises(ValueError):
        ch.ChunkSizes(target=100)
    with pytest.raises(ValueError):
        ch.ChunkSizes(overlap=90)


def test_long_documents_cost_what_they_hold(spark):
    """Every block of a long document is read a fixed number of times: twice the blocks, about twice the work."""
    from time import perf_counter

    def seconds(rule, blocks):
        text = "\n\n".join(("# H\n\n" if i % 50 == 0 else "") + words(20) for i in range(blocks))
        df = docs(spark, text)
        start = perf_counter()
        found = rule(df).selectExpr("max(end_char) AS e", "count(*) AS n").first()
        assert found.e == len(text) and found.n >= blocks * 20 / 660
        return perf_counter() - start

    for rule in (ch.markdown_chunks, ch.paragraph_chunks):
        seconds(rule, 100)
        small, large = seconds(rule, 12_000), seconds(rule, 24_000)
        assert large < 2.6 * small + 2


def test_groups_against_a_plain_restatement():
    sizes = ch.ChunkSizes()
    rng = random.Random(7)
    for _ in range(300):
        sized = [rng.choice([1, 5, 30, 70, 200, 400, 540]) for _ in range(rng.randrange(1, 30))]
        groups = ch.paragraph_groups(sized, sizes)
        assert groups[0][0] == 0 and groups[-1][1] == len(sized) - 1
        for (a, b), (c, d) in zip(groups, groups[1:]):
            lead = sized[c : b + 1]
            assert a <= c <= b + 1 and b <= d and (sum(lead) >= sizes.overlap or c == a)
            assert sum(lead[1:]) < sizes.overlap
        for (_, before), (a, b) in zip([(0, -1), *groups], groups):
            assert sum(sized[a:b]) < sizes.target or b <= before + 1  # a long lead alone closes nothing


def test_starts_are_running_sums(spark):
    lengths = list(range(1, 1000))
    df = spark.createDataFrame([(lengths,), ([5],)], "x array<int>")
    got = [r.s for r in df.select(ch._starts(ch.F.col("x"), ch.F.lit(3)).alias("s")).collect()]
    assert got == [[3 + sum(lengths[:i]) for i in range(len(lengths))], [3]]


def test_blank_documents_have_no_chunks(spark):
    df = docs(spark, "", "# only a heading", "\n\n")
    assert ch.paragraph_chunks(df.filter("text <> '# only a heading'")).count() == 0 and ch.markdown_chunks(df).count() == 0


def visible(spark, *pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    return [r.t for r in with_visible_text(df, df.html, "t").orderBy("i").collect()]


def test_hidden_elements_nest_to_any_depth(spark):
    nested = "<template>" * 6 + "no" + "</template>" * 6
    mixed = "<noscript><template>a</noscript>b</template>after"
    got = visible(
        spark, f"<p>before</p>{nested}<p>after</p>", mixed, "x<template>never closed <p>y", "</template></head>shown", "<template/>kept<script/>too<br/>end",
        "<script>if (a < b) { '</p>' }</script>s<style>p{}</style><!-- <template> -->t", None, "")
    assert got == ["before\n\nafter", "after", "x", "shown", "kepttoo\n\nend", "st", None, ""]


def test_preformatted_blocks_nest_and_skip_hidden_parts(spark):
    got = visible(
        spark, "a<pre>one<template>no</template> two</pre>b", "<pre>lost<pre>inner</pre>outer</pre>", "<pre></pre>x", "t<pre>open to the end", "<pre><code class='language-py'>a &lt; b</code></pre>")
    assert got == ["a\n\n~~~\none two\n~~~\nb", "~~~\ninner\n~~~\n\n~~~\nouter\n~~~", "x", "t", "~~~py\na < b\n~~~"]


def test_references_are_those_of_html(spark):
    import html

    texts = ["a &amp; b &copy &notit; &#65;&#x1F600; &bogus; &;&", "&amp;amp; &lt;p&gt; not a tag", "no references", "&NotEqualTilde;&#0;&#xD800;"]
    assert visible(spark, *texts) == [html.unescape(t) for t in texts]


def test_a_large_page_costs_what_it_holds(spark):
    page = "".join(f"<div><p>word{i} &amp; more</p><template><template>x</template></template></div>" for i in range(20_000))
    got = visible(spark, page)[0]
    assert got.startswith("word0 & more\n\nword1 & more") and got.count("\n\n") == 19_999


def test_word_windows_cut_each_text_once(spark):
    docs = spark.createDataFrame([("d", "T", "u", " ".join(f"w{i}" for i in range(1300)))], "document_id string, title string, source_uri string, text string")
    plan = ch.word_windows(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(text#") == 1 and "{1,540}+" in plan  # strides, not a list of all words


def test_paragraph_chunks_are_cut_in_one_go(spark):
    """One function cuts a text; its pieces are those of the rule, spelled out as a lazy pattern."""
    def pieces(text, limit):
        found = []
        for p in re.findall(r"(\S(?:(?s:.*?)\S)?(?=\n\s*\n|\Z)\s*)", text.rstrip()):
            w = re.findall(r"\S+\s*", p)
            found += [("".join(w[i : i + limit]), len(w[i : i + limit])) for i in range(0, len(w), limit)]
        return found

    gaps = [" ", "  ", "\n", "\n\n", "\n \n", " \n\n", "\n\t\n\n", "\r\n", "\n\r\n", "\x85", "　", "\n \n", "​"]
    rng = random.Random(2)
    texts = ["".join(rng.choice(gaps[: 3 + i % 11]) + rng.choice(["a", "b", "word", "\U0001f600", "x-y", "\x06"]) for _ in range(i % 50)) for i in range(400)]
    texts = ["", " \n", "a", "a\n\nb", "\n\na\n\nb c\n\n", *texts, *(t + " " for t in texts[::9])]
    for limit in (1, 2, 7, 540):
        for text in texts:
            starts, counted = ch.paragraph_runs(text, limit)
            runs = [text[i:j] for i, j in zip(starts, starts[1:])]
            assert list(zip(runs, counted)) == pieces(text, limit), (text, limit)
    assert sum(ch.paragraph_runs("w " * 200_000 + "\n\n" * 50_000 + "end", 540)[1]) == 200_001
    long = [words(1300), words(30) + "\n\n" + words(700, "b") + "\n \nz\n\n" + words(90, "c") + " "]
    df = docs(spark, *long, "", None)
    chunks = ch.paragraph_chunks(df)
    assert {r.document_id for r in chunks.collect()} == {"d0", "d1"}
    for r in chunks.collect():
        text = long[int(r.document_id[1:])]
        assert r.text == text[r.start_char : r.end_char] and r.token_estimate == len(r.text.split())
        assert r.chunk_id == hashlib.sha256(f"{r.document_id}:{r.ordinal}:{r.text}".encode()).hexdigest()
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan
