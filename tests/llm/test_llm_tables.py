"""Packing, vector search, page text and the pipeline."""

import os
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from tallywright.llm import html_text, packing, queries, threshold_search, tokens  # noqa: E402

AWKWARD = [(1, None), (2, ""), (3, "  \n"), (4, "Some words, some <|endoftext|> 42!"), (4, "Some words, some <|endoftext|> 42!"), (None, "no id"), (5, "long " * 5000), (6, "été 中文 \U0001f600é")]


def encoded(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer())
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def packed_well(rows, capacity):
    """No gaps, no overlaps, every capacity kept; the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for seats in by.values():
        end = 0
        for offset, length in sorted(seats):
            assert offset == end
            end += length
        size = np.array([n for _, n in seats], float)
        assert (np.array([size.sum(), len(size), (size**2).sum()]) <= capacity.vector()).all()
    return len(by)


def test_pieces_are_the_tokenizers(spark):
    docs = spark.createDataFrame(AWKWARD, "doc_id bigint, text string").withColumn("length", F.lit(1))
    got = packing.pack(docs, queries.tokenizer()).collect()
    want = {}
    for (d, _), ids in zip(AWKWARD, encoded([t for _, t in AWKWARD]), strict=True):
        for i in range(-(-len(ids) // 2048)):
            part = ids[i * 2048:(i + 1) * 2048]
            want[d, i] = (i * 2048, part, zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["ids"], r["ids_crc32"]) for r in got} == want
    assert len(got) == len(want) + 1
    packed_well(got, packing.Capacity())
    assert packing.pack(docs.limit(0), queries.tokenizer()).count() == 0
    whole = packing.sequences(packing.pack(docs, queries.tokenizer())).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(len(r["ids"]) for r in got)


@pytest.mark.parametrize("cached", [0, 8, 10**6])
def test_more_distinct_words_than_the_cache_holds(cached):
    words = tokens.Words(queries.tokenizer(), cached)
    odd = ["Don't stop, it's l'été: «oui», (no)!? 3.14% a_b-c", "ÉTÉ×3 x÷y é. É! où?! 中文。", "<|endoftext|>, <|ENDOFTEXT|> word<|endoftext|>. a<b <", "ROCK'N'ROLL's, 'tis; don't. we'LL!", "e\u0301 cafe\u0301! ＡＢ １２, \u212a \u0130 ſ", "a...b!!c (d) [e] {f} ~g~ `h` ^i"]
    texts = [*odd, *(o.swapcase() for o in odd), "warm up text", " ".join(f"word{i} up" for i in range(40)), "text of word3", "warm " + " ".join(f"other{i}" for i in range(9))]
    texts *= 2
    for group in ([t] for t in texts), (texts[:2], texts[2:]):
        for some in group:
            raw = [t.encode() for t in some]
            ids, at = words.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [x[:-1] for x in encoded(some)]


def test_packing_of_table(spark, sf_dir):
    got = queries.op4_vector_packing(spark, sf_dir).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    ids = encoded([t for _, t in docs])
    assert sum(r["length"] for r in got) == sum(map(len, ids))
    assert packed_well(got, packing.Capacity()) <= -(-sum(map(len, ids)) // 2048) * 1.01 + 1


@pytest.mark.parametrize("measure", ["norm", "dot"])
def test_capacities_hold(spark, measure):
    rng = np.random.default_rng(2)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 101, 3000))]
    cut = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    capacity = packing.Capacity(tokens=100, documents=3, attention=6000, weights=(1.0, 0.5, 0.5), measure=measure)
    with pytest.raises(ValueError, match="fits no empty bin"):
        packing.plan({100: 1}, capacity)
    cut = cut.where("length <= 77")
    got = packing.place(cut, capacity).collect()
    assert len(got) == cut.count()
    packed_well(got, capacity)


def test_top_k_of_table(spark, sf_dir):
    vectors = [(r["vec_id"], np.floor(64 * np.array(r["embedding"], float))) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {}
    for r in queries.op5_threshold_search(spark, sf_dir).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for i, q in vectors:
        if i % 20 == 0:
            best = sorted((-int(q @ v), j) for j, v in vectors if j != i)[:20]
            want[i] = [(n, j, -s) for n, (s, j) in enumerate(best, 1)]
    assert {q: sorted(x) for q, x in got.items()} == want


def test_top_k_awkward(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 64]) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(300, 420)]  # one very common vector: ties
    odd = [(500, None), (501, [0.1, None, 0.2, 0.3]), (502, [float("nan"), 0.0, 0.0, 0.0]), (503, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.1] * 4), (504, []), (505, [0.25])]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("block", F.lit(2))
    used = rows + [(504, [0.0] * 4), (505, [0.25, 0.0, 0.0, 0.0])]
    want = {}
    for i, q in used:
        if i % 50 == 0:
            best = sorted((-int(np.floor(64 * np.array(q)) @ np.floor(64 * np.array(v))), j) for j, v in used if j != i)[:7]
            want[i] = [(n, j, -s) for n, (s, j) in enumerate(best, 1)]
    for size in (8192, 60):
        monkeypatch.setattr(threshold_search, "CANDIDATE_ROWS", size)
        got = {}
        for r in threshold_search.top_k(table, F.col("vec_id") % 50 == 0, 7).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert {q: sorted(x) for q, x in got.items()} == want
    assert threshold_search.top_k(table.limit(0), F.col("vec_id") % 50 == 0, 7).count() == 0
    few = threshold_search.top_k(table.where("vec_id < 3"), F.col("vec_id") == 0, 7)
    assert few.count() == 2


PAGES = {
    "<div class='main'><h1>Head</h1><p>aa <a href=q>l</a><br>k</p><p>bb&nbsp;c &lt;3</p></div><div id='comments'><p>c1 said much</p></div>": "Head\n\naa l k\n\nbb c <3",
    "<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p><b>one<br><p>two &amp three</article><footer>&copy; me</footer>": "T\n\none\n\ntwo & three",
    "<ul><li>a<li>b</ul>": "a\n\nb", "plain & text": "plain & text", "": "", "<p>x": "x",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a\n\nb\n\nc",
    "<body><header>top</header><main><p>body text here</p><aside>side</aside><form><input>send</form><div class='cookie-notice'>we use</div></main><script>var a='<p>no</p>'</script><style>p{}</style><!-- c -->": "body text here",
    "<article><p>read this</p><section class=comments><p>first!</p></section></article>": "read this",
    "<![bad[x]]><p>hey": "<![bad[x]]>\n\nhey",
}


def test_page_text(spark):
    for html, text in PAGES.items():
        assert html_text.extract(html) == text
    rows = [(i, f"u{i}", h) for i, h in enumerate([*PAGES, None, "<div>" * 3000 + "deep"])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("n_chars", F.lit("clash"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_pages(pages.union(pages)).collect()}
    assert got == {i: (t, len(t)) for i, t in enumerate([*PAGES.values(), "", "deep"])}
    assert html_text.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["container has-sidebar", "no-sidebar", "with-ads", "page no-comments", "sidebar", "layout sidebar-right", "widget"])
def test_page_in_a_wrapper_with_a_marking_name(name):
    long = "Some sentences of the article that go on for a while."
    for attribute in ("class", "id"):
        for body in (f"<article><h2>T</h2><p>{long}</p></article>", f"<main><h2>T</h2><p>{long}</p></main>", f"<div><h1>T</h1><p>{long}</p></div>", f"<h2>T</h2><p>{long}</p>"):
            assert html_text.extract(f"<body><div {attribute}='{name}'>{body}<div class='sidebar'>aside</div></div></body>") == f"T\n\n{long}"
        assert html_text.extract(f"<body><div {attribute}='{name}'>{long}</div></body>") == long


def test_page_anchors_are_no_marks():
    page = "<article><h2 id='related-work'>Related</h2><p id='notice-period'>Two months.</p><section id='market-share'><h3 id='share'>Share</h3><p>A third.</p></section>{}</article>"
    text = "Related\n\nTwo months.\n\nShare\n\nA third."
    assert html_text.extract(page.format("")) == text
    for gone in ("<div class='social-share'>s</div>", "<section id='comments'><p>c</p></section>", "<div class='author-newsletter'>n</div>", "<div id='cookie-notice'>c</div>", "<article class='comment even'>c</article>"):
        assert html_text.extract(page.format(gone)) == text
    for stays in ("<article class='post comment-open'>c</article>", "<article class='no-comment'>c</article>"):
        assert html_text.extract(page.format(stays)) == text + "\n\nc"
    short, chat = "<p>A short article.</p>", "<p>A comment that says much more.</p>" * 20
    assert html_text.extract(f"<body><article>{short}</article><div class='comments'>{chat}</div></body>") == "A short article."
    assert html_text.extract(f"<body><main><article>{short}</article><div class='related'><article>Teaser</article></div></main></body>") == "A short article."


def test_page_density_prefers_text_over_links():
    links = "".join(f"<p><a href=x{i}>some linked words {i}</a></p>" for i in range(30))
    prose = "".join(f"<p>Sentence number {i} says something at some length, as prose does.</p>" for i in range(6))
    got = html_text.extract(f"<body><div><div>{links}</div><div>{prose}</div></div></body>")
    assert got.count("Sentence number") == 6 and "linked words" not in got


def test_pages_of_table(spark, sf_dir):
    got = queries.op6_html_text(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) and "track(" not in r["text"] and "©" not in r["text"] for r in got)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    extra = [(9000, None, "en", "x", 0), (9001, " .. ", None, None, None), (None, "no id here", "en", "x", 10)]
    table = docs.union(spark.createDataFrame(extra, docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "best_fit_packing"]
    kept = stages["language_id"](spark, table, sf_dir)
    assert kept.columns == docs.columns and kept.count() == len(texts) + 1
    cut = brute.line_cuts(texts)
    lines = {r["doc_id"]: r["text"] for r in stages["line_dedup"](spark, docs, sf_dir).collect()}
    assert lines == {d: t for d, t in cut.items() if t.split() or t == dict(texts)[d]}
    roots = brute.shingle_components(texts, 5, 80)
    near = stages["near_duplicates"](spark, table.union(docs.limit(1)), sf_dir)
    assert near.columns == docs.columns
    assert sorted(r["doc_id"] for r in near.collect() if r["doc_id"] is not None and r["doc_id"] < 9000) == [d for d in sorted(roots) if roots[d][1] == d]
    bad = brute.contamination(texts, items)
    clean = stages["decontamination"](spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in clean.collect()) == [d for d in sorted(bad) if not bad[d][4]]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert packed and packed_well(packed, packing.Capacity())


def test_pipeline_decides_on_rows(spark, sf_dir):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 200").first()["text"]
    a, b = ("clean words of one kind " + " ".join(f"{k}{i}" for i in range(60)) for k in "xy")
    table = [(None, a), (None, a), (7, a), (8, b), (8, "other " + " ".join(f"z{i}" for i in range(60))), (None, item), (9, item), (9, b + " more"), (None, None)]
    table = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in table], "doc_id bigint, text string, lang string, source string, n_chars bigint").select(docs.columns)
    near = stages["near_duplicates"](spark, table, sf_dir)
    assert near.columns == docs.columns
    key = lambda r: (r["doc_id"] or 0, (r["text"] or "")[:6])
    assert sorted(map(key, near.collect())) == sorted([(7, a[:6]), (8, b[:6]), (8, "other "), (9, item[:6]), (0, "")])
    clean = stages["decontamination"](spark, table, sf_dir).collect()
    assert sorted(map(key, clean)) == sorted([(0, a[:6]), (0, a[:6]), (7, a[:6]), (8, b[:6]), (8, "other "), (9, b[:6]), (0, "")])
    nameless = spark.createDataFrame([(None, a, "en", "s", 1)] * 3, "doc_id bigint, text string, lang string, source string, n_chars bigint").select(docs.columns)
    assert stages["near_duplicates"](spark, nameless, sf_dir).count() == 1


@pytest.mark.parametrize("name", ["op3_positional_index", "op5_threshold_search", "op10_parity_join"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    db = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    want = db.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
