"""Operators on documents: brute force on the smallest tables, and the awkward cases."""

import os
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from tallywright.llm import (  # noqa: E402
    compression, gru, language, line_dedup, lm_scoring, parity_join, positional_index, queries, severity, store)

LINE = "one two three four five six seven eight nine ten eleven twelve thirteen"
AWKWARD = [
    (1, f"{LINE}\n{LINE} a\n{LINE} b\n{LINE} c\nlast words"), (2, None), (3, ""), (4, "  \n\t "), (5, "short"),
    (6, f"intro\n{LINE}\n{LINE} a\n{LINE} b\n{LINE} c\nother end"), (7, "word " * 30_000), (None, "text without an id"),
    (8, "SHORT"), (9, "été 中文 \U0001f600"), (10, "123 ... !!"), (5, "short"),
]
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def awkward(spark):
    clashes = ["key", "n", "row", "place", "words", "grade", "difference", "score", "lang_pred", "first", "print", "part", "length"]
    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clashes)], F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA + ", lang string, source string, n_chars bigint")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


# -- language

def test_marginals_are_those_of_all_labellings():
    import itertools

    rng = np.random.default_rng(1)
    crf = language.Crf(["a", "b", "c"], np.zeros((language.BUCKETS, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    emitted, fresh = rng.normal(size=(40, 3)), np.zeros(40, bool)
    fresh[[0, 5, 11, 12, 18, 24, 30, 36]] = True
    p, _, _ = language.marginals(crf, emitted, fresh)
    edges = [*np.flatnonzero(fresh), 40]
    for a, b in zip(edges, edges[1:], strict=False):
        want, mass = np.zeros((b - a, 3)), 0.0
        for labels in itertools.product(range(3), repeat=b - a):
            w = np.exp(crf.first[labels[0]] + sum(emitted[a + i, k] for i, k in enumerate(labels)) + sum(crf.steps[x, y] for x, y in zip(labels, labels[1:], strict=False)))
            mass += w
            want[np.arange(b - a), labels] += w
        assert np.abs(want / mass - p[a:b]).max() < 1e-12


def test_language_held_out(spark, sf_dir):
    got = queries.op1_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = [r for r in got.collect() if r["held_out"]]
    assert all(r["held_out"] == (brute.fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in held)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)


def test_language_switches_and_awkward(spark, awkward, nothing, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    crf = language.fit(docs)
    got = rows(language.predict(awkward, crf), "doc_id", "lang_pred", "score")
    assert len(got) == len(AWKWARD)
    assert {(d, lang, s) for d, lang, s in got if d in (2, 3, 4, 10)} == {(d, "und", 0.0) for d in (2, 3, 4, 10)}
    assert all(lang in crf.languages for d, lang, _ in got if d in (1, 7, 8, 9))
    assert language.predict(nothing, crf).count() == 0
    assert {r[0] for r in rows(language.predict(awkward, language.fit(nothing)), "lang_pred")} == {"und"}
    one = {r["lang"]: r["text"] for r in docs.where("length(text) > 300").select("lang", F.substring("text", 1, 300).alias("text")).collect()}
    mixed = spark.createDataFrame([(1, one["fr"] + " " + one["de"])], SCHEMA)
    labels = [r["lang"] for r in language.label_words(mixed, crf).orderBy("position").collect()]
    assert labels[:20].count("fr") >= 18 and labels[-20:].count("de") >= 18


# -- quality and toxicity

def test_quality_held_out(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = queries.op2_compression_quality(spark, sf_dir).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (brute.fold(r["doc_id"], 5) == 0) for r in got)
    assert len(got) == 200
    right = [r["predicted"] == labels[r["doc_id"]] for r in got if r["doc_id"] in labels]
    assert sum(right) >= 0.85 * len(right)


def test_quality_awkward(spark, awkward, nothing):
    labelled = spark.createDataFrame([(f"plain words in a row number {i}", 1) for i in range(60)] + [(f"%%% ### {i} $$$ &&&", 0) for i in range(60)] + [(None, 1), ("", 0)], "text string, label int")
    model = compression.fit(labelled)
    got = {r["doc_id"]: r["score"] for r in compression.score(awkward, model).collect()}
    assert got[2] == got[3] and all(0 <= s <= 1 for s in got.values())
    assert compression.score(nothing, model).count() == 0
    assert {r["score"] for r in compression.score(awkward, compression.fit(labelled.where("label = 5"))).collect()} == {0.5}
    x = np.array([0.1, 0.2, 0.3, 0.4])
    at, share = compression.curve(x, np.array([0.0, 1.0, 0.0, 1.0]))
    assert list(at) == sorted(at) and list(share) == sorted(share)


def test_severity_grades_and_awkward(spark, awkward, nothing, sf_dir):
    rng = np.random.default_rng(3)
    texts = []
    for i in range(400):
        grade = i % 4
        words = ["".join(rng.choice(list("klmnoprst"), 3)) for _ in range(20)] + ["mild"] * (grade >= 1) + ["worse"] * (grade >= 2) + ["awful"] * (grade >= 3)
        texts.append((" ".join(words), grade))
    model = severity.fit(spark.createDataFrame(texts + [(None, 1)], "text string, grade int"))
    assert (np.diff(model.thresholds) > 0).all()
    asked = spark.createDataFrame([(0, "kln mop"), (1, "MILD kln"), (2, "mild worse"), (3, "mild worse awful")], SCHEMA)
    got = {r["doc_id"]: r for r in severity.predict(asked, model).collect()}
    assert [got[i]["grade"] for i in range(4)] == [0, 1, 2, 3]
    assert all(got[i]["expected_severity"] < got[i + 1]["expected_severity"] for i in range(3))
    again = {r["doc_id"]: r["expected_severity"] for r in severity.predict(awkward, model).collect()}
    assert again[2] == again[3] == again[4]
    assert severity.predict(nothing, model).count() == 0
    assert severity.fit(nothing.select("text", F.lit(1).alias("grade"))).grades == [0]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = {r["doc_id"]: r["toxic"] for r in queries.op7_toxicity(spark, sf_dir).collect()}
    assert len(found) == 200
    assert sum(found[d] == bool(t) for d, t in labels.items()) >= 0.85 * len(labels)


# -- decontamination

def test_contamination(spark, sf_dir, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in queries.op3_positional_index(spark, sf_dir).collect()}
    assert got == brute.contamination(documents, items)


def test_contamination_awkward_and_blocks(spark, awkward, nothing):
    items = [(1, LINE), (2, "short"), (3, None), (4, ""), (2, "short"), (5, LINE + " a one two")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    named = [(d, t) for d, t in AWKWARD if d is not None]
    want = brute.contamination(named, items)
    for block in (1 << 18, 2):
        found = positional_index.matches(awkward, table, block=block)
        got = {r["doc_id"]: (r["n_words"], sum(s["after"] - s["first"] for s in r["spans"]), sorted(r["items"])) for r in found.collect()}
        assert len(got) == len(want) + 1
        assert {d: (g[0], g[1], len(g[2])) for d, g in got.items() if d is not None} == {d: w[:3] for d, w in want.items()}
    assert positional_index.decontaminate(nothing, table).count() == 0
    clean = positional_index.decontaminate(awkward, table.limit(0)).collect()
    assert len(clean) == len(AWKWARD) and not any(r["contaminated"] for r in clean)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 9 + "beta gamma"), (3, "beta alpha"), (4, None)], SCHEMA)
    got = rows(positional_index.near(docs, {7: ["Alpha", "beta"], 8: ["alpha", "nowhere"]}, 3), "doc_id", "query", "place")
    assert {(d, q) for d, q, _ in got} == {(1, 7), (3, 7)}


# -- line and near-duplicate removal

def test_line_dedup(spark, sf_dir, documents):
    got = dict(rows(queries.op8_line_dedup(spark, sf_dir), "doc_id", "text"))
    assert got == brute.line_cuts(documents)


def test_line_dedup_awkward(spark, awkward, nothing):
    out = line_dedup.dedup(awkward)
    assert out.columns == [*awkward.columns, "lines_removed"]
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in out.collect()}
    assert out.count() == len(AWKWARD)
    assert got[6] == ("intro\nother end", 4) and got[1] == (AWKWARD[0][1], 0)
    assert got[2] == (None, 0) and got[3] == ("", 0) and got[5] == ("short", 0)
    assert line_dedup.dedup(nothing).count() == 0
    looped = spark.createDataFrame([(1, "\n".join([LINE] * 20)), (1, "\n".join([LINE] * 20))], SCHEMA)
    assert {r["text"] for r in line_dedup.dedup(looped).collect()} == {"\n".join([LINE] * 4)}


@pytest.mark.parametrize(("n_words", "percent"), [(3, 90), (5, 80)])
def test_components(spark, n_words, percent):
    rng = np.random.default_rng(n_words)
    base = [f"w{rng.integers(4000)}" for _ in range(300)]
    docs = []
    for i in range(160):
        words = list(base[: int(rng.integers(30, 300))]) if i % 5 == 0 else list(base)
        for _ in range(int(rng.integers(0, 9))):
            words[int(rng.integers(len(words)))] = f"x{rng.integers(9)}"
        docs.append((i + 10, " ".join(words)))
    docs += [(d + 1000, t) for d, t in docs[::7]] + [(5, "a b"), (6, "A  b"), (7, "a"), (8, None), (9, "")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.classes(spark.createDataFrame(docs, SCHEMA), n_words, percent).collect()}
    assert got == brute.shingle_components(docs, n_words, percent)


def test_components_of_table(spark, sf_dir, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op10_parity_join(spark, sf_dir).collect()}
    assert got == brute.shingle_components(documents, 3, 90)


def test_components_awkward(awkward, nothing):
    got = rows(parity_join.classes(awkward), "doc_id", "n_shingles", "component_id")
    assert len(got) == len(AWKWARD) and (None, 2, None) in got
    named = dict((d, (n, c)) for d, n, c in got)
    assert named[8] == named[5] == (1, 5) and named[2] == (0, 2) and named[7] == (1, 7)
    assert parity_join.classes(nothing).count() == 0


def test_hamming_distance_is_a_lower_bound():
    rng = np.random.default_rng(0)
    a = np.sort(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
    b = np.sort(np.concatenate([a[20:], rng.integers(0, 1 << 63, 15, dtype=np.uint64)]))
    words, _, _, at = parity_join.sketch(np.concatenate([a, b]), np.array([0, 500, 995]), np.array([60, 60]))
    assert np.bitwise_count(words[at[0]:at[1]] ^ words[at[1]:at[2]]).sum() <= 35


def test_candidates_carry_folded_sketches():
    rng = np.random.default_rng(1)
    for near in (600, 60, 10, 1):
        a = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
        b = np.unique(np.concatenate([a[near // 2:], rng.integers(0, 1 << 63, near // 2, dtype=np.uint64)]))
        words, _, _, at = parity_join.sketch(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), np.array([121, 121]))
        small, bounds = parity_join.folded(words, at)
        assert bounds.tolist() == [0, 16, 32]
        assert np.bitwise_count(small[:16] ^ small[16:]).sum() <= len(np.setxor1d(a, b))
        assert np.bitwise_xor.reduce(small[:16]) == np.bitwise_xor.reduce(words[:121])
    empty, bounds = parity_join.folded(words[:17], np.array([0, 0, 17, 17]))
    assert len(empty) == 3 and bounds.tolist() == [0, 0, 3, 3]
    text = " ".join(map(str, range(400)))
    rows = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
    (packed,) = parity_join._packed(5, 80)(iter([rows]))
    size = np.array([396])
    low = parity_join.bands(80)
    parts = parity_join.parts_of(low, np.searchsorted(low, size, "right") - 1, 80)[0]
    assert packed.schema.names == ["doc_id", "band", "n", "sketch", "below"] and len(packed.column("sketch")[0]) == -(-parts // 8)


def test_a_pair_is_looked_at_in_its_first_large_group_only():
    def rows(keys):
        return pa.table({"doc_id": [5, 6, 7], "root": [5, 6, 7], "n": [50, 50, 50], "below": [False] * 3, "stray": [True, True, False], "pivot": [1, 1, 1],
                         "words": pa.array([[1, 2], [1, 3], [1, 2]], pa.list_(pa.int64())), "keys": pa.array(keys, pa.list_(pa.int64()))})

    keys = [[9, 4], [4, 9], [9]]
    run = parity_join._compared(80)
    for here, want in ((4, [(5, 6)]), (9, [(5, 7), (6, 7)])):
        there = rows(keys) if here == 9 else rows(keys).slice(0, 2)
        got = run((pa.scalar(here), pa.scalar(0), pa.scalar(0)), there.filter(there.column("stray")), there)
        assert sorted(zip(*got.to_pydict().values(), strict=True)) == want


def test_batches_of_long_rows_are_bounded_in_bytes(spark):
    store.small_batches(spark)
    long = spark.range(40, numPartitions=1).select(F.repeat(F.lit("x"), 1_000_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    got = [r["n"] for r in long.mapInArrow(sizes, "n bigint").collect()]
    assert sum(got) == 40 and max(got) <= 5


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cut_once_below_a_filter(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert plan_of(corpus_pipeline.line_deduplication(spark, docs, sf_dir)).count("ArrowEvalPython") == 1


def test_terms_go_to_spark_without_python_workers(awkward, spark, monkeypatch):
    table = spark.createDataFrame([(1, LINE)], "item_id bigint, text string")
    given, made = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: given.append(data) or made(self, data, *a, **b))
    positional_index.matches(awkward, table).collect()
    assert given and all(isinstance(d, pa.Table) for d in given)


# -- language-model scoring

def test_gru_gradients_and_scores():
    rng = np.random.default_rng(0)
    g = gru.Gru(rng.random(30) * 10, 20, 8, 5)
    for k in g.p:
        g.p[k] = g.p[k] + rng.normal(size=g.p[k].shape) * 0.3
    x, y, fresh, live = rng.integers(0, 30, (6, 3)), rng.integers(0, 30, (6, 3)), np.zeros((6, 3), bool), np.ones((6, 3), bool)
    fresh[0], fresh[3, 1], live[5, 2] = True, True, False
    grads, _ = g.gradients(x, y, fresh, live, np.zeros((3, 5)))

    def loss():
        h, states = np.zeros((3, 5)), []
        for i in range(6):
            h, _ = g.step(x[i], fresh[i], h)
            states.append(h)
        return -g.outputs(np.stack(states)[live], y[live])[0].mean()

    for k, v in g.p.items():
        i = tuple(rng.integers(0, n) for n in v.shape)
        old, ends = v[i], []
        for d in (1e-5, -1e-5):
            v[i] = old + d
            ends.append(loss())
        v[i] = old
        assert abs((ends[0] - ends[1]) / 2e-5 - grads[k][i]) < 1e-8
    h = rng.normal(size=(1, 5))
    assert abs(sum(np.exp(g.outputs(h, np.array([j]))[0][0]) for j in range(30)) - 1) < 1e-9
    g.p = {k: v.astype(np.float32) for k, v in g.p.items()}
    bounds = np.concatenate([[0], np.cumsum([3, 0, 9, 1, 90, 5])])
    s = rng.integers(0, 30, bounds[-1])
    for i, got in enumerate(g.score(s, bounds, 0, 3)):
        h, want, past = np.zeros((1, 5), np.float32), 0.0, 0
        for j, c in enumerate(s[bounds[i]:bounds[i + 1]]):
            h, _ = g.step(np.array([past]), np.array([j == 0]), h)
            want += g.outputs(h, np.array([c]))[0][0]
            past = c
        assert abs(got - want) < 1e-3


def test_gru_training_takes_no_new_memory_a_window():
    """A window's arrays come from memory the process has: given back and taken again, they cost a fault for each page."""
    import os
    import subprocess
    import sys

    code = """if True:
        import resource
        import numpy as np
        from tallywright.llm.gru import Gru
        rng = np.random.default_rng(0)
        bounds = np.concatenate([[0], np.cumsum(rng.integers(1, 300, 1000))])
        symbols = (2112 * rng.random(bounds[-1]) ** 3).astype(np.int64)
        g = Gru(np.ones(2112), 2048, 64, 24)
        faults = [0, 0]
        for i in range(2):
            g.train(symbols, bounds, 0, 1, most_lanes=128)
            faults[i] = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        print((faults[1] - faults[0]) / len(symbols))
    """
    env = os.environ | {"OMP_NUM_THREADS": "1", "PYTHONPATH": os.pathsep.join(filter(None, sys.path))}
    got = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True, timeout=120)
    assert float(got.stdout) < 0.1


def test_gru_updates_in_pieces_and_far_logits(monkeypatch):
    monkeypatch.setattr(gru, "PIECE", 7, raising=False)  # ends inside every parameter
    monkeypatch.setattr(gru, "PRODUCT", 100, raising=False)
    rng = np.random.default_rng(4)
    bounds = np.concatenate([[0], np.cumsum([40, 3, 90, 0, 25])])
    symbols = rng.integers(0, 30, bounds[-1])
    one, plain = (gru.Gru(np.arange(30.0), 20, 8, 5) for _ in range(2))
    one.train(symbols, bounds, 0, epochs=2, most_lanes=2)
    laid = gru._Laid(symbols, bounds, 0, 2)
    m, v = ({k: np.zeros(x.shape) for k, x in plain.p.items()} for _ in range(2))
    starts = range(0, laid.steps, gru.WINDOW)
    n, total = 0, 2 * len(starts)
    for _ in range(2):
        h = np.zeros((laid.count, 5), np.float32)
        for a in starts:
            h = h[:int((laid.used > a).sum())]
            text, y, x, fresh = laid.window(a, min(a + gru.WINDOW, laid.steps), len(h))
            grads, h = plain.gradients(x, y, fresh, text >= 0, h)
            n += 1
            norm = np.sqrt(sum((g.astype(float) ** 2).sum() for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1 / norm)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                step = m[k] / (1 - 0.9**n) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)
                plain.p[k] = (plain.p[k] - 0.01 * min(1.0, 2 * (1 - n / (total + 1))) * step).astype(np.float32)
    assert all(np.abs(one.p[k] - plain.p[k]).max() < 1e-4 for k in one.p)
    for scale in (1, 500):  # near and far: the probabilities of all symbols are 1 in sum, and the gradients follow
        g = gru.Gru(np.arange(30.0), 20, 8, 5)
        g.p = {k: w + rng.normal(size=w.shape) * (scale if k in ("pick", "pick_bias", "word", "word_bias") else 0.3) for k, w in g.p.items()}
        h = np.repeat(np.tanh(rng.normal(size=(1, 5))), 30, 0)
        logs = g.outputs(h, np.arange(30))[0]
        assert np.isfinite(logs).all() and abs(np.exp(logs).sum() - 1) < 1e-9
        x, y, fresh = rng.integers(0, 30, (4, 3)), rng.integers(0, 30, (4, 3)), np.zeros((4, 3), bool)
        grads, _ = g.gradients(x, y, fresh, ~fresh, np.zeros((3, 5)))
        for k in ("pick_bias", "word_bias", "pick", "over", "into"):
            i = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
            old, ends = g.p[k][i], []
            for d in (1e-6, -1e-6):
                g.p[k][i] = old + d
                h, states = np.zeros((3, 5)), []
                for a, b in zip(x, fresh, strict=True):
                    h, _ = g.step(a, b, h)
                    states.append(h)
                ends.append(-g.outputs(np.concatenate(states), y.ravel())[0].mean())
            g.p[k][i] = old
            assert abs((ends[0] - ends[1]) / 2e-6 - grads[k][i]) < 1e-4 * max(1, abs(grads[k][i]))


def test_samples_are_bounded_whatever_is_repeated(spark, monkeypatch):
    unique = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id")).alias("text"))
    point = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    low, high = (unique.where((point >= a) & (point < a + 0.02)).first()["text"] for a in (0.0, 0.5))
    copies = spark.range(1000, 1800).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, low).otherwise(high).alias("text"))
    nulls = spark.range(2000, 2600).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    docs = unique.union(copies).union(nulls).withColumn("lang", F.lit("en"))
    seen = []
    monkeypatch.setattr(gru.Gru, "train", lambda self, symbols, bounds, *_: seen.append(np.diff(bounds)))
    lm_scoring.fit(docs, lm_scoring.count_tokens(docs), words=8, block=4, hidden=4, sample_docs=100)
    assert 50 <= len(seen[0]) <= 100 and 10 <= (seen[0] == 1).sum() <= 50
    monkeypatch.setattr(language, "fit_sequences", lambda languages, runs: seen.append(runs))
    language.fit(docs, per_language=100)
    assert 50 <= len(seen[1]) <= 100
    real = compression.dictionary
    monkeypatch.setattr(compression, "dictionary", lambda blocks: (seen.append(blocks), real(blocks))[1])
    monkeypatch.setattr(compression, "curve", lambda x, y: (seen.append(x), ((0.0, 1.0), (0.0, 1.0)))[1])
    labelled = docs.select("text", (F.length("text") % 2).alias("label"))
    compression.fit(labelled.union(labelled.select("text", 1 - F.col("label"))), per_label=100, for_curve=100)
    assert all(10 <= len(x) <= 100 for x in seen[2:4]) and 20 <= len(seen[4]) <= 100


def test_a_long_text_among_short_ones_is_not_laid_out_whole(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(gru, "WINDOW", 1024)  # fewer calls; a window is still small beside the text
    rng = np.random.default_rng(6)
    sizes = np.concatenate([rng.integers(0, 40, 300), [1_000_000], rng.integers(0, 40, 300)])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    symbols = rng.integers(0, 12, bounds[-1]).astype(np.int32)
    g = gru.Gru(np.ones(12), 8, 4, 4)
    seen = []
    zeros = {k: np.zeros_like(v) for k, v in g.p.items()}
    monkeypatch.setattr(g, "gradients", lambda x, y, fresh, live, h: (seen.append((int(live.sum()), int((fresh & live).sum()))), (zeros, h))[1])
    tracemalloc.start()
    got = g.score(symbols, bounds, 0)
    g.train(symbols, bounds, 0, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20
    assert np.sum(seen, 0).tolist() == [bounds[-1], (sizes > 0).sum()]
    assert got[300] < -1_000_000 and (got[sizes == 0] == 0).all()
    for i in (0, 7, 400):
        assert abs(got[i] - g.score(symbols[bounds[i]:bounds[i + 1]], np.array([0, sizes[i]]), 0)[0]) < 1e-4


def test_scores(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in queries.op9_gru_scoring(spark, sf_dir).collect()}
    want = brute.unigram(documents, lambda d: brute.fold(d, 7) != 2)
    assert got.keys() == want.keys()
    for d, (n, known, total, base) in want.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, brute.fold(d, 7) == 2)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_the_model_learns_from_every_training_document(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PART_TOKENS", 2000, raising=False)  # several parts and rounds
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d "), F.col("id") % 50).alias("text"))
    point = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    # The counts don't tell the two tables apart, nor would a sample: a document far from its beginning.
    turned = docs.withColumn("text", F.concat(F.lit("d c b a "), F.col("doc_id") % 50))
    late = docs.where(point > 0.95).join(turned.where(point > 0.95).select("doc_id"), "doc_id").agg(F.min("doc_id")).first()[0]
    other = docs.where(F.col("doc_id") != late).union(turned.where(F.col("doc_id") == late))
    counts = lm_scoring.count_tokens(docs)
    fitted = [lm_scoring.fit(d, counts, words=8, block=4, hidden=4) for d in (docs, docs.repartition(3, "text"), other)]
    assert all(m.learned == m.total == 9000 for m in fitted)
    one, same, apart = (m.gru.p for m in fitted)
    assert all(np.abs(one[k] - same[k]).max() < 1e-6 for k in one)
    assert any(np.abs(one[k] - apart[k]).max() > 1e-5 for k in one)


def test_scores_beyond_the_head_and_awkward(spark, awkward, nothing, monkeypatch):
    named = awkward.where("doc_id is not null")
    for head in (1 << 18, 4):
        monkeypatch.setattr(lm_scoring, "HEAD_WORDS", head)
        counts = lm_scoring.count_tokens(named)
        got = lm_scoring.score(awkward, lm_scoring.fit(named, counts, words=8, block=4, hidden=4), counts).collect()
        assert len(got) == len(AWKWARD)
        want = brute.unigram([(d, t) for d, t in dict(AWKWARD).items() if d is not None], lambda d: True)
        # The repeated row counts twice in training.
        extra = sum(1 for d, _ in AWKWARD if d == 5) - 1
        assert {r["train_tokens"] for r in got} == {want[1][2] + 2 * extra}
        assert all(r["n_tokens"] == want[r["doc_id"]][0] == r["n_known"] and r["score"] < 0 for r in got if r["doc_id"] is not None)
    counts = lm_scoring.count_tokens(nothing)
    model = lm_scoring.fit(nothing, counts)
    assert {r["base_score"] for r in lm_scoring.score(awkward, model, counts).collect()} == {0.0}
    assert lm_scoring.score(nothing, model, counts).count() == 0
