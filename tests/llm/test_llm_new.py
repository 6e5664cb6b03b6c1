"""Window packing, hard negatives and conversation repair."""

import collections
import hashlib
import itertools
import os
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from tallywright.llm import hard_negatives, queries, structure_repair, window_packing  # noqa: E402
from test_llm_tables import AWKWARD  # noqa: E402


def encoded(texts, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer())
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, end] for t in texts]


def item_by_item(lengths, window):
    """Plain best-fit decreasing: the remaining capacities of all windows."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(c, i) for i, c in enumerate(left) if c >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(window - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    window = int(rng.integers(3, 60))
    lengths = rng.integers(1, window + 1, int(rng.integers(1, 400))).tolist()
    lengths = [n if rng.random() < 0.5 else window for n in lengths] if seed == 5 else lengths
    ranges, tree, opened = window_packing.plan({n: lengths.count(n) for n in set(lengths)}, window)
    left = [window] * opened
    for length, found in ranges.items():
        for n, windows, first, offset, fit in found:
            assert 0 < n <= windows * fit
            for k in range(n):
                assert window - left[first + k // fit] == offset + k % fit * length
                left[first + k // fit] -= length
    assert sorted(left) == item_by_item(lengths, window)
    assert sorted((c, first + i) for c, n, first in tree.rest() for i in range(n)) == sorted((c, i) for i, c in enumerate(left) if c)


def test_tightest_window():
    rng = np.random.default_rng(1)
    tree, held = window_packing.Tightest(20), []
    for _ in range(500):
        n = int(rng.integers(1, 21))
        want = min((c for c in held if c >= n), default=None)
        assert tree.find(n) == want
        if want is not None and rng.random() < 0.6:
            tree.take(want)
            held.remove(want)
        else:
            tree.put(n, 1, None)
            held.append(n)


def checked(rows, docs, window, end, least):
    """Every id of every document once, sequences without gaps; the number of padding tokens."""
    per = {}
    for r in rows:
        per.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for seats in per.values():
        at = 0
        for offset, n in sorted(seats):
            assert offset == at and n > 0
            at += n
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    want = sorted(zip([d for d, _ in docs], encoded([t for _, t in docs], end), strict=True), key=str)
    pieces = {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    for d, ids in want:
        some = sorted(pieces[d, len(ids)])
        copies = sum((e, len(x)) == (d, len(ids)) for e, x in want)
        assert sum(n for _, n, _ in some) == len(ids) * copies
        for start, n, crc in some:
            assert zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes()) == crc
        if copies == 1:
            assert [s for s, _, _ in some] == np.cumsum([0, *(n for _, n, _ in some)])[:-1].tolist()
    assert {k[0] for k in pieces} == {d for d, _ in docs}
    assert padding <= len(per) * (least - 1)
    return padding


@pytest.mark.parametrize("window", [4096, 16, 7, 1])
def test_window_packing_awkward(spark, window):
    docs = spark.createDataFrame(AWKWARD, "doc_id bigint, text string").withColumn("length", F.lit("x")).withColumn("part", F.lit(1))
    for least in (1, 4):
        rows = window_packing.pack(docs, queries.tokenizer(), window, least_cut=least).collect()
        checked(rows, AWKWARD, window, 2, least)
    packed = window_packing.pack(docs, queries.tokenizer(), window, with_ids=True)
    whole = window_packing.sequences(packed).collect()
    by = {r["sequence_id"]: r["ids"] for r in whole}
    flat = {d: ids for (d, _), ids in zip(AWKWARD, encoded([t for _, t in AWKWARD], 2), strict=True)}
    rows = packed.collect()
    for r in rows:
        assert by[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == flat[r["doc_id"]][r["start"]:r["start"] + r["length"]]
    assert sum(map(len, by.values())) == sum(r["length"] for r in rows)
    assert window_packing.pack(docs.limit(0), queries.tokenizer(), window).count() == 0


def test_windows_that_nothing_short_fills(spark):
    """Documents just over half a window: the gaps are closed by cutting."""
    docs = [(i, "the " * 2999) for i in range(40)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    rows = window_packing.pack(table, queries.tokenizer()).collect()
    assert checked(rows, docs, 4096, 2, 16) == 0
    assert len({r["sequence_id"] for r in rows if r["length"] == 4096 or r["offset"]}) <= 31


def test_window_packing_of_table(spark, sf_dir):
    rows = queries.op13_window_packing(spark, sf_dir).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    padding = checked(rows, docs, 4096, 2, 16)
    assert padding < 0.005 * sum(r["length"] for r in rows)


def damaged(rows):
    """conv -> its turns (turn, role, text) in order, as the contract damages them."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        mine += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    return {c: sorted(m, key=lambda x: (x[0] is not None, x[0] or 0, x[1], digest(x[1], x[2]))) for c, m in out.items()}


def cheapest(turns):
    """(cost, audit, repaired turns), from the last turn to the first, over whole strings."""
    name = {"u": "user", "a": "assistant"}
    due = dict(zip("esua", "uuau", strict=True))

    def inserted(b):
        for _ in range(4):
            for state in "esua":
                if due[state] in b:
                    c, s, r = b[due[state]]
                    b[state] = min(b.get(state, (9**9,)), (3 + c, "I" + s, [(name[due[state]], ""), *r]))
        return b

    best = inserted({"e": (0, "", []), "a": (0, "", [])})
    for role, text, gone, cut in reversed(turns):
        now = {}
        for state in "esua":
            ways = []
            if state in best:
                c, s, r = best[state]
                ways.append((4 + c, "D" + s, r))
            if not gone and due[state] in best:
                c, s, r = best[due[state]]
                ways.append((3 + 3 * cut + c, "R" + s, [(name[due[state]], text), *r]))
            if not gone and (role[:1] == due[state] or (state == "e" and role[:1] == "s")) and role[:1] in best:
                c, s, r = best[role[:1]]
                ways.append((3 * cut + c, "K" + s, [(role, text), *r]))
            if ways:
                now[state] = min(ways)
        best = inserted(now)
    return best["e"]


def reported(turns):
    """What is due for one conversation's turns."""
    seen, marked, count = set(), [], collections.Counter()
    for _, role, text in turns:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "none"
        seen.add((role, text))
        count[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    cost, audit, made = cheapest(marked)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha), made


def all_audits(turns, most):
    """(cost, audit) of every repair with at most `most` edits, by trying every string."""
    for n in range(most + 1):
        for audit in itertools.product("DIKR", repeat=n):
            at, state, cost = 0, "e", 0
            for edit in audit:
                due = "a" if state == "u" else "u"
                if edit != "I":
                    if at == len(turns):
                        break
                    initial, gone, cut = turns[at]
                    at += 1
                    if edit == "D":
                        cost += 4
                        continue
                    cost += 3 * cut
                    if gone or (edit == "K" and initial != due and (state, initial) != ("e", "s")):
                        break
                    state, cost = (initial, cost) if edit == "K" else (due, cost + 3)
                else:
                    state, cost = due, cost + 3
            else:
                if at == len(turns) and state in "ea":
                    yield cost, "".join(audit)


def test_repair_is_the_least_of_all_audits():
    rng = np.random.default_rng(3)
    for _ in range(60):
        turns = [(str(rng.choice(list("suaat"))), bool(rng.random() < 0.2), bool(rng.random() < 0.3)) for _ in range(int(rng.integers(0, 4)))]
        want = min(all_audits(turns, 6))
        assert structure_repair.join([[structure_repair.solve(turns)]]) == want
        assert cheapest([(i, "x", g, c) for i, g, c in turns])[:2] == want


def test_parts_join_to_the_whole():
    rng = np.random.default_rng(4)
    for _ in range(40):
        turns = [(str(rng.choice(list("suuaa"))), bool(rng.random() < 0.2), bool(rng.random() < 0.3)) for _ in range(int(rng.integers(1, 60)))]
        at = sorted({0, len(turns), *rng.integers(0, len(turns) + 1, 3).tolist()})
        parts = [[structure_repair.solve(turns[a:b], e) for e in range(4)] for a, b in zip(at, at[1:], strict=False)]
        assert structure_repair.join(parts) == structure_repair.join([[structure_repair.solve(turns)]]) == cheapest([(i, "x", g, c) for i, g, c in turns])[:2]


@pytest.mark.parametrize("base", [structure_repair._BASE, 0])
def test_histories(monkeypatch, base):
    """Also with a hash that collides always: equality is verified."""
    monkeypatch.setattr(structure_repair, "_BASE", base)
    rng = np.random.default_rng(5)
    tree, text = structure_repair.Histories(), [""]
    for _ in range(400):
        node, edit = int(rng.integers(max(0, len(text) - 9), len(text))), str(rng.choice(list("DIKR")))
        if text[node] + edit not in text:
            assert tree.extend(node, edit) == len(text)
            text.append(text[node] + edit)
    for _ in range(800):
        a, b = rng.integers(0, len(text), 2).tolist()
        assert tree.edits(a) == text[a]
        common = os.path.commonprefix([text[a], text[b]])
        assert tree.common(a, b) == len(common)
        x, y = rng.choice(list("DIKR"), 2).tolist()
        if (text[a] + x) != (text[b] + y):
            assert tree.less(a, x, b, y) == (text[a] + x < text[b] + y)


def conversation_rows():
    rng = np.random.default_rng(6)
    texts = ["Fine.", "Fine.", "Is it?", "cut off", "", " \n", None, "Done! \t\n", "été…", "x."]
    rows = [(c, t, str(rng.choice(["system", "user", "assistant", "tool", "", "user"])), texts[int(rng.integers(0, len(texts)))]) for c in range(40) for t in range(int(rng.integers(1, 9)))]
    rows += [(900, int(t), ["user", "assistant"][t % 2], f"turn {t % 37}." if t % 5 else "no end") for t in range(700)]  # one long conversation
    rows += [(901, 3, "user", "The same.")] * 200 + [(902, None, None, None), (None, 1, "user", "Hello."), (None, None, "assistant", "Yes."), (None, 1, "user", "Hello.")]
    rows += [(903, 0, "user", "x" * 300_000 + "."), (903, 10, "assistant", "y" * 300_000), (904, -(2**63), "user", "a."), (904, 2**63 - 1, "assistant", "b.")]
    rows += [(905, 2, "user", "tie."), (905, 2, "assistant", "tie."), (905, 2, "user", "other."), (906, None, "system", "s."), (906, None, "user", "u."), (906, 4, "assistant", "a.")]
    return rows


def test_repair_awkward(spark, monkeypatch):
    rows = conversation_rows()
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("id", F.lit("x")).withColumn("conv", F.lit(1)).withColumn("kind", F.lit("k")).repartition(5)
    want = {c: reported(t) for c, t in damaged(rows).items()}
    for turns in (50_000, 20):
        monkeypatch.setattr(structure_repair, "_TURNS", turns)
        hurt = structure_repair.damaged(table)
        got = {r["conv_id"]: tuple(r)[1:] for r in structure_repair.repair(hurt).collect()}
        assert got == {c: (min(r[0], 2**63 - 1), *r[1:]) for c, (r, _) in want.items()}
        made = {}
        for r in structure_repair.repaired_turns(hurt).collect():
            made.setdefault(r["conv_id"], []).append((r["position"], r["role"], r["text"]))
        assert {c: [x[1:] for x in sorted(m)] for c, m in made.items()} == {c: m for c, (_, m) in want.items() if m}
    assert structure_repair.repair(structure_repair.damaged(table.limit(0))).count() == 0


def test_repair_of_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: reported(t)[0] for c, t in damaged(rows).items()}
    got = queries.op12_structure_repair(spark, sf_dir).collect()
    assert len(got) == len(want) and {r["conv_id"]: tuple(r)[1:] for r in got} == want


def mined(vectors, is_anchor, k=5, n=10):
    """(anchor, positive, rank, negative, scores) of rows (id, label, whole components)."""
    out = []
    for a, mine, x in vectors:
        if not is_anchor(a):
            continue
        scored = [(-int(x @ y), i, label == mine) for i, label, y in vectors if i != a]
        for p, j, _ in sorted(s for s in scored if s[2])[:k]:
            fits = sorted(s[:2] for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p)[:n]
            out += [(a, j, r, i, -p, -s) for r, (s, i) in enumerate(fits, 1)]
    return sorted(out)


def test_intervals_hold_the_scores():
    rng = np.random.default_rng(7)
    for width, top in ((1, 5), (3, 100), (64, 40), (70, 2**20), (200, 3)):
        rows = rng.integers(-top, top + 1, (300, width))
        rows[:5] = 0
        rotation = hard_negatives.Rotation(width)
        turned = rotation.turn(rotation.turn(rotation.padded(rows), 0), 1)
        assert np.allclose(turned @ turned.T, rows @ rows.T)
        block = hard_negatives.Block(np.arange(300), rng.integers(0, 3, 300), rows, *hard_negatives.encode(rows.astype(float), rotation))
        for query in (rows[7], rows[0], rows[8] * 2):
            exact, width_of = block.vectors @ query, []
            walk, stays = block.levels(hard_negatives.Query(query, rotation), np.arange(300)), None
            for _ in range(hard_negatives.LEVELS):
                some, low, high = walk.send(stays) if stays is not None else next(walk)
                assert (low <= exact).all() and (exact <= high).all() and len(some) == 300
                width_of.append((high - low).sum())
                stays = np.ones(300, bool)
            assert width_of == sorted(width_of, reverse=True)


def test_most_rows_are_never_scored():
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(20_000, 64))
    rows = np.floor(256 * rows / np.sqrt((rows**2).sum(1, keepdims=True))).astype(np.int64)
    rotation = hard_negatives.Rotation(64)
    block = hard_negatives.Block(np.arange(20_000), rng.integers(0, 10, 20_000), rows, *hard_negatives.encode(rows.astype(float), rotation))
    query = rows[5]
    some = np.arange(20_000)
    at, score = block.best(query, hard_negatives.Query(query, rotation), some, 10)
    exact = block.vectors @ query
    want = np.lexsort((block.ids, -exact))[:10]
    assert block.ids[at].tolist() == block.ids[want].tolist() and score.tolist() == exact[want].tolist()
    bands = [(9_000, 27_000), (8_000, 24_000), (9, 8)]
    for (low, high), (at, score) in zip(bands, block.best_within(query, hard_negatives.Query(query, rotation), some, bands, 10), strict=True):
        inside = np.flatnonzero((exact >= low) & (exact <= high))
        want = inside[np.lexsort((block.ids[inside], -exact[inside]))[:10]]
        assert block.ids[at].tolist() == block.ids[want].tolist() and score.tolist() == exact[want].tolist()
    assert block.rows_scored < 2_000


def test_hard_negatives_awkward(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(0, 4)) if i % 3 else 1, [float(x) for x in rng.integers(-9, 10, 5) / 256]) for i in range(400)]
    rows += [(i, 1, [0.5, 0.25, 0.0, 0.0, 0.125]) for i in range(400, 560)]  # one very common vector: ties
    rows += [(560, -7, [0.1] * 5), (600, 2**40, [0.5, 0.2, 0.0, 0.0, 0.1]), (700, 1, [0.0] * 5)]
    odd = [(800, 1, None), (801, 1, [0.1, None]), (802, 2, [float("nan")]), (803, 2, [float("inf")]), (None, 1, [0.1] * 5), (900, None, [0.1] * 5)]
    short = [(1000, 1, []), (1001, 2, [0.5])]
    table = spark.createDataFrame(rows + odd + short, "vec_id bigint, label bigint, embedding array<float>").withColumn("row", F.lit(1)).withColumn("block", F.lit("x")).repartition(6)
    whole = [(i, label, np.floor(256 * np.array(x + [0.0] * (5 - len(x)), np.float32).astype(float)).astype(int)) for i, label, x in rows + short]
    want = mined(whole, lambda i: i % 50 == 0)
    for size, anchors in ((32_768, 4_096), (40, 3)):
        monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", size)
        monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", anchors)
        got = hard_negatives.mine(table, F.col("vec_id") % 50 == 0)
        assert sorted(map(tuple, got.collect())) == want
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(table.where("vec_id < 5"), F.col("vec_id") % 50 == 0, 3, 2).count() <= 6
    twice = hard_negatives.mine(table.unionByName(table.where("vec_id = 0")), F.col("vec_id") == 0).count()
    assert twice == 2 * sum(w[0] == 0 for w in want)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_structure_repair"])
def test_new_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    db = duckdb.connect()
    for table in ("embeddings", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    want = db.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


def test_sql_of_the_repair_on_awkward_rows(spark):
    """The SQL against the brute-force version, with nulls, ties, repeats and long conversations."""
    import duckdb
    import pandas as pd

    rows = [r for r in conversation_rows() if r[0] != 904]  # whose gaps are beyond a long
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    db = duckdb.connect()
    db.register("frame", frame)
    db.sql("CREATE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role::VARCHAR AS role, text::VARCHAR AS text FROM frame")
    got = {r[0]: tuple(r[1:]) for r in db.sql(queries.ORACLE["op12_structure_repair"]).fetchall()}
    assert got == {c: reported(t)[0] for c, t in damaged(rows).items()}
