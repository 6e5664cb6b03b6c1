import bisect
import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallywright.operators import conform as C
from tallywright.operators import metrics
from tallywright.sources import datasets, large_files, snapshots, statements, tables
from tallywright.streaming import jobs

FILES = {
    "march.csv": "Date,Description,Debit,Credit,Balance\n2024-03-01,Salary Acme Corp,,50000,50000\n"
                 "2024-03-02,Swiggy order,450,,49550\n2024-03-05,ATM withdrawal,2000,,47550\n",
    "amt.csv": "﻿Date,Description,Amount\r\n01-03-2024,Refund,1200\r\n"
               "02-03-2024, Coffee ,\"-1,150.50\"\r\n\r\n",
    "other.csv": "Narration, Txn Date ,Withdrawal Amt\n\"Shop, \"\"big\"\"\nhall\",5 Mar 2024,₹10\n"
                 "late,2024-02-30,1\nnone,,1\nmore,1/3/2024,1,2\n",
    "bad.csv": "Foo,Bar\n1,2\n", "empty.csv": "", "notes.txt": "x", "UPPER.CSV": "Date,Details,Dr\n"
    "2024-01-01,Rent,-\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("statements")
    for name, text in FILES.items():
        (path / name).write_bytes(text.encode())
    return str(path)


@pytest.fixture(scope="module")
def bronze(spark, folder):
    return statements.to_bronze(statements.read_files(spark, folder))


def test_admission(spark, folder):
    found = statements.admission(statements.list_files(spark, folder)).collect()
    by_name = {r["path"].rsplit("/", 1)[-1]: r["status"] for r in found}
    assert by_name["notes.txt"] == 415
    assert by_name["march.csv"] == by_name["UPPER.CSV"] == 200
    listed = spark.createDataFrame([("a.pdf", 11 << 20), ("a.pdf", 10 << 20), ("e.csv", 0)],
                                   "path string, length bigint")
    assert [r["status"] for r in statements.admission(listed).collect()] == [413, 200, 400]


def test_conform(bronze):
    rows = {(r["source_file"], r["row_idx"]): r for r in C.conform(bronze).collect()}
    assert rows[("march.csv", 0)]["amount"] == Decimal("50000.00")
    assert rows[("march.csv", 1)]["amount"] == Decimal("-450.00")
    assert rows[("march.csv", 2)]["balance"] == Decimal("47550.00")
    assert rows[("amt.csv", 0)]["txn_date"] == datetime.date(2024, 3, 1)
    assert rows[("amt.csv", 1)]["amount"] == Decimal("-1150.50")
    assert rows[("amt.csv", 1)]["description"] == "Coffee"
    assert rows[("other.csv", 0)]["description"] == 'Shop, "big"\nhall'
    assert rows[("other.csv", 0)]["amount"] == Decimal("-10.00")
    assert rows[("UPPER.CSV", 0)]["amount"] == 0
    assert len(rows) == 7


def test_rejects(bronze):
    lost = {(r["source_file"], r["row_idx"]): r["reason"] for r in C.rejects(bronze).collect()}
    assert lost == {("bad.csv", 0): "missing date or description column",
                    ("other.csv", 1): "unrecognized date",
                    ("other.csv", 3): "more cells than columns"}


def test_file_rejects(spark, folder, tmp_path):
    files = statements.read_files(spark, folder)
    assert [r["source_file"] for r in statements.file_rejects(files).collect()] == ["bad.csv"]
    (tmp_path / "heads.csv").write_text("Foo,Bar\n")
    (tmp_path / "blank.csv").write_text("\n\n")
    (tmp_path / "open.csv").write_text('Date,Description,Amount\n2024-01-01,"TV,-1\n2024-01-02,x,-2\n')
    (tmp_path / "good.csv").write_text("Date,Description,Amount\n2024-01-01,x,-1\n")
    (tmp_path / "up.xlsx").write_text("x")
    files = statements.read_files(spark, str(tmp_path))
    assert {r["source_file"]: r["reason"] for r in statements.file_rejects(files).collect()} == {
        "heads.csv": "missing date or description column", "blank.csv": "empty", "open.csv": "unclosed quote"}
    assert {r["source_file"] for r in statements.to_bronze(files).collect()} == {"good.csv"}
    listed = statements.list_files(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[-1] for r in statements.unread(listed).collect()] == ["up.xlsx"]


def test_a_quote_opens_only_at_the_start_of_a_cell(spark, tmp_path):
    (tmp_path / "tv.csv").write_text('Date,Description,Amount\n2024-01-01,TV 42" LG,-100\n'
                                     '2024-01-02,"a ""b"", c"x,-2\n2024-01-03,Coffee 5",-3\n,,\n2024-01-04,"",""\n')
    rows = statements.to_bronze(statements.read_files(spark, str(tmp_path))).orderBy("row_idx").collect()
    assert [r["cells"] for r in rows] == [
        ["2024-01-01", 'TV 42" LG', "-100"], ["2024-01-02", 'a "b", cx', "-2"],
        ["2024-01-03", 'Coffee 5"', "-3"], [None, None, None], ["2024-01-04", None, None]]


def test_a_file_above_the_upload_limit_is_read(spark, tmp_path):
    line = "2024-01-01,some description that is not short at all,-1\n"
    n = 12 * 1024**2 // len(line)
    (tmp_path / "big.csv").write_text("Date,Description,Amount\n" + line * n)
    assert statements.to_bronze(statements.read_files(spark, str(tmp_path))).count() == n


def test_row_idx_is_the_place_in_a_long_file(spark, tmp_path):
    lines = [f"2024-01-{i % 28 + 1:02d},row {i},{i}" for i in range(5000)]
    (tmp_path / "long.csv").write_text("Date,Description,Amount\n" + "\n".join(lines))
    rows = C.conform(statements.to_bronze(statements.read_files(spark, str(tmp_path))))
    assert rows.where(F.col("description") != F.concat(F.lit("row "), "row_idx")).count() == 0
    assert rows.count() == 5000


def test_schema_drift(spark, bronze, tmp_path):
    path = str(tmp_path / "bronze")
    tables.append(statements.spread(bronze, ["Date", "Description"]), path)
    tables.append(statements.spread(bronze, ["Narration"]), path)
    both = tables.read_table(spark, path)
    assert {"Date", "Description", "Narration"} <= set(both.columns)
    assert both.count() == 2 * bronze.count()


def test_stream_equals_batch(spark, folder, bronze, tmp_path):
    path = str(tmp_path / "silver")
    stream = jobs.ingest_statements(spark, folder, files_per_batch=2)
    jobs.append_to(stream, path, str(tmp_path / "checkpoint"))
    batch = C.enrich(C.conform(bronze))
    key = ["source_file", "row_idx", "txn_date", "description", "amount", "category"]
    assert sorted(map(str, tables.read_table(spark, path).select(key).collect())) == sorted(
        map(str, batch.select(key).collect()))


def test_a_stream_names_its_rejects_and_a_replay_changes_nothing(spark, folder, bronze, tmp_path, monkeypatch):
    path, lost, checkpoint = (str(tmp_path / n) for n in ("silver", "rejects", "checkpoint"))
    writes = []

    def killed(df, at):
        writes.append(at)
        if len(writes) == 4:  # between the two writes of the second batch
            raise RuntimeError("killed")
        tables.overwrite(df, at)

    monkeypatch.setattr(jobs, "overwrite", killed)
    with pytest.raises(Exception):
        jobs.ingest_both(spark, folder, path, lost, checkpoint, files_per_batch=2)
    for _ in range(2):
        jobs.ingest_both(spark, folder, path, lost, checkpoint, files_per_batch=2)
    assert writes[2] == writes[4]  # the batch was replayed into its folder
    key = ["source_file", "row_idx", "txn_date", "description", "amount", "category"]
    assert sorted(map(str, tables.read_table(spark, path).select(key).collect())) == sorted(
        map(str, C.enrich(C.conform(bronze)).select(key).collect()))
    got = {(r["source_file"], r["row_idx"]): r["reason"] for r in tables.read_table(spark, lost).collect()}
    assert got == {("bad.csv", None): "missing date or description column",
                   ("other.csv", 1): "unrecognized date", ("other.csv", 3): "more cells than columns"}
    assert tables.read_table(spark, lost).count() == 3


def test_replace_by_source(spark, tmp_path):
    path = str(tmp_path / "fact")
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "source_file string, v int")
    second = spark.createDataFrame([("a", 9), ("c", 4)], "source_file string, v int")
    tables.replace_by_source(first, path, 4)
    for _ in range(2):
        tables.replace_by_source(second, path, 4)
        got = sorted((r["source_file"], r["v"]) for r in tables.read_table(spark, path).collect())
        assert got == [("a", 9), ("b", 3), ("c", 4)]
    tables.replace_by_source(second.where("v < 0"), path, 4)
    assert tables.read_table(spark, path).count() == 3


def test_replace_holds_for_any_layout_and_null_keys(spark, tmp_path):
    path = str(tmp_path / "fact")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "source_file string, v int")
    for buckets in (4, 7, 7, 1, 64, None):
        tables.replace_by_source(rows, path, buckets)
        got = tables.read_table(spark, path)
        assert sorted((r["source_file"] or "", r["v"]) for r in got.collect()) == [("", 4), ("a", 1), ("b", 2), ("c", 3)]
    assert snapshots.manifest(spark, path).buckets == 64
    assert len(list((tmp_path / "fact" / "_manifest").glob("*.json"))) == snapshots.KEPT_VERSIONS
    assert snapshots.vacuum(spark, path) == 0
    wide = rows.where("v < 3").withColumn("w", F.lit("new"))
    tables.replace_by_source(wide, path)
    got = sorted((r["v"], r["w"]) for r in tables.read_table(spark, path).collect())
    assert got == [(1, "new"), (2, "new"), (3, None), (4, None)]


@pytest.mark.parametrize("step", ["_commit", "_survivors", "_remove_old"])
def test_a_load_that_is_killed_leaves_a_readable_table(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "fact")
    first = spark.createDataFrame([(k, 1) for k in "abcdef"], "source_file string, v int")
    second = spark.createDataFrame([(k, 2) for k in "abxy"], "source_file string, v int")
    tables.replace_by_source(first, path, 4)
    old, new = {(k, 1) for k in "abcdef"}, {(k, 2) for k in "abxy"} | {(k, 1) for k in "cdef"}

    class Killed(BaseException):
        pass

    def kill(*_):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(snapshots, step, kill)
        m.setattr(snapshots, "_delete", lambda *_: None)  # nothing is tidied up either
        with pytest.raises(Killed):
            tables.replace_by_source(second, path, 4)
    read = lambda: {tuple(r) for r in tables.read_table(spark, path).collect()}
    assert read() == (new if step == "_remove_old" else old)
    tables.replace_by_source(second, path, 4)
    assert read() == new
    assert snapshots.vacuum(spark, path) == {"_commit": 2, "_survivors": 1, "_remove_old": 0}[step]
    assert read() == new


def test_two_loads_at_a_time(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "fact")
    rows = lambda v: spark.createDataFrame([("a", v), (f"k{v}", v)], "source_file string, v int")
    tables.replace_by_source(rows(1), path, 2)
    real = snapshots._commit

    def late(session, at, made):
        monkeypatch.setattr(snapshots, "_commit", real)
        tables.replace_by_source(rows(3), path, 2)  # the other load is first
        real(session, at, made)

    monkeypatch.setattr(snapshots, "_commit", late)
    with pytest.raises(snapshots.Conflict):
        tables.replace_by_source(rows(2), path, 2)
    assert {tuple(r) for r in tables.read_table(spark, path).collect()} == {("a", 3), ("k1", 1), ("k3", 3)}
    assert snapshots.vacuum(spark, path) == 0


def test_buckets_grow_and_folders_are_folded(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "fact")
    monkeypatch.setattr(snapshots, "MOST_FOLDERS", 3)
    for i in range(6):
        tables.replace_by_source(spark.createDataFrame([(f"k{i}", i)], "source_file string, v int"), path, 1)
        assert tables.read_table(spark, path).count() == i + 1
    assert all(len(fs) <= 4 for fs in snapshots.manifest(spark, path).parts.values())
    monkeypatch.setattr(snapshots, "BUCKET_BYTES", 500)
    tables.replace_by_source(spark.createDataFrame([("k9", 9)], "source_file string, v int"), path)
    assert snapshots.manifest(spark, path).buckets > 1
    assert sorted(r["v"] for r in tables.read_table(spark, path).collect()) == [0, 1, 2, 3, 4, 5, 9]


def test_small_loads_do_not_rewrite_a_large_table(spark, tmp_path, monkeypatch):
    """Keys of the large folder are replaced by small loads, also again, with null as a key; what is written
    stays near what is brought until loads have brought half the folder."""
    path, written, real = str(tmp_path / "fact"), [], snapshots._write

    def counted(*args):
        made = real(*args)
        written.append(sum(made.values()))
        return made

    monkeypatch.setattr(snapshots, "_write", counted)
    want = {None if i == 7 else f"k{i:03d}": 0 for i in range(400)}
    rows = lambda d: spark.createDataFrame([(k, v, c) for k, v in d.items() for c in range(40)],
                                           "source_file string, v int, c int").withColumn("h", F.sha2(F.concat_ws("-", "v", "c", "source_file"), 256))
    tables.replace_by_source(rows(want), path, 2)
    large, bring = written.pop(), 0
    for i, some in enumerate([["k001", "k002"], ["k002", None], [None, "new"], ["k399", "new"]], 1):
        want |= {k: i for k in some}
        written.clear()
        tables.replace_by_source(rows({k: i for k in some}), path)
        bring += sum(written)
        table = tables.read_table(spark, path)
        assert table.columns == ["source_file", "v", "c", "h"]
        got = table.groupBy("source_file").agg(F.min("v"), F.max("v"), F.count("c")).collect()
        assert {tuple(r) for r in got} == {(k, v, v, 40) for k, v in want.items()}
    assert bring < large / 4 and snapshots.manifest(spark, path).gone
    assert len(list((tmp_path / "fact" / "_keys").iterdir())) == len(snapshots.manifest(spark, path).lists())
    assert snapshots.vacuum(spark, path) == 0
    half = {f"k{i:03d}": 9 for i in range(100, 320)}  # the folder is written anew, and nothing is noted any more
    tables.replace_by_source(rows(half), path)
    got = tables.read_table(spark, path).groupBy("source_file").agg(F.min("v"), F.max("v"), F.count("c")).collect()
    assert {tuple(r) for r in got} == {(k, v, v, 40) for k, v in (want | half).items()}
    assert not snapshots.manifest(spark, path).gone
    tables.replace_by_source(rows({}), path)
    tables.replace_by_source(rows({"k001": 11}), path, 4)  # laid out anew
    assert tables.read_table(spark, path).count() == 40 * len(want | half)


def test_upsert_last_wins(spark):
    store = spark.createDataFrame([("1", "old"), ("2", "keep")], "id string, m string")
    new = spark.createDataFrame([("1", "x", 1), ("1", "y", 2), ("3", "z", 3)],
                                "id string, m string, seq int")
    got = sorted(tuple(r) for r in tables.upsert(store, new, "id", "seq").collect())
    assert got == [("1", "y"), ("2", "keep"), ("3", "z")]


def test_generic_bank_without_date_is_empty(spark):
    bank = spark.createDataFrame([("1", "2")], "Amount string, Type string")
    assert datasets.generic_bank(bank).count() == 0


def test_cards_century(spark):
    rows = [(f"{d}-Oct-{y}", "Delhi", "Gold", "Bills", "1500.9") for d in range(1, 7)
            for y in ("14", "98")]
    cards = spark.createDataFrame(
        rows, "Date string, City string, `Card Type` string, `Exp Type` string, Amount string")
    got = datasets.cards_by_city(cards).collect()
    assert {r["source_file"] for r in got} == {"Delhi/2014-10", "Delhi/1998-10"}
    assert {r["amount"] for r in got} == {Decimal("-1500.00")}
    assert {r["category"] for r in got} == {"utilities"}


def test_pieces_of_lines():
    cut = lambda v, i: list(large_files.pieces(v, i))
    assert cut("a,b", False) == [("a,b", True, True)] and cut("", False) == [("", True, True)]
    assert cut("a,b\r", False) == [("a,b", True, True)] and cut("a,b", True) == [("a,b\n", False, False)]
    assert cut('a,"b', False) == [('a,"b\n', True, False)] and cut('b""c', True) == [('b""c\n', False, False)]
    assert cut('c",d', True) == [('c",d', False, True)] and cut('c","d', True) == [('c","d\n', False, False)]
    assert cut('a"b,c', False) == [('a"b,c', True, True)]  # a quote opens only at the start of a cell
    assert cut("a\rb,\r", False) == [("a", True, True), ("b,", True, True)]
    assert cut('"a\rb",c\rd', False) == [('"a\rb",c', True, True), ("d", True, True)]


@pytest.mark.parametrize("split", [64, 700, 1 << 27])
def test_large_files_are_split_and_read_alike(spark, folder, tmp_path, split):
    """Files of many splits, with quotes that run over lines and splits, equal the whole-file read."""
    rng = random.Random(5)
    texts = ["plain", '"quoted, text"', '"two\nlines"', '"a ""b""\n\n,c"', 'TV 42" LG', '""', '"x' + "\ny" * 40 + '"', "é中"]
    for i, name in enumerate(("big one.csv", "BIG2.csv")):
        lines = [f"2024-01-{k % 28 + 1:02d},{rng.choice(texts)},{k}" + ("\r" if rng.random() < 0.1 else "") for k in range(300)]
        lines[50:50] = ["", ",,"]
        (tmp_path / name).write_text("﻿" * i + "Date,Description,Amount\n" + "\n".join(lines), newline="")
    (tmp_path / "open.csv").write_text('Date,Description,Amount\n2024-01-01,"TV,-1\n' + "2024-01-02,x,-2\n" * 50)
    (tmp_path / "bad head.csv").write_text("Foo,Bar\n" + "1,2\n" * 50)
    for name, text in FILES.items():
        (tmp_path / name).write_text(text, newline="")
    key = ["source_file", "row_idx"]
    want = statements.to_bronze(statements.read_files(spark, str(tmp_path))).orderBy(key).collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for limit in (0, 600, 1 << 30):
            got = statements.read_bronze(spark, str(tmp_path), limit)
            assert got.orderBy(key).collect() == want
        if split == 700:
            assert large_files.lines(spark, str(tmp_path), 600).select("file", "start").distinct().count() > 20
        lost = large_files.unclosed(large_files.lines(spark, str(tmp_path), 0))
        assert [r["file"].rsplit("/", 1)[-1] for r in lost.collect()] == ["open.csv"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("accuracy", [20, 200])
def test_stream_percentile_keeps_its_rank_error(spark, tmp_path, accuracy):
    """Against the exact batch figure, over several files that each bring part of the window."""
    folder, path = str(tmp_path / "events"), str(tmp_path / "p95")
    n = 20_000
    value = (F.col("id") * 7919 % 10_007).cast("double") ** 2
    rows = spark.range(n).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 50).alias("ts"),
        F.when(F.col("id") % 10 == 0, "rare").otherwise("often").alias("key"), value.alias("value"))
    rows.repartition(6).write.parquet(folder)
    events = jobs.events_stream(spark, folder, rows.schema)
    jobs.window_result(jobs.percentile(events, "key", "1 day", 0.95, accuracy), path,
                       str(tmp_path / "checkpoint"), ["window_start", "key"])
    got = {r["key"]: r["value"] for r in tables.read_table(spark, path).collect()}
    exact = {r["key"]: r["value"] for r in metrics.percentile_by_key(rows, "key", "1 day", 0.95).collect()}
    assert set(got) == set(exact) == {"rare", "often"}
    for key in got:
        values = sorted(r["value"] for r in rows.where(F.col("key") == key).collect())
        low, high = bisect.bisect_left(values, got[key]), bisect.bisect_right(values, got[key])
        wanted = bisect.bisect_left(values, exact[key])
        assert low - len(values) / accuracy - 1 <= wanted <= high + len(values) / accuracy + 1
