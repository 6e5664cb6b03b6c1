import datetime
import math
import random
import statistics
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tallywright.functions import vectors as H
from tallywright.operators import anomaly as A
from tallywright.operators import conform as C
from tallywright.operators import features as FE
from tallywright.operators import iforest as I
from tallywright.operators import metrics as M
from tallywright.operators import replies as R
from tallywright.operators import retrieval as RE
from tallywright.operators import skew, spend, star
from tallywright.operators.quantiles import percentile_by, with_percentile
from tallywright.schema import FEATURES

_SCHEMA = ("source_file string, row_idx int, txn_date date, description string, "
           "amount decimal(18,2), category string, currency string")


def statement(spark, rows, source="s.csv"):
    """rows: (description, amount, day, category)"""
    data = [(source, i, datetime.date(2024, 3, d), t, Decimal(str(a)), c, "INR")
            for i, (t, a, d, c) in enumerate(rows)]
    return spark.createDataFrame(data, _SCHEMA)


def ordinary(spark, n=30):
    return statement(spark, [(f"Coffee shop {i}", -(100 + i), i % 27 + 1, "shopping")
                             for i in range(n)])


def test_large_charge(spark):
    rows = [("Coffee", -100, i, None) for i in range(1, 6)] + [("TV megastore", -65000, 10, None)]
    found = A.large_transactions(statement(spark, rows)).collect()
    assert len(found) == 1 and found[0]["severity"] == "high"
    assert found[0]["message"] == ("Unusually large charge of 65,000 "
                                   "(~650x your typical spend)")
    assert found[0]["transactions"][0]["amount"] == Decimal("-65000.00")


def test_duplicates_keep_every_copy(spark):
    rows = [("Rent", -15000, 1, None), ("Rent", -15000, 1, None), ("Rent", -15000, 4, None),
            ("Coffee", -100, 2, None)]
    found = A.duplicates(statement(spark, rows)).collect()
    assert len(found) == 1
    assert found[0]["message"] == "3 identical charges of 15,000 for 'Rent'"
    assert sorted(t["copies"] for t in found[0]["transactions"]) == [1, 2]


def test_clean_and_inflow_statements(spark):
    clean = statement(spark, [(f"Shop {i}", -(100 + i), i, None) for i in range(1, 8)])
    assert A.detect(clean).count() == 0
    inflow = statement(spark, [("Salary", 500000, 1, None)]
                       + [(f"Coffee {i}", -100, i, None) for i in range(2, 6)])
    assert A.detect(inflow).count() == 0


def test_combine_drops_overlap(spark):
    rows = statement(spark, [("Coffee", -100, i, None) for i in range(1, 6)]
                     + [("TV", -65000, 10, "shopping"), ("X", -10, 11, None)])
    hits = rows.where(F.col("description").isin("TV", "X")).select(
        "source_file", F.lit("ml_outlier").alias("type"), F.lit("low").alias("severity"),
        F.lit("m").alias("message"), F.array(A.member(F.lit(1))).alias("transactions"))
    kinds = sorted((r["type"], r["transactions"][0]["description"])
                   for r in A.combine(A.detect(rows), hits).collect())
    assert kinds == [("large_transaction", "TV"), ("ml_outlier", "X"),
                     ("possible_duplicate", "Coffee")]


def test_features(spark):
    rows = ordinary(spark).unionByName(statement(spark, [("Salary", 50000, 2, "income")]))
    matrix = FE.feature_matrix(rows, keep=("row_idx",)).collect()
    assert len(matrix) == 30 and matrix[0].__fields__ == ["row_idx", *FEATURES]
    amounts = [100 + i for i in range(30)]
    first = next(r for r in matrix if r["row_idx"] == 3)
    assert math.isclose(first["log_amount"], math.log1p(103))
    assert math.isclose(first["amount_to_median_ratio"], 103 / statistics.median(amounts))
    assert math.isclose(first["amount_zscore"],
                        (103 - statistics.fmean(amounts)) / statistics.pstdev(amounts))
    day = datetime.date(2024, 3, 4)
    assert first["day_of_week"] == day.weekday() and first["desc_length"] == len("Coffee shop 3")
    assert first["desc_word_count"] == 3 and first["desc_has_digits"] == 1
    assert first["category_code"] == 6


def test_forest_flags_the_outlier_and_survives_saving(spark, tmp_path):
    # of 30 training rows three are themselves at the edge, hence a tenth and not less
    model = I.fit(FE.feature_matrix(ordinary(spark)), contamination=0.1)
    watch = statement(spark, [(f"Coffee {i}", -(100 + i), i % 27 + 1, "shopping")
                              for i in range(10)]
                      + [("Luxury watch boutique", -95000, 15, "shopping")])
    found = I.model_anomalies(watch, model).collect()
    assert Decimal("-95000.00") in {t["amount"] for r in found for t in r["transactions"]}
    assert {r["type"] for r in found} == {"ml_outlier"}
    scores = I.score(FE.feature_matrix(watch, keep=("row_idx",)), model).orderBy("score")
    assert 10 in {r["row_idx"] for r in scores.limit(2).collect()}
    tiny = statement(spark, [("Coffee", -100, 1, None), ("Tea", -120, 2, None)])
    assert I.model_anomalies(tiny, model).count() == 0
    assert I.model_anomalies(watch, None).count() == 0
    model.save(str(tmp_path / "model"))
    again = I.load(spark, str(tmp_path / "model"))
    assert I.load(spark, str(tmp_path / "nothing")) is None and I.load(spark, None) is None
    matrix = FE.feature_matrix(watch, keep=("row_idx",))
    one = {r["row_idx"]: r["score"] for r in I.score(matrix, model).collect()}
    two = {r["row_idx"]: r["score"] for r in I.score(matrix, again).collect()}
    assert one == two and again.feature_names == FEATURES


def test_forest_flags_about_the_contamination(spark):
    rows = spark.range(4000).select(*[F.rand(i).alias(f"f{i}") for i in range(3)])
    rows = rows.checkpoint() if spark.sparkContext.getCheckpointDir() else rows
    model = I.fit(rows, contamination=0.03, trees=60, names=("f0", "f1", "f2"))
    scored = I.score(rows, model)
    assert model.metadata["n_samples"] == 4000
    assert abs(I.training_metrics(scored).first()["outlier_rate"] - 0.03) < 0.01


@pytest.mark.parametrize("equal", [0.0, 0.4, 0.999])
def test_a_tree_draws_about_its_sample_however_many_rows_are_equal(spark, equal):
    n, trees = 200_000, 150
    same = F.col("id") < int(n * equal)
    rows = spark.range(n).select(*[F.when(same, 0.5).otherwise(F.rand(i)).alias(f"f{i}") for i in range(2)])
    rows = rows.withColumn("_row", F.xxhash64("f0", "f1")).checkpoint()
    got = I.drawn(rows, n, trees, 256, 42).groupBy("_tree").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("f0") == 0.5).alias("same")).collect()
    assert len(got) == trees and all(256 <= r["n"] <= 384 for r in got)
    assert all(abs(r["same"] - 320 * equal) <= 2 for r in got) if equal else True
    dealt = I.drawn(rows.repartition(3), n, trees, 256, 42)
    again = dealt.groupBy("_tree").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("f0") == 0.5).alias("same"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_a_small_table_goes_to_every_tree_whole(spark):
    rows = spark.createDataFrame([(0.1,), (0.1,), (0.2,)], "f0 double").withColumn("_row", F.xxhash64("f0"))
    got = I.drawn(rows, 3, 4, 3, 42).groupBy("_tree", "f0").count().collect()
    assert sorted(map(tuple, got)) == [(t, v, c) for t in range(4) for v, c in ((0.1, 2), (0.2, 1))]


def test_scores_are_those_of_a_walk_by_hand(spark):
    nodes = [(0, 0, 0, 0.5, 1, 2, 0.0, 3), (0, 1, -1, 0.0, -1, -1, 2.0, 1), (0, 2, 1, 7.0, 3, 4, 0.0, 2),
             (0, 3, -1, 0.0, -1, -1, 4.0, 1), (0, 4, -1, 0.0, -1, -1, 5.5, 1), (1, 0, -1, 0.0, -1, -1, 3.0, 3)]
    model = I.Forest(spark.createDataFrame(nodes, I._NODES), -500_000_000_000, ("a", "b"), {"sample": 256})
    rows = spark.createDataFrame([(0.5, 9.0), (0.6, 7.0), (0.6, 7.5)], "a double, b double")
    got = {(r["a"], r["b"]): r["score"] for r in I.score(rows, model).collect()}
    for key, depth in (((0.5, 9.0), 2.5), ((0.6, 7.0), 3.5), ((0.6, 7.5), 4.25)):
        assert math.isclose(got[key], 0.5 - 2 ** (-depth / I.mean_path(256)), abs_tol=1e-11)
    found = I.predict(I.score(rows, model))
    assert {r["prediction"] for r in found.collect()} == {-1}


def test_training_scores_each_row_once(spark, monkeypatch):
    n, seen, real = 3000, spark.sparkContext.accumulator(0), I._raw

    def watched(features, forest):
        @F.pandas_udf("bigint")
        def count(values: pd.Series) -> pd.Series:
            seen.add(len(values))
            return values

        return real(features, forest).withColumn("_raw", count("_raw"))

    rows = spark.range(n).select(*[F.rand(i).alias(f"f{i}") for i in range(3)]).checkpoint()
    monkeypatch.setattr(I, "_raw", watched)
    made = {"trees": 20, "names": ("f0", "f1", "f2")}
    model = I.fit(rows, **made)
    assert seen.value == n
    again = I.fit(rows, stored=True, **made)
    key = ["tree", "node"]
    assert again.nodes.orderBy(key).collect() == model.nodes.orderBy(key).collect()
    assert again.offset == model.offset


def test_an_exact_quantile_of_scores(spark):
    rng = random.Random(3)
    for values in ([-7], [-5, -5, -2], [-rng.randrange(1, 10**12) for _ in range(4000)],
                   [-(10**11) - rng.randrange(3) for _ in range(4000)]):
        scores = spark.createDataFrame([(v,) for v in values], "_raw bigint")
        for p in (0.0, 0.03, 0.1, 0.5, 1.0):
            assert math.isclose(I._quantile(scores, len(values), p), percentile_of(values, p), rel_tol=1e-15)


def test_mean_depths_are_those_of_a_walk(spark):
    """Trees of any shape, values at thresholds, and no value."""
    rng = np.random.default_rng(4)
    nodes = []
    for tree in range(30):
        sample = pd.DataFrame(np.round(rng.normal(size=(320, 3)), 1), columns=["a", "b", "c"])
        nodes.append(I._grower(("a", "b", "c"), 256, 7)(sample.assign(_tree=tree, _draw=range(320))))
    table = pd.concat(nodes).sample(frac=1, random_state=1)
    x = np.round(rng.normal(size=(500, 3)), 1)
    x[:250, 0] = rng.choice(table[(table.feature == 0)].threshold, 250)
    x[::9, 1] = np.nan
    at = {(r.tree, r.node): r for r in table.itertuples()}

    def depth(tree, row):
        node = at[tree, 0]
        while node.feature >= 0:
            node = at[tree, node.left if row[node.feature] <= node.threshold else node.right]
        return node.depth

    want = np.array([[depth(t, row) for t in range(30)] for row in x]).mean(axis=1)
    assert (I._mean_depths(x, I._laid_out(table), 8) == want).all()


@pytest.mark.parametrize("name", ["anom_combine", "anom_combine_model", "iforest_score_fitted", "iforest_persist"])
def test_a_query_that_reads_rows_again_reads_them_from_a_table(spark, sf_dir, name):
    """Joined, redacted and categorized once, whatever reads them."""
    found = queries()[name](spark, sf_dir)
    assert found.count() > 0
    assert not [f for f in found.inputFiles() if "lineitem" in f or "orders" in f]


def percentile_of(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize("p", [0.0, 0.03, 0.5, 1.0])
@pytest.mark.parametrize("bits", [0, 3, 20, 44])
def test_percentiles_are_exact(spark, p, bits):
    """From one value a bin to all in one, with ties, negative values, a null key and a null value."""
    values = [(k, v * v * 7919 % (1 << 45) - (1 << 30)) for k, n in (("a", 301), ("b", 4), ("c", 1), (None, 9))
              for v in range(n)] + [("a", 5)] * 150
    df = spark.createDataFrame(values + [("d", None), ("b", None)], "k string, v bigint")
    by = {}
    for k, v in values:
        by.setdefault(k, []).append(v)
    figures = {"n": "n", "mean": "mean", "std": "std"}
    got = {r["k"]: r for r in percentile_by(df, ["k"], "v", p, "p", figures, bits=bits).collect()}
    assert set(got) == set(by)
    for k, vs in by.items():
        assert math.isclose(got[k]["p"], percentile_of(vs, p), rel_tol=1e-9)
        assert got[k]["n"] == len(vs) and math.isclose(got[k]["mean"], statistics.fmean(vs), rel_tol=1e-12)
        assert math.isclose(got[k]["std"], statistics.pstdev(vs), rel_tol=1e-12, abs_tol=1e-9)
    near = with_percentile(df, ["k"], "v", p, "p", {"n": "n"}, bits).collect()
    assert len(near) == len(values) + 2
    assert {(r["k"], r["n"], r["p"]) for r in near} == {(k, r["n"], r["p"]) for k, r in got.items()} | {("d", None, None)}
    whole = percentile_by(df, [], "v", p, "p", bits=bits).first()["p"]
    assert math.isclose(whole, percentile_of([v for _, v in values], p), rel_tol=1e-9)
    assert percentile_by(df.limit(0), ["k"], "v", p, "p", bits=bits).count() == 0


def test_figures_do_not_cancel(spark):
    values = [10**12 + i % 7 for i in range(1000)]
    df = spark.createDataFrame([(1, v) for v in values], "k int, v bigint")
    got = percentile_by(df, ["k"], "v", 0.5, "p", {"std": "std", "mean": "mean"}).first()
    assert math.isclose(got["std"], statistics.pstdev(values), rel_tol=1e-12)
    assert got["mean"] == statistics.fmean(values)


def test_statistics_start_no_job(spark):
    """Building the frames only plans; nothing runs before an action."""
    rows = ordinary(spark)
    events = spark.createDataFrame([(datetime.datetime(2024, 1, 1), "a", 1.0)],
                                   "ts timestamp, key string, value double")
    spark.sparkContext.setJobGroup("plans", "only plans")
    try:
        FE.statement_stats(rows), FE.with_stats(rows), FE.with_stats(rows, None), FE.feature_matrix(rows)
        A.large_transactions(rows), A.detect(rows), M.percentile_by_key(events, "key")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plans")
        FE.statement_stats(rows).collect()
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("plans")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_positions_and_running_total_of_hot_groups(spark):
    rows = [("hot", i % 100, i) for i in range(2000)] + [("b", i, i) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, o int, u int").repartition(8)
    for hot in (100, skew.HOT_ROWS):
        placed = skew.positions(df, ["k"], ["o", "u"], "pos", hot).collect()
        want = {}
        for k in ("hot", "b"):
            ordered = sorted((o, u) for q, o, u in rows if q == k)
            want |= {(k, o, u): i for i, (o, u) in enumerate(ordered)}
        assert {(r["k"], r["o"], r["u"]): r["pos"] for r in placed} == want
    numbered = skew.positions(df, [], ["k", "o", "u"], "pos")
    assert sorted(r["pos"] for r in numbered.collect()) == list(range(2005))
    copies = spark.createDataFrame([("x", 1)] * 3000, "k string, o int")
    got = skew.positions(copies, ["k"], ["o"], "pos", 10)
    assert sorted(r["pos"] for r in got.collect()) == list(range(3000))
    summed = skew.running_total(skew.positions(df, ["k"], ["o", "u"], "pos"), "k", "pos", "u",
                                "total", block=7)
    total = 0
    for r in sorted((r for r in summed.collect() if r["k"] == "hot"), key=lambda r: r["pos"]):
        total += r["u"]
        assert r["total"] == total


def test_keep_groups(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("b", 2), ("c", -1)],
                               "k string, v int")
    df = df.union(spark.createDataFrame([(None, 1), (None, 2)], df.schema))
    kept = skew.keep_groups(df, ["k"], F.col("v") > 0, 2)
    assert {r["k"]: r["count"] for r in kept.groupBy("k").count().collect()} == {
        "a": 50, "b": 2, None: 2}


def test_anti_join_takes_null_as_a_key(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", None), ("c", 3)], "k string, v int")
    right = spark.createDataFrame([(None, 1), ("b", None), ("b", None)], "k string, v int")
    assert {tuple(r) for r in skew.anti_join(left, right, ["k", "v"]).collect()} == {("a", 2), ("c", 3)}


def test_null_descriptions_in_anomalies(spark):
    rows = spark.createDataFrame(
        [("s", datetime.date(2024, 1, 1), None, -5.0, None)] * 2, "source_file string, txn_date date, description string, amount double, category string")
    rows = rows.withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    rules = A.duplicates(rows)
    assert [r["message"] for r in rules.collect()] == ["2 identical charges of 5 for ''"]
    hits = rules.withColumn("type", F.lit("ml_anomaly"))
    assert A.combine(rules, hits).count() == 1


def test_ranked_categories_keep_unknown_ones_and_null(spark):
    rows = spark.createDataFrame([("gifts",), ("dining",), (None,), ("gifts",)], "category string")
    ranked = star.dim_category_ranked(rows)
    assert {(r["category_key"], r["category_name"]) for r in ranked.collect()} == {(1, None), (2, "dining"), (3, "gifts")}
    keyed = star.with_surrogate_key(rows, ranked)
    assert sorted(r["category_key"] for r in keyed.collect()) == [1, 2, 3, 3]


def test_labels(spark):
    cases = [('["dining", "income"]', ["Swiggy order", "Salary"], ["dining", "income"]),
             ('```json\n["groceries"]\n```', ["BigBasket"], ["groceries"]),
             ('The label of line 1 is below.\n["travel"]\nNothing else was found.', ["Night train to Pune"], ["travel"]),
             ('["dining", "not-a-category"]', ["Swiggy order", "Netflix subscription"],
              ["dining", "subscriptions"]),
             ("no idea", ["Uber ride"], ["transport"]), (None, ["Uber ride"], ["transport"]),
             ("[5, {\"a\": 1}]", ["Uber", "x"], ["transport", "other"]), ("[]", [], [])]
    df = spark.createDataFrame([(i, r, d) for i, (r, d, _) in enumerate(cases)],
                               "batch_id int, reply string, descriptions array<string>")
    got = {}
    for r in R.apply_model_labels(df).orderBy("batch_id", "pos").collect():
        got.setdefault(r["batch_id"], []).append(r["category"])
    assert [got.get(i, []) for i in range(len(cases))] == [c[2] for c in cases]


def test_extractions(spark):
    reply = ('```json\n{"transactions": [{"date": "2024-03-01T10:00", "description": " Cafe ", '
             '"amount": -120.5}, {"date": "x", "amount": 5}, {"description": "z", "amount": 0}, '
             '{"description": "q", "amount": "ten"}]}\n```')
    df = spark.createDataFrame([(1, reply), (2, "sorry")], "reply_id int, reply string")
    got = R.parse_extractions(df, "2024-06-01").orderBy("pos").collect()
    assert [(r["txn_date"].isoformat(), r["description"], r["amount"], r["category"])
            for r in got] == [("2024-03-01", "Cafe", Decimal("-120.50"), "dining"),
                              ("2024-06-01", "unknown", Decimal("5.00"), "other")]


def test_retrieval(spark, monkeypatch):
    rows = statement(spark, [("Swiggy food order", -450, 1, "dining"),
                             ("Salary credit ACME", 50000, 2, "income"),
                             ("Netflix subscription", -499, 3, "subscriptions")])
    index = RE.index_transactions(rows, 256)
    asked = spark.createDataFrame([("a", "how much did I spend on food?"), ("b", "netflix"),
                                   ("c", "")], "query_id string, question string")
    assert index.count() == 3
    hits = RE.query_batch(index, asked, 5, 256).collect()
    top = {r["query_id"]: r["metadata"]["description"] for r in hits if r["rank"] == 1}
    assert top["a"] == "Swiggy food order" and top["b"] == "Netflix subscription"
    assert len(hits) == 9  # rows that score 0 fill up the k
    monkeypatch.setattr(RE, "BLOCK_BYTES", 100)  # several blocks of each
    again = RE.query_batch(index, asked, 5, 256).collect()
    assert sorted(map(str, again)) == sorted(map(str, hits))
    answers = {r["query_id"]: r["answer"] for r in RE.extractive_answers(
        asked, RE.query_batch(index, asked, 1, 256)).collect()}
    assert answers["b"] == "Top matches: 2024-03-03 Netflix subscription (-499.0)"
    none = RE.extractive_answers(asked, RE.query_batch(index.where(F.lit(False)), asked, 3, 256))
    assert {r["answer"] for r in none.collect()} == {RE.NOTHING_FOUND}


def test_one_block_of_questions_leaves_the_index_where_it_lies(spark, tmp_path, monkeypatch):
    """No vector is shuffled, and the best are those of blocks that meet in tasks; with equal rows, equal
    questions, a text without words and none."""
    texts = ["swiggy dinner", "netflix", "rent", "swiggy", "uber ride", "", "rent rent house", "netflix monthly 1996"]
    rows = statement(spark, [(f"{texts[i % 8]} {i % 5}", -(100 + i % 3), i % 9 + 1, "dining") for i in range(240)])
    RE.index_transactions(rows, 256).repartition(4).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    asked = [(f"q{i}", t) for i, t in enumerate(["how much for netflix", "rent", "rent", "", None, "zzz", "uber 2024 03"])]
    asked = spark.createDataFrame(asked + [asked[0]], "query_id string, question string")
    vectors = asked.select("query_id", H.hash_vector(F.col("question"), 256).alias("vector"))
    plan = RE.topk_sparse(index, vectors, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "Explode" not in plan.title()
    monkeypatch.setattr(RE, "BLOCK_ROWS", 50)  # several blocks in a task
    got = sorted(map(str, RE.query_batch(index, asked, 4, 256).collect()))
    monkeypatch.setattr(RE, "_in_one_block", lambda *_: False)
    assert got == sorted(map(str, RE.query_batch(index, asked, 4, 256).collect()))


def test_dense_top_k(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]),
                                     ("z", [0.0, 0.0])], "id string, values array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, values array<double>")
    got = RE.topk_dense(vectors, queries, 3).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["a", "b", "c"] and got[0]["score"] == 1.0


def test_dense_top_k_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(f"v{i:03d}", rng.integers(-2, 3, 3 + i % 2).astype(float).tolist()) for i in range(120)]
    rows += [("w", None), ("x", [])]
    vectors = spark.createDataFrame(rows, "id string, values array<double>").repartition(3)
    asked = vectors.where("id < 'v020' or id >= 'w'").withColumnRenamed("id", "query_id")

    def cosine(a, b):
        a, b = np.array(a or [0.0]), np.array(b or [0.0])
        n = min(len(a), len(b))
        size = np.sqrt((a**2).sum()) * np.sqrt((b**2).sum())
        return round(float(a[:n] @ b[:n] / size), 12) if size else 0.0

    want = {q: sorted((-cosine(x, v), i) for i, v in rows)[:6] for q, x in rows if q < "v020" or q >= "w"}
    for size in (RE.BLOCK_BYTES, 300):
        monkeypatch.setattr(RE, "BLOCK_BYTES", size)
        got = {}
        for r in RE.topk_dense(vectors, asked, 6).orderBy("rank").collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
        assert set(got) == set(want)
        for q, found in want.items():
            assert [i for _, i in got[q]] == [i for _, i in found], q
            assert np.allclose([s for s, _ in got[q]], [s for s, _ in found], atol=1e-11)
    assert RE.topk_dense(vectors.limit(0), asked, 6).count() == 0
    assert RE.topk_dense(vectors, asked.limit(0), 6).count() == 0


def sparse_rows(rng, n, tokens, dim):
    import numpy as np

    out = []
    for _ in range(n):
        at = (rng.zipf(1.3, int(rng.integers(0, tokens))) % dim).astype(np.int64)
        out.append(np.unique(at, return_counts=True))
    return out


@pytest.mark.parametrize("k", [1, 5, 400])
def test_inverted_lists_find_the_best(k):
    import numpy as np

    rng = np.random.default_rng(k)
    rows, asked = sparse_rows(rng, 300, 12, 64), [*sparse_rows(rng, 40, 20, 80), (np.array([], int), np.array([], int))]
    ids = np.array([f"r{i}" for i in rng.permutation(300)], dtype=object)
    lists = RE.InvertedLists(ids, np.array([len(b) for b, _ in rows]), np.concatenate([b for b, _ in rows]),
                             np.concatenate([c for _, c in rows]).astype(float))
    full = np.zeros((300, 80))
    for i, (b, c) in enumerate(rows):
        full[i, b] = c
    norm = np.sqrt((full**2).sum(1))
    for b, c in asked:
        q = np.zeros(80)
        q[b] = c
        size = norm * np.sqrt((q**2).sum())
        score = np.divide(full @ q, size, out=np.zeros(300), where=size > 0)
        want = sorted(zip(-score, ids, strict=True))[:k]
        got_ids, got = lists.best(b, c.astype(float), k)
        assert list(got_ids) == [i for _, i in want] and (got == [-s for s, _ in want]).all()


def test_few_rows_are_scored_where_bounds_tell():
    import numpy as np

    rng = np.random.default_rng(9)
    n = 5000  # one list holds all rows, another a hundred
    buckets = [np.array([0, 1 + i % 50, *([60, 61] if i % 50 == 0 else [])]) for i in range(n)]
    counts = [np.array([1, 1, *([9, 9] if i % 50 == 0 else [])]) for i in range(n)]
    lists = RE.InvertedLists(np.array([f"{i:05d}" for i in rng.permutation(n)], dtype=object),
                             np.array([len(b) for b in buckets]), np.concatenate(buckets), np.concatenate(counts).astype(float))
    ids, scores = lists.best(np.array([0, 1, 2, 3, 4, 60, 61]), np.array([1, 1, 1, 1, 1, 5, 5.0]), 5)
    assert len(ids) == 5 and lists.rows_scored <= 100


def test_tools(spark):
    rows = statement(spark, [("Swiggy", -450, 1, "dining"), ("Rent", -67000, 2, None),
                             ("Salary", 90000, 3, "income")])
    assert spend.total_spend(rows).first()["total"] == Decimal("67450.00")
    assert spend.total_spend(rows, "other").first()["count"] == 1
    assert spend.total_spend(rows, since="2024-03-02", until="2024-03-02").first()["count"] == 1
    empty = spend.total_spend(rows, "travel").first()
    assert empty["total"] == 0 and empty["count"] == 0
    order = [r["category"] for r in spend.sort_spend(spend.spend_by_category(rows)).collect()]
    assert order == ["other", "dining"]
    found = spend.search_hits(rows, "RENT salary", 1, ["txn_date"]).collect()
    assert [(r["description"], r["count"]) for r in found] == [("Rent", 2)]
    assert spend.search_keywords(rows, "").count() == 3


def test_serving_fact_and_read_back(spark):
    rows = statement(spark, [("Swiggy", -450, 1, "dining"), ("Salary", 50000, 2, "income"),
                             ("Odd", -1, 3, "no such")], "march.csv")
    fact = star.fact_serving(rows, ["row_idx"])
    got = sorted(tuple(r) for r in fact.select("txn_id", "category_key", "is_outflow").collect())
    assert got == [("march.csv:0", 2, True), ("march.csv:1", 0, False), ("march.csv:2", 13, True)]
    back = star.store_order(star.read_back(fact, star.dim_date(rows),
                                           star.dim_category_fixed(spark))).collect()
    assert [r["description"] for r in back] == ["Swiggy", "Salary", "Odd"]
    assert back[0]["amount"] == Decimal("-450.00") and back[2]["category"] == "other"


def test_dedup_keeps_the_first(spark):
    rows = statement(spark, [("Rent", -1, 1, None), ("Rent", -1, 1, None), ("Rent", -1, 2, None)])
    assert sorted(r["row_idx"] for r in C.dedup_silver(rows).collect()) == [0, 2]
