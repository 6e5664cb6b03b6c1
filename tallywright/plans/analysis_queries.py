"""Anomalies, features, the forest, retrieval, and time-window figures."""

from pyspark.sql import functions as F

from ..functions import vectors as H
from ..functions.text import tokens
from ..operators import anomaly as A
from ..operators import features as FE
from ..operators import iforest as I
from ..operators import metrics as M
from ..operators import retrieval as V_
from ..operators import spend
from ..schema import FEATURES
from ..session import scratch
from ..streaming import jobs
from ..sources import tables
from . import fixtures as X
from .oracle import ALL_ANOMALIES, ANOMALIES, EVENTS_SLOTS, FILES, STATS, T, category_key, plain
from .registry import query
from . import stated_forest
from .stated_forest import SCORED

# ---- rule anomalies ----------------------------------------------------------------------

@query(ANOMALIES + """SELECT source_file, severity, message, txn_date AS date, description, amount,
category FROM large""")
def anom_large(spark, sf):
    return A.members(A.large_transactions(X.silver(spark, sf))).select(
        "source_file", "severity", "message", "date", "description", "amount", "category")


@query(ANOMALIES + """SELECT d.source_file, d.severity, d.message, o.txn_date AS date, o.description,
o.amount, o.category, count(*) AS copies
FROM dupes d JOIN o ON o.source_file = d.source_file AND o.description = d.description
  AND o.amount = d.amount GROUP BY ALL""")
def anom_duplicate(spark, sf):
    return A.members(A.duplicates(X.silver(spark, sf))).select(
        "source_file", "severity", "message", "date", "description", "amount", "category", "copies")


@query(ALL_ANOMALIES + """SELECT type, severity, message, txn_date AS date, description, amount,
  category, cast(copies AS bigint) AS copies FROM large
UNION ALL SELECT d.type, d.severity, d.message, o.txn_date, o.description, o.amount, o.category,
  count(*) FROM dupes d JOIN o ON o.description = d.description AND o.amount = d.amount
GROUP BY ALL""")
def anom_detect(spark, sf):
    """Both rules with all statements taken as one, with every member of every anomaly."""
    return A.members(A.detect(X.silver(spark, sf), scope=None)).select(
        "type", "severity", "message", "date", "description", "amount", "category", "copies")


# ---- features ----------------------------------------------------------------------------

_F = {
    "log_amount": "cast(round(ln(1 + mag / 100.0), 6) AS decimal(18,6))",
    "amount_to_median_ratio": "cast(round(mag / median, 4) AS decimal(18,4))",
    "amount_zscore": "cast(round((mag - mean) / CASE WHEN std = 0 THEN 100 ELSE std END, 3) "
                     "AS decimal(18,3))",
    "is_round_amount": "CASE WHEN mag <> 0 AND mag % 10000 = 0 THEN 1 ELSE 0 END",
    "day_of_week": "isodow(txn_date) - 1",
    "day_of_month": "day(txn_date)",
    "is_weekend": "CASE WHEN isodow(txn_date) >= 6 THEN 1 ELSE 0 END",
    "is_month_boundary": "CASE WHEN day(txn_date) <= 3 OR day(txn_date) >= 27 THEN 1 ELSE 0 END",
    "desc_length": "length(description)",
    "desc_word_count": "len(regexp_extract_all(description, '[^ ]+'))",
    "desc_has_digits": "CASE WHEN regexp_matches(description, '[0-9]') THEN 1 ELSE 0 END",
    "category_code": category_key("category"),
}
_ROUNDED = {"log_amount": 6, "amount_to_median_ratio": 4, "amount_zscore": 3}


def _plain(name):
    if name in _ROUNDED:
        places = _ROUNDED[name]
        return F.round(name, places).cast(f"decimal(18,{places})").alias(name)
    return F.col(name).cast("int").alias(name)


def _sql(name):
    return f"{_F[name] if name in _ROUNDED else f'cast({_F[name]} AS int)'} AS {name}"


@query(STATS + f"""SELECT source_file, txn_date, {', '.join(_sql(n) for n in FEATURES)}
FROM o JOIN stats USING (source_file)""")
def feat_matrix(spark, sf):
    matrix = FE.feature_matrix(X.silver(spark, sf), keep=("source_file", "txn_date"))
    return matrix.select("source_file", "txn_date", *[_plain(n) for n in FEATURES])


_SINGLE = {
    "feat_log_amount": "log_amount", "feat_ratio_median": "amount_to_median_ratio",
    "feat_zscore": "amount_zscore", "feat_round_amount": "is_round_amount",
    "feat_day_of_week": "day_of_week", "feat_day_of_month": "day_of_month",
    "feat_is_weekend": "is_weekend", "feat_month_boundary": "is_month_boundary",
    "feat_desc_length": "desc_length", "feat_desc_words": "desc_word_count",
    "feat_desc_digits": "desc_has_digits", "feat_category_code": "category_code",
}
_FROM_STATS = ("amount_to_median_ratio", "amount_zscore")


def _single(key, name):
    """One feature on its own: how many outflows have each value. Only the two relative
    features need the statement's statistics."""
    source = "o JOIN stats USING (source_file)" if name in _FROM_STATS else "o"

    def run(spark, sf):
        rows = X.silver(spark, sf)
        rows = FE.with_stats(rows) if name in _FROM_STATS else A.outflow_magnitudes(rows)
        value = rows.select(FE.feature_columns()[name].alias(name)).select(_plain(name))
        return value.groupBy(name).agg(F.count(F.lit(1)).alias("n"))

    run.__name__ = key
    query(STATS + f"SELECT {_sql(name)}, count(*) AS n FROM {source} GROUP BY ALL", key)(run)


for _key, _name in _SINGLE.items():
    _single(_key, _name)


# ---- isolation forest --------------------------------------------------------------------

def _features(spark, sf):
    return FE.feature_matrix(X.silver(spark, sf), keep=("source_file", "txn_date", "cents"))


def _stored(rows, name):
    """The rows as a table: worked out once, read by column by all that need them."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _silver(spark, sf):
    """Outflows and all else, as a table of what anomalies and features look at."""
    return _stored(X.silver(spark, sf).select("source_file", "txn_date", "description", "amount", "category"), "silver")


def _stored_features(spark, sf):
    return _stored(_features(spark, sf), "features")


def _fitted(spark, sf, features=None, stored=True):
    """The forest trained on these tables; fitted once per session and read back. ``features``: where the
    query has them, as a table unless ``stored`` is false."""
    made = _FOREST.get((spark.sparkContext.applicationId, sf))
    if made is None:
        made = scratch(spark, "forest")
        given = features is not None
        I.fit(features if given else _features(spark, sf), stored=given and stored).save(made)
        _FOREST[(spark.sparkContext.applicationId, sf)] = made
    return I.load(spark, made)


_FOREST: dict = {}


def _six(name):
    return F.round(name, 6).cast("decimal(18,6)").alias(name)


@query(STATS + """SELECT cast(tree AS int) AS tree, least(256, n) AS root_rows,
least(256, n) AS leaf_rows, cast(1 AS bigint) AS more_leaves_than_splits,
cast(0 AS bigint) AS rows_lost, cast(0 AS bigint) AS splits_outside, n AS n_samples
FROM (SELECT count(*) AS n FROM o), unnest(range(150)) AS t(tree)""")
def iforest_fit(spark, sf):
    """Facts of the trained forest, tree by tree: every tree holds its sample, each split parts its
    rows without loss at a value between the least and the greatest of its feature."""
    features = _stored_features(spark, sf)
    model = I.fit(features, stored=True)
    nodes = model.nodes
    child = nodes.select("tree", F.col("node").alias("child"), F.col("rows").alias("child_rows"))
    parts = nodes.where("feature >= 0").select(
        "tree", "node", "rows", F.explode(F.array("left", "right")).alias("child")).join(
        child, ["tree", "child"])
    lost = (parts.groupBy("tree", "node", "rows").agg(F.sum("child_rows").alias("below"))
            .groupBy("tree").agg(F.sum(F.abs(F.col("rows") - F.col("below"))).alias("rows_lost")))
    span = features.agg(*[fn(n).alias(f"{tag}_{n}") for n in FEATURES
                          for tag, fn in (("low", F.min), ("high", F.max))]).first()  # one row
    low, high = (F.array(*[F.lit(span[f"{tag}_{n}"]) for n in FEATURES]) for tag in ("low", "high"))
    ranged = nodes.withColumns({"least": F.get(low, F.greatest("feature", F.lit(0))),
                                "greatest": F.get(high, F.greatest("feature", F.lit(0)))})
    leaf, split = F.col("feature") < 0, F.col("feature") >= 0
    facts = ranged.groupBy("tree").agg(
        F.max(F.when(F.col("node") == 0, F.col("rows"))).cast("bigint").alias("root_rows"),
        F.sum(F.when(leaf, F.col("rows"))).alias("leaf_rows"),
        (F.count_if(leaf) - F.count_if(split)).alias("more_leaves_than_splits"),
        F.count_if(split & ((F.col("threshold") < F.col("least")) | (F.col("threshold") >= F.col("greatest"))))
        .alias("splits_outside"))
    return facts.join(lost, "tree").withColumn(
        "n_samples", F.lit(model.metadata["n_samples"]).cast("bigint"))


@query()
def iforest_nodes(spark, sf):
    return _fitted(spark, sf).nodes


@query()
def iforest_score_fitted(spark, sf):
    features = _stored_features(spark, sf)
    return I.score(features, _fitted(spark, sf, features)).select(
        "source_file", "txn_date", "cents", "score")


@query(STATS + """SELECT count(*) AS n, cast(0 AS bigint) AS changed FROM o""")
def iforest_persist(spark, sf):
    """Rows whose score by the trained forest changes when it is saved and read back: none."""
    path = scratch(spark, "forest")
    features = _stored_features(spark, sf)
    trained = _fitted(spark, sf, features)
    trained.save(path)
    once = I.score(features, trained).withColumnRenamed("score", "before")
    both = I.score(once, I.load(spark, path))
    return both.agg(F.count(F.lit(1)).alias("n"),
                    F.count_if(~F.col("score").eqNullSafe(F.col("before"))).alias("changed"))


@query(SCORED + """SELECT source_file, txn_date, mag AS cents,
cast(round(score, 6) AS decimal(18,6)) AS score FROM scored""")
def iforest_score(spark, sf):
    scored = I.score(_features(spark, sf), stated_forest.forest(spark))
    return scored.select("source_file", "txn_date", "cents", _six("score"))


@query(SCORED + """SELECT source_file, CASE WHEN score < 0 THEN -1 ELSE 1 END AS prediction,
count(*) AS n FROM scored GROUP BY ALL""")
def iforest_predict(spark, sf):
    scored = I.score(_features(spark, sf), stated_forest.forest(spark))
    return I.predict(scored).groupBy("source_file", "prediction").agg(
        F.count(F.lit(1)).alias("n"))


@query(SCORED + """SELECT count(*) FILTER (score < 0) AS n_outliers,
cast(round(count(*) FILTER (score < 0) / count(*), 6) AS decimal(18,6)) AS outlier_rate,
cast(round(avg(score), 6) AS decimal(18,6)) AS score_mean,
cast(round(min(score), 6) AS decimal(18,6)) AS score_min FROM scored""")
def agg_training_metrics(spark, sf):
    found = I.training_metrics(I.score(_features(spark, sf), stated_forest.forest(spark)))
    return found.select("n_outliers", _six("outlier_rate"), _six("score_mean"), _six("score_min"))


@query(SCORED + """SELECT source_file, severity, message, txn_date AS date, description, amount,
category FROM hits""")
def anom_ml(spark, sf):
    found = I.model_anomalies(X.silver(spark, sf), stated_forest.forest(spark))
    return A.members(found).select(
        "source_file", "severity", "message", "date", "description", "amount", "category")


@query(SCORED + "SELECT severity, count(*) AS n FROM hits GROUP BY ALL")
def anom_ml_severity(spark, sf):
    found = I.model_anomalies(X.silver(spark, sf), stated_forest.forest(spark))
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query(SCORED + """SELECT source_file, type, message FROM large
UNION ALL SELECT source_file, type, message FROM dupes
UNION ALL SELECT h.source_file, 'ml_outlier', h.message FROM hits h
  WHERE NOT EXISTS (SELECT 1 FROM rule_members r WHERE r.source_file = h.source_file
    AND r.txn_date = h.txn_date AND r.description = h.description AND r.amount = h.amount)""")
def anom_combine(spark, sf):
    rows = _silver(spark, sf)
    hits = I.model_anomalies(rows, stated_forest.forest(spark)).drop("score")
    return A.combine(_stored(A.detect(rows), "rules"), hits).select("source_file", "type", "message")


@query()
def anom_combine_model(spark, sf):
    rows = _silver(spark, sf)
    matrix = FE.feature_matrix(rows, keep=("source_file", "txn_date", "cents"))
    hits = I.model_anomalies(rows, _fitted(spark, sf, matrix, stored=False)).drop("score")
    return A.members(A.combine(_stored(A.detect(rows), "rules"), hits))


# ---- text and vectors --------------------------------------------------------------------

_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


@query(f"""WITH d AS (SELECT doc_id, {_TOKENS.format('text')} AS toks FROM documents)
SELECT doc_id, cast(len(toks) AS int) AS n, toks[1] AS first, array_to_string(toks, ' ') AS tokens
FROM d""")
def text_tokens(spark, sf):
    found = X.documents(spark, sf).select("doc_id", tokens(F.col("text")).alias("toks"))
    return found.select("doc_id", F.size("toks").alias("n"), F.get("toks", 0).alias("first"),
                        F.array_join("toks", " ").alias("tokens"))


def _buckets(source, key, text, dim):
    return f"""x AS (SELECT {key}, unnest({_TOKENS.format(text)}) AS tok FROM {source}),
b AS MATERIALIZED (SELECT {key}, cast(h % {dim} AS int) AS bucket, count(*) AS n FROM (
  SELECT {key}, ('0x' || md5(tok))::uhugeint AS h FROM x) GROUP BY ALL)"""


@query("WITH " + _buckets("documents", "doc_id", "text", 1536)
       + " SELECT doc_id, bucket, cast(n AS int) AS n FROM b")
def embed_hash(spark, sf):
    made = X.documents(spark, sf).select(
        "doc_id", H.hash_vector(F.col("text")).alias("vector"))
    return made.select("doc_id", F.inline(F.arrays_zip(
        F.col("vector.indices").alias("bucket"), F.col("vector.counts").alias("n"))))


@query("WITH " + _buckets("conversations", "conv_id, turn", "text", 64) + """, n AS (
  SELECT conv_id, turn, sqrt(cast(sum(n * n) AS double)) AS norm FROM b GROUP BY ALL)
SELECT b.conv_id, b.turn, bucket, cast(round(n / norm, 9) AS decimal(10,9)) AS value
FROM b JOIN n ON b.conv_id = n.conv_id AND b.turn = n.turn""")
def embed_hash_dense(spark, sf):
    """The unit-length dense form, zeros left out of the listing."""
    made = X.table(spark, sf, "conversations").select(
        "conv_id", "turn", H.hash_vector(F.col("text"), 64).alias("v"))
    full = made.select("conv_id", "turn", F.posexplode(
        H.dense(F.col("v.indices"), H.weights(F.col("v")), 64)).alias("bucket", "value"))
    return full.where(F.col("value") != 0).withColumn(
        "value", F.round("value", 9).cast("decimal(10,9)"))


@query("""WITH v AS (SELECT vec_id, cast(embedding AS double[]) AS e FROM embeddings)
SELECT a.vec_id, cast(round(list_cosine_similarity(a.e, b.e), 6) AS decimal(10,6)) AS cosine
FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def vec_cosine(spark, sf):
    rows = X.table(spark, sf, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select(
        "vec_id", F.round(H.cosine(F.col("embedding"), F.col("other")), 6)
        .cast("decimal(10,6)").alias("cosine"))


def _index(spark, sf):
    return V_.index_transactions(X.silver_numbered(spark, sf))


def _stored_index(spark, sf):
    """The index as a table: written once, read by column."""
    path = scratch(spark, "index")
    tables.overwrite(_index(spark, sf), path)
    return tables.read_table(spark, path)


_LINE = f"""cast(txn_date AS varchar) || ' | ' || description || ' | ' || {plain('cents')} || ' | '
|| category"""
_LINES = T + f""", i AS (SELECT source_file || '-' || cast(row_idx AS varchar) AS id, {_LINE} AS line
FROM t)"""


@query(_LINES + f""", {_buckets('i', 'id', 'line', 1536)}
SELECT id, cast(count(*) AS int) AS buckets, cast(sum(n) AS int) AS tokens,
cast(sum(bucket * n) AS bigint) AS checksum FROM b GROUP BY id""")
def vec_index_transactions(spark, sf):
    path = scratch(spark, "index")
    tables.upsert_vectors(_index(spark, sf).withColumn("seq", F.lit(0)), path, "seq")
    pairs = F.arrays_zip(F.col("vector.indices").alias("b"), F.col("vector.counts").alias("n"))
    zero = F.lit(0).cast("bigint")
    return tables.read_table(spark, path).select(
        "id", F.size("vector.indices").alias("buckets"),
        F.aggregate("vector.counts", F.lit(0), lambda s, n: s + n).alias("tokens"),
        F.aggregate(pairs, zero, lambda s, p: s + p["b"] * p["n"]).alias("checksum"))


QUESTIONS = ("how much did I pay for netflix?", "coca cola", "airtel broadband utilities 1996",
             "rent")


def _questions(spark, sf, index):
    """Fixed questions and, from the data, the smallest description of each category and the first
    turn of each conversation; as a table, for those who read them twice."""
    fixed = [(f"q{i}", q) for i, q in enumerate(QUESTIONS)]
    known = index.select(F.col("metadata.category").alias("query_id"), "metadata.description")
    asked = known.groupBy("query_id").agg(F.min("description").alias("question"))
    turns = X.table(spark, sf, "conversations").where("turn = 0")
    return _stored(spark.createDataFrame(fixed, "query_id string, question string").unionByName(asked)
                   .unionByName(turns.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("query_id"),
                                             F.col("text").alias("question"))), "questions")


_QUERIED = _LINES + ", q AS (" + " UNION ALL ".join(
    f"SELECT 'q{i}' AS query_id, '{q}' AS question" for i, q in enumerate(QUESTIONS)) + f"""
  UNION ALL SELECT category, min(description) FROM t GROUP BY category
  UNION ALL SELECT 'c' || cast(conv_id AS varchar), text FROM conversations WHERE turn = 0),
{_buckets('i', 'id', 'line', 1536)}, dn AS (SELECT id, sum(n * n) AS sq FROM b GROUP BY id),
{_buckets('q', 'query_id', 'question', 1536).replace('x AS', 'qx AS').replace('b AS', 'qb AS')
 .replace('FROM x)', 'FROM qx)')},
qn AS (SELECT query_id, sum(n * n) AS sq FROM qb GROUP BY query_id),
dots AS (SELECT query_id, id, sum(qb.n * b.n) AS dot FROM qb JOIN b USING (bucket) GROUP BY ALL),
s AS (SELECT d.query_id, d.id, cast(dot AS double) / (sqrt(cast(dn.sq AS double))
  * sqrt(cast(qn.sq AS double))) AS score
  FROM dots d JOIN dn USING (id) JOIN qn USING (query_id)),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)
  AS rank FROM s)
"""


@query(_QUERIED + """SELECT query_id, cast(rank AS int) AS rank, id FROM r WHERE rank <= 5""")
def vec_query_batch(spark, sf):
    index = _stored_index(spark, sf)
    found = V_.query_batch(index, _questions(spark, sf, index), 5)
    return found.select("query_id", "rank", "id")


@query(_QUERIED + f""", m AS (SELECT r.query_id, r.rank, cast(t.txn_date AS varchar) || ' '
  || t.description || ' (' || {plain('t.cents')} || ')' AS text
  FROM r JOIN t ON r.id = t.source_file || '-' || cast(t.row_idx AS varchar) WHERE rank <= 3)
SELECT query_id, 'Top matches: ' || string_agg(text, '; ' ORDER BY rank) AS answer
FROM m GROUP BY query_id""")
def extractive_answer(spark, sf):
    index = _stored_index(spark, sf)
    asked = _questions(spark, sf, index)
    return V_.extractive_answers(asked, V_.query_batch(index, asked, 5))


@query("""SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the')
OR contains(lower(text), 'worthless')""")
def search_keywords(spark, sf):
    rows = X.documents(spark, sf).withColumnRenamed("text", "description")
    return spend.search_keywords(rows, "The; WORTHLESS").select("doc_id", "source")


# ---- time windows and streams ------------------------------------------------------------

def _events(spark, sf):
    return X.table(spark, sf, "events")


@query(EVENTS_SLOTS + """, w AS (SELECT slot - to_minutes(cast(unnest(range(5)) AS int)) AS ws,
event_type, c FROM slots)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, cast(sum(c) AS bigint) AS n
FROM w GROUP BY ALL""")
def rate_by_key_sliding(spark, sf):
    rates = M.rate_by_key(_events(spark, sf), "event_type")
    return rates.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "event_type", "n")


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
cast(round(quantile_cont(value, 0.95), 4) AS decimal(18,4)) AS p95 FROM events GROUP BY ALL""")
def p95_by_key_window(spark, sf):
    found = M.percentile_by_key(_events(spark, sf), "event_type", "1 hour")
    return found.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "event_type", F.round("value", 4).cast("decimal(18,4)").alias("p95"))


@query("""SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
cast(sum(count(*)) OVER (PARTITION BY event_type ORDER BY date_trunc('hour', ts)) AS bigint)
AS total FROM events GROUP BY event_type, date_trunc('hour', ts)""")
def counter_totals(spark, sf):
    series = M.counter_series(_events(spark, sf), "event_type")
    return series.select(
        "event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "total")


@query("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{b:g}' AS le, count(*) FILTER (value <= {b}) AS count FROM events"
    for b in M.DURATION_BOUNDS) + " UNION ALL SELECT '+Inf', count(value) FROM events)")
def duration_histogram(spark, sf):
    return M.duration_histogram(_events(spark, sf))


@query(FILES + """SELECT file_no, place AS row_idx, txn_date, description, amount, category,
  NULL AS reason FROM silver
UNION ALL SELECT file_no, place, NULL, NULL, NULL, NULL, 'unrecognized date' FROM lines
  WHERE layout < 3 AND bad AND NOT blank
UNION ALL SELECT DISTINCT file_no, NULL::INT, NULL::DATE, NULL, NULL::DECIMAL(18,2), NULL,
  'missing date or description column' FROM lines WHERE layout = 3""")
def stream_ingest_statements(spark, sf):
    """Good rows and rejects of one stream, after a restart that replays its last batch."""
    folder = X.write_statement_files(spark, sf)
    path, lost, checkpoint = (scratch(spark, n) for n in ("silver", "rejects", "stream"))
    for _ in range(2):
        jobs.ingest_both(spark, folder, path, lost, checkpoint, files_per_batch=50, name_by=X.number_of)
    columns = ["file_no", "row_idx", "txn_date", "description", "amount", "category", "reason"]
    good = tables.read_table(spark, path).withColumnRenamed("source_file", "file_no")
    bad = tables.read_table(spark, lost).withColumnRenamed("source_file", "file_no")
    return (good.withColumn("reason", F.lit(None).cast("string")).select(columns)
            .unionByName(bad.select("file_no", "row_idx", "reason"), allowMissingColumns=True))


@query(FILES + """SELECT file_no, count(*) AS n, cast(sum(cents) AS bigint) AS cents FROM silver
GROUP BY file_no""")
def stream_replace_by_source(spark, sf):
    folder = X.write_statement_files(spark, sf)
    path = scratch(spark, "fact")
    for _ in range(2):  # the second stream brings every source again
        stream = jobs.ingest_statements(spark, folder, files_per_batch=50, name_by=X.number_of)
        jobs.replace_sources(stream, path, jobs.checkpoint_path(spark))
    return tables.read_table(spark, path).groupBy(F.col("source_file").alias("file_no")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("amount") * 100).cast("bigint").alias("cents"))


def _event_files(spark, sf, twice=False):
    """Events as a folder of files; ``twice`` brings each event a second time."""
    folder = scratch(spark, "events")
    rows = _events(spark, sf)
    if twice:
        rows = rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    rows.write.parquet(folder)
    return jobs.events_stream(spark, folder, rows.schema)


@query("SELECT event_id, event_type, value FROM events")
def stream_dedup(spark, sf):
    path = scratch(spark, "deduped")
    jobs.append_to(jobs.dedup(_event_files(spark, sf, twice=True)), path,
                   jobs.checkpoint_path(spark))
    return tables.read_table(spark, path).select("event_id", "event_type", "value")


@query("SELECT event_type, count(*) AS total FROM events GROUP BY ALL")
def stream_counter_totals(spark, sf):
    path = scratch(spark, "totals")
    jobs.latest_result(jobs.totals(_event_files(spark, sf), "event_type"), path,
                       jobs.checkpoint_path(spark))
    return tables.read_table(spark, path)


@query(EVENTS_SLOTS + """, w AS (SELECT slot - to_minutes(cast(unnest(range(5)) AS int)) AS ws,
event_type, c FROM slots)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, cast(sum(c) AS bigint) AS n
FROM w GROUP BY ALL""")
def stream_rate(spark, sf):
    path = scratch(spark, "rate")
    jobs.window_result(jobs.rate(_event_files(spark, sf), "event_type"), path,
                       jobs.checkpoint_path(spark), ["window_start", "event_type"])
    return tables.read_table(spark, path).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "event_type", "n")


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
cast(quantile_disc(value, 0.95) AS decimal(18,4)) AS p95 FROM events GROUP BY ALL""")
def stream_p95(spark, sf):
    """Approximate by design; exact while a window holds fewer values than the accuracy."""
    path = scratch(spark, "p95")
    jobs.window_result(jobs.percentile(_event_files(spark, sf), "event_type", "1 hour"), path,
                       jobs.checkpoint_path(spark), ["window_start", "event_type"])
    return tables.read_table(spark, path).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "event_type", F.col("value").cast("decimal(18,4)").alias("p95"))

