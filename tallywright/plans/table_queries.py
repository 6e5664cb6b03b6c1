"""Conform, projections, joins, aggregations, windows, sorts, set operations, star schema."""

from pyspark.sql import functions as F

from ..functions import text as text_fns
from ..functions import values as V
from ..operators import anomaly as A
from ..operators import conform as C
from ..operators import features as FE
from ..operators import iforest as I
from ..operators import replies as R
from ..operators import retrieval as V_
from ..operators import skew, spend, star
from ..schema import CATEGORIES
from ..session import scratch
from ..sources import statements, tables
from . import fixtures as X
from . import stated_forest
from .oracle import (ANOMALIES, FILES, STATS, T, category_key, category_of, half_even, listed,
                     one_of, plain)
from .registry import query
from .stated_forest import SCORED
from .source_queries import _DIM_DATE, _PERSONAL, gold, loaded_gold, union_parts

SUM = "decimal(38,2)"


def money_sum(column, name):
    return F.sum(column).cast(SUM).alias(name)


# ---- conform and projections -------------------------------------------------------------

@query(FILES + """SELECT file_no, place AS row_idx, raw_date, CASE WHEN layout < 3 THEN raw_text END
AS raw_description, raw_amount, raw_debit, raw_credit FROM (SELECT * REPLACE (
  CASE WHEN layout < 3 THEN raw_date END AS raw_date) FROM lines)""")
def conform_columns(spark, sf):
    return C.conform_columns(X.bronze(spark, sf)).select(
        F.col("source_file").alias("file_no"), "row_idx", "raw_date", "raw_description",
        "raw_amount", "raw_debit", "raw_credit")


@query(FILES + """SELECT DISTINCT file_no, 'missing date or description column' AS reason
FROM lines WHERE layout = 3""")
def conform_required(spark, sf):
    return statements.file_rejects(X.statement_files(spark, sf)).select(
        F.col("source_file").alias("file_no"), "reason")


_MESSY = """WITH m AS (SELECT l_orderkey, cast(round(l_extendedprice * 100) AS bigint) AS cents
FROM lineitem) """


@query(_MESSY + """SELECT l_orderkey, CASE WHEN l_orderkey % 6 < 4 THEN
  cast(CASE WHEN l_orderkey % 6 = 2 THEN -1 ELSE 1 END * cents * 0.01 AS decimal(18,2)) END
  AS amount FROM m""")
def parse_amount(spark, sf):
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    digits = F.concat((F.floor(cents / 100)).cast("string"), F.lit("."),
                      F.lpad((cents % 100).cast("string"), 2, "0"))
    kind = F.col("l_orderkey") % 6
    messy = (F.when(kind == 0, digits).when(kind == 1, F.concat(F.lit(" ₹ "), X._money(cents)))
             .when(kind == 2, F.concat(F.lit("-"), X._money(cents), F.lit("\t")))
             .when(kind == 3, F.concat(F.lit("+"), digits))
             .when(kind == 4, F.lit(" - ")).otherwise(F.concat(digits, F.lit(" Cr"))))
    return X.spread(X.table(spark, sf, "lineitem")).select(
        "l_orderkey", V.parse_amount(messy).alias("amount"))


@query("""WITH m AS (SELECT o_orderkey, cast(o_orderdate AS date) AS d FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN NULL
  WHEN o_orderkey % 8 = 3 AND day(d) <= 12 THEN make_date(year(d), day(d), month(d))
  ELSE d END AS txn_date FROM m""")
def parse_date(spark, sf):
    formats = ("yyyy-MM-dd", "dd-MM-yyyy", "d/M/yyyy", "M/d/yyyy", "dd-MMM-yyyy", "d MMM yyyy",
               "yyyy-M-d", "'on' yyyy")
    rows = X.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    kind = F.col("o_orderkey") % 8
    text = F.lit(None).cast("string")
    for n, layout in enumerate(formats):
        text = F.when(kind == n, F.date_format("d", layout)).otherwise(text)
    return rows.select("o_orderkey", V.parse_date(F.concat(F.lit(" "), text)).alias("txn_date"))


@query(FILES + """SELECT file_no, count(*) FILTER (layout < 3 AND NOT blank AND NOT bad) AS kept,
count(*) FILTER (layout = 3 OR (bad AND NOT blank)) AS rejected FROM lines GROUP BY file_no""")
def filter_blank_date(spark, sf):
    rows = X.bronze(spark, sf)
    kept = C.conform(rows).select("source_file", F.lit(1).alias("k"), F.lit(0).alias("r"))
    lost = C.rejects(rows).select("source_file", F.lit(0).alias("k"), F.lit(1).alias("r"))
    return kept.unionByName(lost).groupBy(F.col("source_file").alias("file_no")).agg(
        F.sum("k").alias("kept"), F.sum("r").alias("rejected"))


@query(FILES + "SELECT file_no, place AS row_idx, amount FROM good")
def signed_amount(spark, sf):
    return C.conform(X.bronze(spark, sf)).select(
        F.col("source_file").alias("file_no"), "row_idx", "amount")


@query(T + "SELECT raw_description AS description, count(*) AS n FROM t GROUP BY ALL")
def trim_description(spark, sf):
    padded = F.concat(F.lit("\t \n"), "raw_description", F.lit("  \r\n"))
    return (X.silver(spark, sf).select(V.strip(padded).alias("description"))
            .groupBy("description").agg(F.count(F.lit(1)).alias("n")))


@query(T + "SELECT source_file, cents < 0 AS is_outflow, count(*) AS n FROM t GROUP BY ALL")
def flag_outflow(spark, sf):
    flagged = X.silver(spark, sf).withColumn("is_outflow", V.is_outflow(F.col("amount")))
    return flagged.groupBy("source_file", "is_outflow").agg(F.count(F.lit(1)).alias("n"))


@query(T + "SELECT source_file, txn_date, description, amount FROM t WHERE cents < 0")
def filter_outflows(spark, sf):
    return spend.outflows(X.silver(spark, sf)).select(
        "source_file", "txn_date", "description", "amount")


@query(T + """SELECT source_file, min(row_idx) AS row_idx, txn_date, description, amount
FROM t GROUP BY source_file, txn_date, description, amount""")
def dedup_silver(spark, sf):
    rows = X.silver_numbered(spark, sf).drop("raw_description", "cents")
    return C.dedup_silver(rows).select(
        "source_file", "row_idx", "txn_date", "description", "amount")


@query(T + "SELECT source_file, txn_date, cents, description FROM t")
def redact_pii(spark, sf):
    return X.raw_transactions(spark, sf).select(
        "source_file", "txn_date", "cents",
        text_fns.redact(F.col("raw_description")).alias("description"))


@query()
def redact_pii_documents(spark, sf):
    """Long texts in several scripts; checked against Python's re in the tests."""
    return X.documents(spark, sf).select(
        "doc_id", text_fns.redact(F.col("text")).alias("text"))


@query(T + f"SELECT raw_description, {category_of('raw_description')} AS category, count(*) AS n "
       "FROM t GROUP BY ALL")
def categorize_rules(spark, sf):
    rows = X.raw_transactions(spark, sf)
    return (rows.select("raw_description",
                        text_fns.categorize(F.col("raw_description")).alias("category"))
            .groupBy("raw_description", "category").agg(F.count(F.lit(1)).alias("n")))


@query(T + """SELECT source_file, CASE WHEN cents % 2 = 0 THEN 'rent' ELSE category END AS category,
count(*) AS n FROM t GROUP BY ALL""")
def categorize_missing(spark, sf):
    rows = X.silver(spark, sf).withColumn(
        "category", F.when(F.col("cents") % 2 == 0, "rent"))
    return (C.fill_categories(rows).groupBy("source_file", "category")
            .agg(F.count(F.lit(1)).alias("n")))


def _batches(spark, sf):
    """20 consecutive rows of a statement are one batch."""
    rows = X.silver_numbered(spark, sf).withColumn("b", F.floor(F.col("row_idx") / 20))
    batch_id = F.concat_ws("/", "source_file", F.col("b").cast("string"))
    return rows.withColumn("batch_id", batch_id)


def label_batches(spark, sf):
    """Batches with model replies: plain, fenced, in prose, broken, and too short."""
    label = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]),
                         (F.abs("cents") % 14 + 1).cast("int"))
    row = F.struct("row_idx", "description", label.alias("label"))
    # a batch has at most 20 rows
    made = _batches(spark, sf).groupBy("batch_id", "b").agg(
        F.sort_array(F.collect_list(row)).alias("rows"))
    labels, kind = F.col("rows.label"), F.col("b") % 5
    array = F.to_json(F.transform(labels, lambda c: F.when(c == "rent", "no such").otherwise(
        F.upper(c))))
    short = F.to_json(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))))
    reply = (F.when(kind == 0, array).when(kind == 1, F.concat(F.lit("```json\n"), array, F.lit("\n```")))
             .when(kind == 2, F.concat(F.lit("Sure! Here: "), array, F.lit(" - done")))
             .when(kind == 3, F.lit('["dining", ')).otherwise(short))
    return made.select("batch_id", reply.alias("reply"), F.col("rows.description").alias("descriptions"))


@query(T + f""", x AS (SELECT source_file || '/' || cast(row_idx // 20 AS varchar) AS batch_id,
  row_idx % 20 AS pos, description, category, {one_of(CATEGORIES, 'abs(cents) % 14')} AS label,
  row_idx // 20 % 5 AS kind,
  count(*) OVER (PARTITION BY source_file, row_idx // 20) AS n FROM t)
SELECT batch_id, cast(pos AS int) AS pos, description, CASE WHEN kind = 3 THEN category
  WHEN kind = 4 THEN CASE WHEN pos < greatest(n - 1, 1) THEN label ELSE category END
  WHEN label = 'rent' THEN category ELSE label END AS category FROM x""")
def apply_model_labels(spark, sf):
    return R.apply_model_labels(label_batches(spark, sf))


def extraction_replies(spark, sf):
    """Replies with transactions, some fields missing or unusable, some replies broken."""
    kind = F.col("row_idx") % 7
    amount = (F.col("amount").cast("string"))
    item = F.struct(
        F.when(kind == 1, F.lit("soon")).when(kind != 2, F.col("txn_date").cast("string"))
        .alias("date"),
        F.when(kind != 3, F.concat(F.lit("  "), "description")).alias("description"),
        F.when(kind == 4, F.lit("about ten")).when(kind == 5, F.lit("0.00")).otherwise(amount)
        .alias("amount"))
    made = _batches(spark, sf).groupBy("batch_id", "b").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("row_idx", item.alias("item")))),
                    lambda r: r["item"]).alias("transactions"))
    body = F.to_json(F.struct("transactions"))
    reply = (F.when(F.col("b") % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
             .when(F.col("b") % 4 == 3, F.substring(body, 1, 30)).otherwise(body))
    return made.select(F.col("batch_id").alias("reply_id"), reply.alias("reply"))


@query(T + f""", x AS (SELECT *, row_idx % 7 AS kind, CASE WHEN row_idx % 7 = 3 THEN 'unknown'
  ELSE trim(substr('  ' || description, 1, 120)) END AS said FROM t)
SELECT source_file || '/' || cast(row_idx // 20 AS varchar) AS reply_id, row_idx % 20 AS pos,
  CASE WHEN kind IN (1, 2) THEN DATE '2024-06-01' ELSE txn_date END AS txn_date,
  said AS description, amount, {category_of('said')} AS category FROM x
WHERE kind NOT IN (4, 5) AND cents <> 0 AND row_idx // 20 % 4 <> 3""")
def parse_extractions(spark, sf):
    return R.parse_extractions(extraction_replies(spark, sf), "2024-06-01").select(
        "reply_id", "pos", "txn_date", "description", "amount", "category")


_KINDS = ("Bills", "Food", "Grocery", "Fuel", "Entertainment", "Travel", "Hotel stay")


@query(f"""WITH k AS (SELECT o_orderkey, {one_of(_KINDS, 'o_orderkey % 7')} AS kind FROM orders)
SELECT kind, CASE kind WHEN 'Bills' THEN 'utilities' WHEN 'Food' THEN 'dining' WHEN 'Grocery'
THEN 'groceries' WHEN 'Fuel' THEN 'transport' WHEN 'Entertainment' THEN 'entertainment'
ELSE 'travel' END AS category, count(*) AS n FROM k GROUP BY ALL""")
def map_expense_type(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]),
                        (F.col("o_orderkey") % 7 + 1).cast("int"))
    rows = X.table(spark, sf, "orders").select(kind.alias("kind"))
    mapped = V.expense_category(F.col("kind"), text_fns.categorize(F.col("kind")))
    return rows.groupBy("kind", mapped.alias("category")).agg(F.count(F.lit(1)).alias("n"))


_FLOWS = ("debit", "credit", "withdrawal", "deposit", "payment", "transfer_out", "transfer_in",
          "purchase", "refund", "other")


@query(f"""WITH k AS (SELECT {one_of(_FLOWS, 'o_orderkey % 10')} AS kind, cast(round(
  o_totalprice * 100) AS bigint) AS cents FROM orders)
SELECT kind, CASE WHEN kind IN ('credit', 'deposit', 'transfer_in', 'refund') THEN 1 ELSE -1 END
AS sign, cast(sum(cents) AS bigint) AS cents FROM k GROUP BY ALL""")
def map_flow_sign(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in _FLOWS]),
                        (F.col("o_orderkey") % 10 + 1).cast("int"))
    rows = X.table(spark, sf, "orders").select(
        kind.alias("kind"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("c"))
    sign = V.flow_sign(F.concat(F.lit(" "), F.upper("kind")))
    return rows.groupBy("kind", sign.alias("sign")).agg(F.sum("c").alias("cents"))


@query(T + f"""SELECT source_file, cast(txn_date AS varchar) || ' | ' || description || ' | '
|| {plain('cents')} || ' | ' || category AS line FROM t""")
def compose_text(spark, sf):
    return X.silver(spark, sf).select("source_file", text_fns.index_line(
        F.col("txn_date"), F.col("description"), F.col("amount"), F.col("category")).alias("line"))


@query("SELECT doc_id, substr(text, 1, 100) AS head, substr(text, 1, 120) AS longer FROM documents")
def truncate_text(spark, sf):
    return X.documents(spark, sf).select(
        "doc_id", F.substring("text", 1, 100).alias("head"),
        F.substring("text", 1, 120).alias("longer"))


@query(T + "SELECT strftime(txn_date, '%Y-%m') AS ym, count(*) AS n FROM t GROUP BY ALL")
def year_month(spark, sf):
    return (X.silver(spark, sf).groupBy(V.year_month(F.col("txn_date")).alias("ym"))
            .agg(F.count(F.lit(1)).alias("n")))


@query(T + """SELECT CASE WHEN cents % 3 = 0 THEN 'INR' WHEN cents % 3 IN (1, -2) THEN 'EUR'
ELSE 'USD' END AS currency, count(*) AS n FROM t GROUP BY ALL""")
def default_currency(spark, sf):
    given = F.when(F.pmod("cents", F.lit(3)) == 1, "EUR").when(
        F.pmod("cents", F.lit(3)) == 2, "USD")
    return (X.silver(spark, sf).groupBy(V.default_currency(given).alias("currency"))
            .agg(F.count(F.lit(1)).alias("n")))


@query(T + f"""SELECT CASE WHEN raw_description IN ({listed(CATEGORIES)}) THEN raw_description END
AS by_text, CASE WHEN cents % 4 <> 0 THEN category END AS category, count(*) AS n
FROM t GROUP BY ALL""")
def validate_category(spark, sf):
    named = F.when(F.col("cents") % 4 == 0, F.upper("category")).otherwise(F.col("category"))
    return (X.silver(spark, sf)
            .groupBy(V.valid_category(F.col("raw_description")).alias("by_text"),
                     V.valid_category(named).alias("category"))
            .agg(F.count(F.lit(1)).alias("n")))


# ---- joins -------------------------------------------------------------------------------

@query(T + f"""SELECT txn_date AS full_date, monthname(txn_date) AS month_name,
category AS category_name, description, amount FROM t""")
def join_fact_dims(spark, sf):
    dates, categories, fact = loaded_gold(spark, sf)
    return star.join_dims(fact, dates, categories).select(
        "full_date", "month_name", "category_name", "description", "amount")


# Categories as loads bring them: some missing, some outside the list.
_LOADED = T + """, c AS (SELECT * REPLACE (CASE WHEN cents % 19 = 0 THEN NULL
  WHEN cents % 23 = 0 THEN 'pets' ELSE category END AS category) FROM t),
d AS (SELECT category AS name, cast(dense_rank() OVER (ORDER BY category NULLS FIRST) AS int) AS k
  FROM (SELECT DISTINCT category FROM c))
"""


def loaded_silver(spark, sf):
    """Silver as a written table, which fact rows and dimension are both made from."""
    path = scratch(spark, "silver")
    category = (F.when(F.col("cents") % 19 == 0, F.lit(None)).when(F.col("cents") % 23 == 0, "pets")
                .otherwise(F.col("category")))
    tables.overwrite(X.silver(spark, sf).withColumn("category", category), path)
    return tables.read_table(spark, path)


@query(_LOADED + """SELECT source_file, category, k AS category_key, count(*) AS n
FROM c JOIN d ON c.category IS NOT DISTINCT FROM d.name GROUP BY ALL""")
def join_surrogate_key(spark, sf):
    rows = loaded_silver(spark, sf)
    keyed = star.with_surrogate_key(rows, star.dim_category_ranked(rows))
    return (keyed.groupBy("source_file", "category", "category_key")
            .agg(F.count(F.lit(1)).alias("n")))


@query(STATS + """SELECT o.source_file, o.txn_date, o.description, o.mag AS cents, s.median,
s.n AS outflows, cast(round(s.mean * s.n) AS bigint) AS spent,
cast(round(s.std / 100, 2) AS decimal(18,2)) AS std FROM o JOIN stats s USING (source_file)""")
def join_stats(spark, sf):
    return FE.with_stats(X.silver(spark, sf)).select(
        "source_file", "txn_date", "description", "cents", "median", "outflows",
        F.round(F.col("mean") * F.col("outflows")).cast("bigint").alias("spent"),
        F.round(F.col("std") / 100, 2).cast("decimal(18,2)").alias("std"))


@query(SCORED + """SELECT h.source_file, h.txn_date AS date, h.description, h.amount,
count(*) AS n FROM hits h WHERE NOT EXISTS (SELECT 1 FROM rule_members r
  WHERE r.source_file = h.source_file AND r.txn_date = h.txn_date
    AND r.description = h.description AND r.amount = h.amount) GROUP BY ALL""")
def anti_ml_vs_rules(spark, sf):
    rows = X.silver(spark, sf)
    hits = I.model_anomalies(rows, stated_forest.forest(spark))
    left = A.members(A.without_rule_hits(hits, A.detect(rows)))
    return left.groupBy("source_file", "date", "description", "amount").agg(
        F.count(F.lit(1)).alias("n"))


@query(T + """SELECT DISTINCT cast(strftime(txn_date, '%Y%m%d') AS int) AS date_key
FROM t WHERE txn_date NOT IN (SELECT txn_date FROM t WHERE cents > 0)""")
def anti_merge_not_matched(spark, sf):
    rows = X.silver(spark, sf)
    known = star.dim_date(rows.where(F.col("amount") > 0))
    return tables.not_matched(known, star.dim_date(rows), "date_key").select("date_key")


_UNIT = """WITH v AS (SELECT vec_id, cast(embedding AS double[]) AS e FROM embeddings), s AS (
  SELECT q.vec_id AS query, v.vec_id, round(list_cosine_similarity(q.e, v.e), 12) AS score
  FROM v, v q WHERE q.vec_id % 20 = 0), r AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, cast(vec_id AS varchar))
    AS rank FROM s)
"""


def vectors(spark, sf):
    return X.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"))


def query_vectors(spark, sf):
    return X.table(spark, sf, "embeddings").where(F.col("vec_id") % 20 == 0).select(
        F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("values"))


@query(_UNIT + """SELECT cast(query AS varchar) AS query_id, cast(vec_id AS varchar) AS id,
cast(round(score, 6) AS decimal(10,6)) AS score FROM r WHERE rank <= 50""")
def join_query_vectors(spark, sf):
    found = V_.topk_dense(vectors(spark, sf), query_vectors(spark, sf), 50)
    return found.select("query_id", "id",
                        F.round("score", 6).cast("decimal(10,6)").alias("score"))


# ---- aggregations ------------------------------------------------------------------------

@query(T + """SELECT source_file, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS total_inflow,
sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS total_outflow, sum(amount) AS net,
count(*) AS transaction_count FROM t GROUP BY source_file""")
def agg_statement_totals(spark, sf):
    totals = spend.statement_totals(X.silver(spark, sf))
    return totals.withColumns({c: F.col(c).cast(SUM) for c in
                               ("total_inflow", "total_outflow", "net")})


@query(T + """SELECT source_file, min(txn_date) AS period_start, max(txn_date) AS period_end
FROM t GROUP BY source_file""")
def agg_statement_period(spark, sf):
    return spend.statement_period(X.silver(spark, sf))


@query(T + """SELECT source_file, category, sum(-amount) AS total FROM t WHERE cents < 0
GROUP BY ALL""")
def agg_spend_by_category(spark, sf):
    return spend.spend_by_category(X.silver(spark, sf), ["source_file"]).withColumn(
        "total", F.col("total").cast(SUM))


@query(T + "SELECT category, sum(-amount) AS total FROM t WHERE cents < 0 GROUP BY ALL")
def agg_spend_all_statements(spark, sf):
    return spend.spend_by_category(X.silver(spark, sf)).withColumn(
        "total", F.col("total").cast(SUM))


@query(T + """SELECT 'all' AS what, sum(-amount) AS total, count(*) AS count FROM t WHERE cents < 0
UNION ALL SELECT 'dining 1995-1997', sum(-amount), count(*) FROM t WHERE cents < 0
  AND category = 'dining' AND txn_date BETWEEN '1995-01-01' AND '1997-12-31'
UNION ALL SELECT 'nothing', 0, 0""")
def agg_total_spend(spark, sf):
    rows = X.silver(spark, sf)
    asked = (("all", spend.total_spend(rows, "everything")),
             ("dining 1995-1997", spend.total_spend(rows, "dining", "1995-01-01", "1997-12-31")),
             ("nothing", spend.total_spend(rows, "all", "2999-01-01")))
    parts = [t.select(F.lit(w).alias("what"), F.col("total").cast(SUM).alias("total"), "count")
             for w, t in asked]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_MONTHLY = """SELECT cast(year(txn_date) AS int) AS year, cast(month(txn_date) AS int) AS month,
category AS category_name, sum(CASE WHEN is_outflow THEN -amount ELSE 0 END) AS total_spend,
count(*) AS txn_count FROM t {where} GROUP BY ALL"""


@query(T + _MONTHLY.format(where=""))
def agg_monthly_category_spend(spark, sf):
    dates, categories, fact = gold(spark, sf)
    return star.monthly_category_spend(fact, dates, categories).withColumn(
        "total_spend", F.col("total_spend").cast(SUM))


@query(STATS + """SELECT source_file, median / 100 AS median,
cast(round(mean * n) AS bigint) AS spent,
cast(round(std / 100, 2) AS decimal(18,2)) AS std, n AS outflows FROM stats""")
def agg_statement_stats(spark, sf):
    stats = FE.statement_stats(X.silver(spark, sf))
    return stats.select(
        "source_file", "median",
        F.round(F.col("mean") * 100 * F.col("outflows")).cast("bigint").alias("spent"),
        F.round("std", 2).cast("decimal(18,2)").alias("std"), "outflows")


@query(STATS + """SELECT source_file, description, amount, count(*) AS n,
count(DISTINCT txn_date) AS dates, min(txn_date) AS first_date FROM o
GROUP BY source_file, description, amount HAVING count(*) >= 2""")
def agg_duplicate_groups(spark, sf):
    return A.duplicate_groups(X.silver(spark, sf)).select(
        "source_file", "description", "amount", "n",
        F.size(F.array_distinct("transactions.date")).cast("bigint").alias("dates"),
        F.array_min("transactions.date").alias("first_date"))


@query(ANOMALIES + """SELECT type, count(*) AS n FROM (SELECT type FROM large
UNION ALL SELECT type FROM dupes) GROUP BY type""")
def agg_anomalies_by_type(spark, sf):
    return A.count_by_type(A.detect(X.silver(spark, sf)))


@query(T + """, g AS (SELECT source_file, strftime(txn_date, '%Y-%m') AS ym,
count(*) FILTER (cents < 0) AS outflows, count(*) AS n FROM t GROUP BY ALL)
SELECT source_file, ym, n FROM g WHERE outflows >= 3""")
def agg_pseudo_statements(spark, sf):
    rows = X.silver(spark, sf).withColumn("ym", V.year_month(F.col("txn_date")))
    kept = skew.keep_groups(rows, ["source_file", "ym"], F.col("amount") < 0, 3)
    return kept.groupBy("source_file", "ym").agg(F.count(F.lit(1)).alias("n"))


@query(T + "SELECT category, count(*) AS n, (SELECT count(*) FROM t) AS total FROM t GROUP BY category")
def agg_bronze_count(spark, sf):
    path = scratch(spark, "loaded")
    tables.overwrite(X.silver(spark, sf).select("category", "amount"), path)
    loaded = tables.read_table(spark, path)
    return (loaded.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("total", tables.row_count(loaded).scalar()))


# ---- windows -----------------------------------------------------------------------------

@query(T + """SELECT cast(dense_rank() OVER (ORDER BY category) AS int) AS category_key,
category AS category_name FROM (SELECT DISTINCT category FROM t)""")
def win_category_dense_rank(spark, sf):
    return star.dim_category_ranked(X.silver(spark, sf))


@query(T + """SELECT source_file || ':' || cast(row_idx AS varchar) AS txn_id,
cast(row_idx AS bigint) AS idx, description, amount FROM t""")
def win_row_in_source(spark, sf):
    rows = X.raw_transactions(spark, sf).withColumn(
        "description", text_fns.redact(F.col("raw_description")))
    return star.row_in_source(rows, X.ORDER).select("txn_id", "idx", "description", "amount")


@query(STATS + """SELECT o.source_file, o.mag AS cents, mag / median AS ratio,
cast(round((mag - mean) / CASE WHEN std = 0 THEN 100 ELSE std END, 3) AS decimal(18,3)) AS z
FROM o JOIN stats USING (source_file)""")
def win_within_statement_features(spark, sf):
    made = FE.feature_columns()
    rows = FE.with_stats(X.silver(spark, sf))
    return rows.select("source_file", "cents", (F.col("cents") / F.col("median")).alias("ratio"),
                       F.round(made["amount_zscore"], 3).cast("decimal(18,3)").alias("z"))


@query(T + """SELECT source_file, row_idx, cast(100000 + sum(cents) OVER (PARTITION BY source_file
ORDER BY row_idx) AS bigint) AS balance FROM t""")
def win_running_balance(spark, sf):
    rows = X.numbered(spark, sf).select("source_file", "row_idx", "cents")
    summed = skew.running_total(rows, "source_file", "row_idx", "cents", "balance")
    return summed.select("source_file", "row_idx", (F.col("balance") + 100000).alias("balance"))


_SPEND = T + """, s AS (SELECT source_file, category, cast(sum(-cents) AS bigint) AS c FROM t
WHERE cents < 0 GROUP BY ALL) """


def _spend_cents(spark, sf):
    rows = spend.outflows(X.silver(spark, sf))
    return rows.groupBy("source_file", "category").agg((-F.sum("cents")).alias("total"))


@query(_SPEND + """SELECT source_file, category, cast(c AS double)
/ cast(sum(c) OVER (PARTITION BY source_file) AS double) AS share FROM s""")
def win_share_of_total(spark, sf):
    return spend.share_of_total(_spend_cents(spark, sf), ["source_file"]).drop("total")


@query(_SPEND + """SELECT source_file, category, cast(c AS double)
/ cast(max(c) OVER (PARTITION BY source_file) AS double) AS ratio FROM s""")
def win_share_of_max(spark, sf):
    return spend.share_of_max(_spend_cents(spark, sf), ["source_file"]).drop("total")


@query(T + """SELECT source_file, max(row_idx) AS row_idx,
arg_max(description, row_idx) AS description, arg_max(amount, row_idx) AS amount
FROM t GROUP BY source_file""")
def win_last_write_wins(spark, sf):
    rows = X.silver_numbered(spark, sf).select("source_file", "row_idx", "description", "amount")
    return tables.last_per_key(rows, "source_file", "row_idx")


# ---- sorts and limits --------------------------------------------------------------------

@query(T + """SELECT category, sum(-amount) AS total, row_number() OVER (
ORDER BY sum(-amount) DESC, category) AS place FROM t WHERE cents < 0 GROUP BY category""")
def sort_spend_desc(spark, sf):
    ordered = spend.sort_spend(spend.spend_by_category(X.silver(spark, sf)))
    place = (F.monotonically_increasing_id() + 1).alias("place")  # one partition: 14 rows
    return ordered.coalesce(1).select("category", F.col("total").cast(SUM).alias("total"), place)


@query(T + """SELECT txn_date, source_file || ':' || cast(row_idx AS varchar) AS txn_id, amount
FROM t ORDER BY txn_date, txn_id""")
def sort_store_order(spark, sf):
    rows = star.row_in_source(X.raw_transactions(spark, sf), X.ORDER)
    return star.store_order(rows.select("txn_date", "txn_id", "amount"))


@query(T + """SELECT source_file, row_idx, txn_date, amount FROM t WHERE category = 'dining'
ORDER BY amount DESC, source_file, row_idx""")
def sort_transactions_view(spark, sf):
    rows = X.silver_numbered(spark, sf)
    return spend.transactions_view(rows, "dining", "amount", -1).select(
        "source_file", "row_idx", "txn_date", "amount")


_TERMS = "(contains(lower(description), 'uber') OR contains(lower(description), 'netflix'))"


@query(T + f"""SELECT txn_date, source_file, description, amount,
(SELECT count(*) FROM t WHERE {_TERMS}) AS count FROM t WHERE {_TERMS}
ORDER BY txn_date, source_file, description, amount LIMIT 10""")
def limit_search_hits(spark, sf):
    return spend.search_hits(
        X.silver(spark, sf).select("txn_date", "source_file", "description", "amount"),
        "Uber, NETFLIX!", 10, ["txn_date", "source_file", "description", "amount"])


@query(T + """SELECT category, sum(-amount) AS total FROM t WHERE cents < 0 GROUP BY category
ORDER BY total DESC, category LIMIT 3""")
def topk_categories(spark, sf):
    top = spend.top_categories(spend.spend_by_category(X.silver(spark, sf)), 3)
    return top.withColumn("total", F.col("total").cast(SUM))


@query(_UNIT + """SELECT cast(query AS varchar) AS query_id, cast(vec_id AS varchar) AS id,
cast(rank AS int) AS rank FROM r WHERE rank <= 5""")
def topk_vectors(spark, sf):
    return V_.topk_dense(vectors(spark, sf), query_vectors(spark, sf), 5).drop("score")


# ---- set operations ----------------------------------------------------------------------

@query(ANOMALIES + """SELECT source_file, type, severity, message FROM large
UNION ALL SELECT source_file, type, severity, message FROM dupes""")
def union_anomalies(spark, sf):
    rows = X.silver(spark, sf)
    return (A.large_transactions(rows).unionByName(A.duplicates(rows))
            .select("source_file", "type", "severity", "message"))


_CARD_COUNT = """(SELECT count(*) FROM (SELECT count(*) OVER (PARTITION BY n_name,
strftime(txn_date, '%Y-%m')) AS n FROM o JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey) WHERE n >= 5)"""


@query(T + ", " + _PERSONAL.strip()[len("WITH"):] + f"""
SELECT 'silver' AS part, count(*) AS n FROM t UNION ALL SELECT 'cards', {_CARD_COUNT}
UNION ALL SELECT 'personal', count(*) FROM p""")
def union_sources(spark, sf):
    from ..sources.datasets import union_sources as unite

    parts = [p.withColumn("part", F.lit(n))
             for n, p in zip(("silver", "cards", "personal"), union_parts(spark, sf))]
    return unite(*parts).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(T + "SELECT DISTINCT txn_date FROM t")
def distinct_dates(spark, sf):
    return star.distinct_dates(X.silver(spark, sf))


@query(T + "SELECT DISTINCT category FROM t")
def distinct_categories(spark, sf):
    return star.distinct_categories(X.silver(spark, sf))


# ---- star schema -------------------------------------------------------------------------

@query(T + _DIM_DATE)
def gold_dim_date(spark, sf):
    return star.dim_date(X.silver(spark, sf))


@query(_LOADED + f"""SELECT category AS category_name, {category_key('category')} AS fixed_key,
k AS ranked_key, n FROM (SELECT category, count(*) AS n FROM c GROUP BY category) u
JOIN d ON u.category IS NOT DISTINCT FROM d.name""")
def gold_dim_category(spark, sf):
    """Keys by rank for every category in use, null and unlisted ones too; by list, those are
    the list's last."""
    rows = loaded_silver(spark, sf)
    used = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    ranked = star.with_surrogate_key(used, star.dim_category_ranked(rows))
    ranked = ranked.select("category", F.col("category_key").alias("ranked_key"), "n")
    fixed = star.with_surrogate_key(ranked, star.dim_category_fixed(spark))
    return fixed.select(F.col("category").alias("category_name"),
                        F.coalesce("category_key", F.lit(CATEGORIES.index("other"))).alias("fixed_key"),
                        "ranked_key", "n")


@query(_LOADED + """, x AS (
SELECT cast(strftime(txn_date, '%Y%m%d') AS int) AS date_key, k AS category_key, description,
  amount, is_outflow, currency, source_file FROM c JOIN d ON c.category IS NOT DISTINCT FROM d.name)
SELECT sha256(date_key || '|' || description || '|' || cast(amount AS varchar) || '|'
  || source_file) AS txn_id, * FROM x""")
def gold_fact_transaction(spark, sf):
    rows = loaded_silver(spark, sf)
    return star.fact_transaction(rows, star.dim_category_ranked(rows))


@query(T + f"""SELECT source_file || ':' || cast(row_idx AS varchar) AS txn_id,
cast(strftime(txn_date, '%Y%m%d') AS int) AS date_key, {category_key('category')} AS category_key,
description, amount, is_outflow, currency, source_file FROM t""")
def gold_fact_serving(spark, sf):
    rows = X._silver(X.raw_transactions(spark, sf))
    return star.fact_serving(rows, X.ORDER)


@query(T + _MONTHLY.format(where=""))
def gold_monthly_view(spark, sf):
    """The view over written tables, after a first load was replaced by a second."""
    folder = scratch(spark, "gold")
    dates, categories, fact = gold(spark, sf)
    early = F.col("year") > 1995
    tables.write_gold(folder, dates.where(early), categories, fact.where("amount < 0"))
    tables.write_gold(folder, dates, categories, fact)
    read = [tables.read_table(spark, f"{folder}/{n}")
            for n in ("fact_transaction", "dim_date", "dim_category")]
    return star.monthly_category_spend(*read).withColumn(
        "total_spend", F.col("total_spend").cast(SUM))


@query(ANOMALIES + f""", s AS (SELECT category, cast(sum(-cents) AS bigint) AS c FROM t
  WHERE cents < 0 GROUP BY category), k AS (
  SELECT row_number() OVER (ORDER BY c DESC, category) AS place, * FROM s)
SELECT 0 AS line_no, 'Found ' || (SELECT cast(count(*) AS varchar) FROM (SELECT type FROM large
  UNION ALL SELECT type FROM dupes)) || ' anomalies. ' || (SELECT min(message) FROM large) AS text
UNION ALL SELECT 1, 'Spend by category:'
UNION ALL SELECT cast(place + 1 AS int), '  - ' || category || ': ' || {half_even('c')}
  FROM k WHERE place <= 8""")
def weekly_digest(spark, sf):
    rows = X.silver(spark, sf)
    return star.weekly_digest(spend.spend_by_category(rows), A.detect(rows))
