"""Sources and sinks. Files and tables are written to the shared folder first."""

from pyspark.sql import functions as F

from ..functions.values import date_key, strip
from ..operators import conform as C
from ..operators import star
from ..session import scratch
from ..sources import datasets, statements, tables
from . import fixtures as X
from .oracle import FILES, T, category_key, category_of, one_of
from .registry import query

_CELLS = """CASE layout
  WHEN 0 THEN coalesce(raw_date, '') || '|' || raw_text || '|' || coalesce(raw_debit, '') || '|' || coalesce(raw_credit, '') || '|'
  WHEN 1 THEN raw_amount || '|' || coalesce(raw_date, '') || '|' || raw_text
  WHEN 2 THEN coalesce(raw_date, '') || '|' || raw_text || '|' || coalesce(raw_debit, '') || '|' || coalesce(raw_credit, '') || '|'
  ELSE raw_text || '|1' END"""


def _cell_text():
    return F.array_join("cells", "|", "").alias("cells")


@query(FILES + f"""SELECT file_no, place AS row_idx, header, {_CELLS} AS cells FROM lines""")
def src_statement_csv(spark, sf):
    """Every file by the reader that splits files."""
    rows = statements.read_bronze(spark, X.write_statement_files(spark, sf), 0, X.number_of)
    return rows.select(
        F.col("source_file").alias("file_no"), "row_idx",
        F.array_join("columns", "|").alias("header"), _cell_text())


@query(FILES + """SELECT file_no, count(*) AS n_rows, true AS has_time
FROM lines GROUP BY file_no""")
def src_lineage(spark, sf):
    rows = statements.with_lineage(X.bronze(spark, sf))
    return rows.groupBy(F.col("source_file").alias("file_no")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bool_and(F.col("ingested_at").isNotNull()).alias("has_time"))


@query(FILES + """SELECT 200 AS status, 'csv' AS kind, count(DISTINCT file_no) AS files FROM lines
UNION ALL SELECT 415, 'parquet', count(DISTINCT event_type) FROM events
UNION ALL SELECT CASE WHEN o_orderkey % 5 = 3 THEN 415 WHEN o_orderkey % 7 = 0 THEN 400
  WHEN o_orderkey % 11 = 0 THEN 413 ELSE 200 END, CASE o_orderkey % 5 WHEN 0 THEN 'up.csv'
  WHEN 1 THEN 'up.pdf' WHEN 2 THEN 'up.xlsx' WHEN 3 THEN 'up.exe' ELSE 'up.xls' END, count(*)
FROM orders GROUP BY ALL""")
def src_admission(spark, sf):
    folder = X.write_statement_files(spark, sf)
    kinds = X.table(spark, sf, "events").select("event_type").distinct()
    kinds.withColumn("kind", F.col("event_type")).write.partitionBy("kind").parquet(
        f"{folder}/other")
    # uploads as a gateway lists them, empty and oversized ones among them
    ends = F.element_at(F.array(*[F.lit(e) for e in (".csv", ".PDF", ".xlsx", ".exe", ".xls")]),
                        (F.col("o_orderkey") % 5 + 1).cast("int"))
    length = (F.when(F.col("o_orderkey") % 7 == 0, 0).when(F.col("o_orderkey") % 11 == 0, 10 * 1024**2 + 1)
              .otherwise(F.col("o_custkey") % 1000 + 1))
    uploads = X.table(spark, sf, "orders").select(
        F.concat(F.lit("up/"), F.col("o_orderkey").cast("string"), ends).alias("path"), length.cast("bigint").alias("length"))
    found = statements.admission(statements.list_files(spark, folder).unionByName(uploads))
    name = F.lower("path")
    kind = (F.when(name.startswith("up/"), F.concat(F.lit("up."), F.regexp_extract(name, r"\.(\w+)$", 1)))
            .when(name.endswith(".csv"), "csv").otherwise("parquet"))
    return found.groupBy("status", kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"))


@query(FILES + "SELECT file_no, place AS row_idx, raw_text AS text FROM lines")
def src_row_idx(spark, sf):
    place = (F.when(F.array_contains("columns", "Narration"), 2)
             .when(F.array_contains("columns", "Foo"), 0).otherwise(1))
    # Files of most layouts are above the bound, which sends them to the reader that splits files.
    rows = statements.read_bronze(spark, X.write_statement_files(spark, sf), 250_000, X.number_of)
    return rows.select(F.col("source_file").alias("file_no"), "row_idx",
                       F.get("cells", place).alias("text"))


_ORDERS = """
WITH o AS (
  SELECT *, cast(o_orderdate AS date) AS txn_date,
         cast(round(o_totalprice * 100) AS bigint) AS total_cents
  FROM orders)
"""


@query(_ORDERS + f""", r AS (
  SELECT n_name || '/' || strftime(txn_date, '%Y-%m') AS source_file, txn_date,
         {one_of(("Bills", "Food", "Grocery", "Fuel", "Gifts"), "o_orderkey % 5")} AS kind,
         c_mktsegment, n_name, cast(-trunc(o_totalprice) AS decimal(18,2)) AS amount
  FROM o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), d AS (SELECT *, kind || ' spend ' || c_mktsegment || ' card ' || n_name AS description FROM r),
c AS (SELECT *, CASE kind WHEN 'Bills' THEN 'utilities' WHEN 'Food' THEN 'dining'
  WHEN 'Grocery' THEN 'groceries' WHEN 'Fuel' THEN 'transport' ELSE {category_of('description')}
  END AS category, count(*) OVER (PARTITION BY source_file) AS n FROM d)
SELECT source_file, txn_date, description, amount, category FROM c WHERE n >= 5""")
def src_cards_by_city(spark, sf):
    cards = datasets.read_csv(spark, X.write_cards(spark, sf))
    return datasets.cards_by_city(cards).select(
        "source_file", "txn_date", "description", "amount", "category")


_MERCHANT = one_of(X.MERCHANTS, "o_custkey % 16")


@query(_ORDERS + f""", r AS (
  SELECT o_orderpriority || '/' || strftime(txn_date, '%Y-%m') AS source_file, txn_date,
         concat_ws(' ', {_MERCHANT}, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END,
                   CASE WHEN o_orderkey % 3 = 0 THEN 'paid' END) AS description,
         o_orderkey % 4 = 0 AS income, total_cents FROM o
), c AS (SELECT *, CASE WHEN income THEN 'income' ELSE {category_of('description')} END AS category,
  count(*) FILTER (NOT income AND total_cents > 0) OVER (PARTITION BY source_file) AS n FROM r)
SELECT source_file, txn_date, description, category,
       cast(CASE WHEN income THEN 1 ELSE -1 END * total_cents * 0.01 AS decimal(18,2)) AS amount
FROM c WHERE n >= 5""")
def src_household_daily(spark, sf):
    ledger = datasets.read_csv(spark, X.write_household(spark, sf))
    return datasets.household_daily(ledger).select(
        "source_file", "txn_date", "description", "category", "amount")


@query(_ORDERS + f""", r AS (
  SELECT cast(o_custkey % 10 AS varchar) || '/' || strftime(txn_date, '%Y-%m') AS source_file, txn_date,
         CASE WHEN o_orderkey % 7 <> 0 THEN {_MERCHANT} ELSE 'transaction' END AS description,
         CASE WHEN o_orderkey % 5 IN (1, 3) THEN 1 ELSE -1 END * total_cents AS cents FROM o
), c AS (SELECT *, {category_of('description')} AS category,
  count(*) FILTER (cents < 0) OVER (PARTITION BY source_file) AS n FROM r)
SELECT source_file, txn_date, description, category, cast(cents * 0.01 AS decimal(18,2)) AS amount
FROM c WHERE n >= 5""")
def src_generic_bank(spark, sf):
    bank = datasets.read_csv(spark, X.write_bank(spark, sf))
    return datasets.generic_bank(bank).select(
        "source_file", "txn_date", "description", "category", "amount")


_PERSONAL = _ORDERS + f""", r AS (
  SELECT strftime(txn_date, '%Y-%m') AS source_file, txn_date,
         concat_ws(' ', {_MERCHANT}, CASE WHEN o_orderkey % 3 = 0 THEN 'paid' END) AS description,
         o_orderkey % 4 = 0 AS income, total_cents FROM o
), c AS (SELECT *, CASE WHEN income THEN 'income' ELSE {category_of('description')} END AS category,
  count(*) FILTER (NOT income AND total_cents > 0) OVER (PARTITION BY source_file) AS n FROM r),
p AS (SELECT source_file, txn_date, description, category,
       cast(CASE WHEN income THEN 1 ELSE -1 END * total_cents * 0.01 AS decimal(18,2)) AS amount
FROM c WHERE n >= 3)
"""


@query(_PERSONAL + "SELECT * FROM p")
def src_personal_finance(spark, sf):
    money = datasets.read_csv(spark, X.write_personal(spark, sf))
    return datasets.personal_finance(money, "2024-01-01").select(
        "source_file", "txn_date", "description", "category", "amount")


@query(FILES + """, u AS (
  SELECT file_no, place, raw_text, coalesce(raw_debit, raw_amount) AS figure, layout FROM lines)
SELECT file_no, place AS row_idx, CASE WHEN layout = 0 THEN raw_text END AS description,
       CASE WHEN layout = 1 THEN raw_text END AS narration,
       CASE WHEN layout = 2 THEN raw_text END AS particulars,
       CASE WHEN layout = 3 THEN raw_text END AS foo FROM u""")
def sink_bronze_append(spark, sf):
    rows = X.bronze(spark, sf)
    path = scratch(spark, "bronze")
    layouts = {"Description": ["Date", "Description", "Debit", "Credit"],
               "Narration": ["Txn Date", "Narration", "Amount (INR)"],
               "Particulars": ["Value Date", "Particulars", "Withdrawal Amt", "Deposit Amt"],
               "Foo": ["Foo", "Bar"]}
    for mark, names in layouts.items():
        some = rows.where(F.array_contains(F.transform("columns", strip), mark))
        tables.append(statements.spread(some, names), path)
    return tables.read_table(spark, path).select(
        F.col("source_file").alias("file_no"), "row_idx",
        *[F.col(name).alias(name.lower()) for name in layouts])


@query(FILES + """SELECT file_no, place AS row_idx, txn_date, description, amount, category,
is_outflow FROM silver""")
def sink_silver_overwrite(spark, sf):
    path = scratch(spark, "silver")
    rows = C.enrich(C.conform(X.bronze(spark, sf)))
    for _ in range(2):  # a rebuild leaves the same table
        tables.overwrite(rows, path)
    return tables.read_table(spark, path).select(
        F.col("source_file").alias("file_no"), "row_idx", "txn_date", "description", "amount",
        "category", "is_outflow")


def gold(spark, sf):
    """Dimensions and serving-key fact of the fixture, unwritten."""
    rows = X.silver(spark, sf)
    fact = rows.select(
        date_key(F.col("txn_date")).alias("date_key"),
        star.category_key(F.col("category")).alias("category_key"), "description", "amount",
        "is_outflow", "currency", "source_file",
        F.concat_ws(":", "source_file", F.col("cents").cast("string")).alias("txn_id"))
    return star.dim_date(rows), star.dim_category_fixed(spark), fact


def loaded_gold(spark, sf):
    """The same as written tables, read back."""
    folder = scratch(spark, "gold")
    tables.write_gold(folder, *gold(spark, sf))
    return [tables.read_table(spark, f"{folder}/{n}")
            for n in ("dim_date", "dim_category", "fact_transaction")]


@query(T + """SELECT 'dim_category' AS name, cast(14 AS bigint) AS n, 0 AS cents
UNION ALL SELECT 'dim_date', count(DISTINCT txn_date), 0 FROM t
UNION ALL SELECT 'fact_transaction', count(*), cast(sum(cents) AS bigint) FROM t""")
def sink_gold_overwrite(spark, sf):
    folder = scratch(spark, "gold")
    for _ in range(2):
        tables.write_gold(folder, *gold(spark, sf))
    parts = []
    for name in ("dim_category", "dim_date", "fact_transaction"):
        table = tables.read_table(spark, f"{folder}/{name}")
        cents = (F.sum(F.col("amount") * 100).cast("bigint") if name == "fact_transaction"
                 else F.lit(0).cast("bigint"))
        parts.append(table.agg(F.count(F.lit(1)).alias("n"), cents.alias("cents"))
                     .select(F.lit(name).alias("name"), "n", "cents"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _customer():
    return F.regexp_extract("source_file", r"(\d+)", 1).cast("bigint")


_CUST = "cast(regexp_extract(source_file, '([0-9]+)', 1) AS bigint)"


@query(T + f"""SELECT source_file, count(*) AS n, cast(sum(cents *
  CASE WHEN {_CUST} % 3 = 0 THEN 2 ELSE 1 END) AS bigint) AS cents
FROM t WHERE {_CUST} % 3 <> 0 OR is_outflow GROUP BY source_file""")
def sink_replace_by_source(spark, sf):
    path = scratch(spark, "fact")
    rows = X.silver(spark, sf).drop("raw_description", "balance")
    third = _customer() % 3 == 0
    # a first load, then a load that brings a third of the sources anew, twice over
    tables.replace_by_source(rows.where(_customer() % 5 != 0), path)
    again = rows.where(third & F.col("is_outflow")).withColumn("cents", F.col("cents") * 2)
    late = rows.where(~third & (_customer() % 5 == 0))
    for _ in range(2):
        tables.replace_by_source(again.unionByName(late), path)
    return (tables.read_table(spark, path).groupBy("source_file")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")))


_DIM_DATE = """SELECT DISTINCT cast(strftime(txn_date, '%Y%m%d') AS int) AS date_key,
txn_date AS full_date, cast(year(txn_date) AS int) AS year, cast(month(txn_date) AS int) AS month,
cast(day(txn_date) AS int) AS day, monthname(txn_date) AS month_name,
dayname(txn_date) AS weekday FROM t"""


@query(T + _DIM_DATE)
def sink_merge_dim_date(spark, sf):
    path = scratch(spark, "dim_date")
    dates = star.dim_date(X.silver(spark, sf))
    tables.merge_dim_date(dates.where(F.col("year") < 1996), path)
    for _ in range(2):
        tables.merge_dim_date(dates, path)
    return tables.read_table(spark, path)


@query(T + f"""SELECT {category_key('category')} AS category_key, category AS category_name,
count(*) AS n FROM t GROUP BY ALL""")
def sink_seed_dim_category(spark, sf):
    path = scratch(spark, "dim_category")
    for _ in range(2):
        tables.seed_dim_category(spark, path)
    used = X.silver(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    dim = tables.read_table(spark, path)
    return (used.join(dim, F.col("category") == F.col("category_name"))
            .select("category_key", "category_name", "n"))


@query(T + """SELECT txn_date, description, amount, category, currency,
source_file || ':' || cast(cents AS varchar) AS txn_id FROM t""")
def src_star_readback(spark, sf):
    dates, categories, fact = loaded_gold(spark, sf)
    return star.store_order(star.read_back(fact, dates, categories)).select(
        "txn_date", "description", "amount", "category", "currency", "txn_id")


@query(T + f"""SELECT cast(year(txn_date) AS int) AS year, {category_key('category')}
AS category_key, count(*) AS n, cast(sum(cents) AS bigint) AS cents FROM t GROUP BY ALL""")
def sink_publish_gold(spark, sf):
    folder = scratch(spark, "published")
    dates, categories, fact = gold(spark, sf)
    tables.publish({"DIM_DATE": dates, "DIM_CATEGORY": categories, "FACT_TRANSACTION": fact},
                   lambda name: ("parquet", {"path": f"{folder}/{name}"}))
    out = {n: tables.read_table(spark, f"{folder}/{n}") for n in ("DIM_DATE", "FACT_TRANSACTION")}
    return (out["FACT_TRANSACTION"].join(out["DIM_DATE"], "date_key")
            .groupBy("year", "category_key")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.col("amount") * 100).cast("bigint").alias("cents")))


@query("""SELECT cast(vec_id AS varchar) AS id, cast(CASE WHEN vec_id % 3 = 0 THEN label + 200
ELSE label END AS int) AS label, cast(len(embedding) AS int) AS size FROM embeddings
UNION ALL SELECT 'new' || cast(vec_id AS varchar), cast(label AS int), cast(len(embedding) AS int)
FROM embeddings WHERE vec_id % 5 = 0""")
def sink_vector_upsert(spark, sf):
    path = scratch(spark, "vectors")
    vectors = X.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"),
        F.col("label").cast("int").alias("label"), "vec_id")
    store = vectors.drop("vec_id").withColumn("seq", F.lit(0))
    tables.upsert_vectors(store, path, "seq")
    third = vectors.where(F.col("vec_id") % 3 == 0).drop("vec_id")
    first = third.withColumns({"label": F.col("label") + 100, "seq": F.lit(1)})
    last = third.withColumns({"label": F.col("label") + 200, "seq": F.lit(2)})
    new = vectors.where(F.col("vec_id") % 5 == 0).drop("vec_id").withColumns(
        {"id": F.concat(F.lit("new"), "id"), "seq": F.lit(3)})
    tables.upsert_vectors(first.unionByName(last).unionByName(new), path, "seq")
    return tables.read_table(spark, path).select("id", "label", F.size("values").alias("size"))


def union_parts(spark, sf):
    cards = datasets.read_csv(spark, X.write_cards(spark, sf))
    money = datasets.read_csv(spark, X.write_personal(spark, sf))
    return (X.silver(spark, sf), datasets.cards_by_city(cards),
            datasets.personal_finance(money, "2024-01-01"))

