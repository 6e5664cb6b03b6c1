"""Transactions, statement files and data-set files derived from the benchmark tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import grouped
from ..operators.conform import enrich
from ..operators.skew import positions
from ..session import scratch
from ..sources.statements import read_files, to_bronze
from ..sources.tables import spread

MERCHANTS = (
    "Salary credit", "House rent NEFT", "BigBasket order", "Swiggy dinner", "Uber ride",
    "Airtel broadband", "Netflix monthly", "Flipkart order", "PVR tickets", "Apollo medicines",
    "MakeMyTrip booking", "Late penalty", "ATM cash", "Coca cola crate", "Small parcel",
    "Unknown payee",
)
ORDER = ["txn_date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
         "copy_no"]
FILE_ROWS = 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What transactions are made of: narrow rows, which are sorted or numbered before they get
    texts."""
    lines = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    copies = F.when(F.col("l_orderkey") % 97 == 0, F.array(F.lit(0), F.lit(1)))
    return rows.select(
        "o_custkey", F.col("l_shipdate").cast("date").alias("txn_date"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.explode(F.coalesce(copies, F.array(F.lit(0)))).alias("copy_no"))


def _source_file() -> Column:
    return F.concat(F.lit("cust_"), F.col("o_custkey").cast("string"), F.lit(".csv"))


def _texts(rows: DataFrame, *keep: str) -> DataFrame:
    """The transactions of these figures."""
    merchant = F.element_at(F.array(*[F.lit(m) for m in MERCHANTS]),
                            (F.col("l_partkey") % 16 + 1).cast("int"))
    custkey = F.col("o_custkey").cast("string")
    kind = F.col("l_orderkey") % 13
    tail = (F.when(kind == 0, F.concat(F.lit(" UPI user"), custkey, F.lit("@okbank")))
            .when(kind == 1, F.concat(F.lit(" ph "),
                                      (F.col("l_orderkey") + 9000000000).cast("string")))
            .when(kind == 2, F.concat(F.lit(" card 4111 1111 1111 "),
                                      (F.col("l_partkey") % 9000 + 1000).cast("string")))
            .otherwise(F.lit("")))
    size = F.floor(F.round(F.col("l_extendedprice") * 100).cast("bigint")
                   / (F.col("l_suppkey") % 25 + 1)).cast("bigint")
    cents = F.when(F.col("l_partkey") % 16 == 0, size).otherwise(-size)
    return rows.select(
        _source_file().alias("source_file"), "txn_date",
        F.concat(merchant, tail).alias("raw_description"), cents.alias("cents"),
        (cents * F.expr("0.01BD")).cast("decimal(18,2)").alias("amount"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "copy_no", *keep)


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement per customer; every row of some orders twice (repeated charges)."""
    return _texts(_figures(spark, sf_dir))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With row_idx, the 0-based place of a row in its statement (a customer's)."""
    rows = positions(_figures(spark, sf_dir), ["o_custkey"], ORDER, "row_idx")
    return _texts(rows, "row_idx").withColumn("row_idx", F.col("row_idx").cast("int"))


def _silver(rows: DataFrame) -> DataFrame:
    return enrich(rows.withColumn("currency", F.lit("INR"))
                  .withColumn("balance", F.lit(None).cast("decimal(18,2)"))
                  .withColumn("description", F.col("raw_description")))


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conformed transactions without row_idx (which costs a pass over all rows)."""
    return _silver(raw_transactions(spark, sf_dir)).drop(*ORDER[1:])


def silver_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silver(numbered(spark, sf_dir)).drop(*ORDER[1:])


HEADERS = (
    "Date,Description,Debit,Credit,Balance",
    '"Amount (INR)", Txn Date ,Narration',
    "Value Date,Particulars,Withdrawal Amt,Deposit Amt,Closing Balance",
    "Foo,Bar",
)


def _money(cents: Column) -> Column:
    return F.concat(grouped(F.floor(cents / 100)), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"))


def write_statement_files(spark: SparkSession, sf_dir: str) -> str:
    """Statement files of four layouts (one of them unusable), FILE_ROWS rows each."""
    rows = positions(_figures(spark, sf_dir).withColumn("source_file", _source_file()), [],
                     ["source_file", *ORDER], "pos")
    rows = _texts(rows, "pos")
    file_no, place = F.floor(F.col("pos") / FILE_ROWS), F.col("pos") % FILE_ROWS
    rows = rows.withColumns({"file_no": file_no, "place": place})
    layout = (F.when(F.col("file_no") % 8 == 7, 3).otherwise(F.col("file_no") % 4 % 3))
    size = F.abs("cents")
    out = F.when(F.col("cents") < 0, _money(size)).otherwise("")
    into = F.when(F.col("cents") >= 0, _money(size)).otherwise("")
    sign = F.when(F.col("cents") < 0, "-").otherwise("")

    def day(fmt: str) -> Column:
        return (F.when(F.col("place") % 50 == 7, "").when(F.col("place") % 50 == 13, "2024-02-30")
                .otherwise(F.date_format("txn_date", fmt)))

    text = F.col("raw_description")
    quote, comma = F.lit('"'), F.lit(",")
    lines = (
        F.concat(day("yyyy-MM-dd"), comma, text, F.lit(',"'), out, F.lit('","'), into,
                 F.lit('",')),
        F.concat(quote, sign, _money(size), F.lit('",'), day("dd-MM-yyyy"), comma, text),
        F.concat(day("d MMM yyyy"), F.lit(',"'), text, F.lit(', ""ref""","'),
                 F.when(out != "", F.concat(F.lit("₹"), out)).otherwise("-"), F.lit('","'), into,
                 F.lit('",n/a')),
        F.concat(text, comma, F.lit("1")),
    )

    def by_layout(values) -> Column:
        return F.when(layout == 0, values[0]).when(layout == 1, values[1]).when(
            layout == 2, values[2]).otherwise(values[3])

    heads = rows.where(F.col("place") == 0).select(
        "file_no", F.lit(-1).cast("bigint").alias("place"),
        by_layout([F.lit(h) for h in HEADERS]).alias("line"))
    body = rows.select("file_no", "place", by_layout(lines).alias("line"))
    folder = scratch(spark, "statements")
    # a file is one task's work and never more than FILE_ROWS rows
    (heads.unionByName(body).repartition("file_no").sortWithinPartitions("file_no", "place")
     .select("file_no", "line").write.partitionBy("file_no")
     .option("sep", "\u0001").option("quote", "\u0000").option("escapeQuotes", False)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(folder))
    return folder


def number_of(path: str) -> Column:
    return F.regexp_extract(path, r"file_no=(\d+)", 1)


def name_by_folder(files: DataFrame) -> DataFrame:
    """Part files have random names; their folder names the statement."""
    return files.withColumn("source_file", number_of("file_path"))


def statement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_by_folder(read_files(spark, write_statement_files(spark, sf_dir)))


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_bronze(statement_files(spark, sf_dir))


def _write_csv(rows: DataFrame, name: str) -> str:
    folder = scratch(rows.sparkSession, name)
    rows.write.option("header", True).csv(folder)
    return folder


def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey",
                                                        "c_mktsegment")
    orders = spread(table(spark, sf_dir, "orders")).withColumn("day", F.col("o_orderdate").cast("date"))
    return (orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")))


def write_cards(spark: SparkSession, sf_dir: str) -> str:
    kinds = F.array(*[F.lit(k) for k in ("Bills", "Food", "Grocery", "Fuel", "Gifts")])
    return _write_csv(orders_by_nation(spark, sf_dir).select(
        F.col("n_name").alias("City"), F.date_format("day", "d-MMM-yy").alias("Date"),
        F.col("c_mktsegment").alias("Card Type"),
        F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("Exp Type"),
        F.col("o_totalprice").cast("bigint").alias("Amount")), "cards")


def write_household(spark: SparkSession, sf_dir: str) -> str:
    return _write_csv(spread(table(spark, sf_dir, "orders")).select(
        F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss").alias("Date"),
        F.col("o_orderpriority").alias("Mode"),
        F.element_at(F.array(*[F.lit(m) for m in MERCHANTS]),
                     (F.col("o_custkey") % 16 + 1).cast("int")).alias("Category"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("Subcategory"),
        F.when(F.col("o_orderkey") % 3 == 0, "paid").alias("Note"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        F.when(F.col("o_orderkey") % 4 == 0, " Income ").otherwise("Expense")
        .alias("Income/Expense")).withColumn(
            "Amount", (F.col("cents") * F.expr("0.01BD")).cast("decimal(18,2)")).drop("cents"),
        "household")


def write_bank(spark: SparkSession, sf_dir: str) -> str:
    kinds = F.array(*[F.lit(k) for k in ("DEBIT", "credit", "Purchase", "refund", "unknown")])
    return _write_csv(spread(table(spark, sf_dir, "orders")).select(
        F.col("o_orderkey").alias("Transaction Ref"), (F.col("o_custkey") % 10).alias("Account ID"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Transaction Date"),
        (F.round(F.col("o_totalprice") * 100).cast("bigint") * F.expr("0.01BD"))
        .cast("decimal(18,2)").alias("Transaction Amount"),
        F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("Transaction Type"),
        F.when(F.col("o_orderkey") % 7 != 0, F.element_at(
            F.array(*[F.lit(m) for m in MERCHANTS]), (F.col("o_custkey") % 16 + 1).cast("int")))
        .alias("Merchant Name")), "bank")


def write_personal(spark: SparkSession, sf_dir: str) -> str:
    return _write_csv(spread(table(spark, sf_dir, "orders")).select(
        F.date_format("o_orderdate", "dd-MM-yyyy").alias("Date"),
        F.element_at(F.array(*[F.lit(m) for m in MERCHANTS]),
                     (F.col("o_custkey") % 16 + 1).cast("int")).alias("Category"),
        (F.round(F.col("o_totalprice") * 100).cast("bigint") * F.expr("0.01BD"))
        .cast("decimal(18,2)").alias("Amount"),
        F.when(F.col("o_orderkey") % 4 == 0, "Income").otherwise("Expense")
        .alias("Income/Expense"),
        F.when(F.col("o_orderkey") % 3 == 0, "paid").alias("Note")), "personal")
