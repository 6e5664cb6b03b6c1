import hashlib
import math
import re
from datetime import datetime
from decimal import Decimal, InvalidOperation

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywright.functions import text as X
from tallywright.functions import values as V
from tallywright.functions import vectors as H
from tallywright.schema import CATEGORY_RULES, PII_RULES


def column(spark, values, made, kind="string"):
    """What ``made`` gives for each value, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(made(F.col("x"))).collect()]


def plain_redact(text):
    for label, pattern in PII_RULES:
        text = re.sub(pattern, f"<{label}>", text)
    return text


def test_amounts(spark):
    cases = ["1,234.50", "₹ 1234.5", " -450 ", "-", "", "nan", "None", "abc", "+7", "1e3", None,
             "12 Cr", "₹-1,00,000.25"]

    def expect(t):
        if t is None:
            return None
        t = t.strip().replace(",", "").replace("₹", "")
        if t in ("", "-", "nan", "None"):
            return None
        try:
            return Decimal(t)
        except InvalidOperation:
            return None

    assert column(spark, cases, V.parse_amount) == [expect(c) for c in cases]


def test_dates_like_strptime(spark):
    formats = ("%Y-%m-%d", "%d-%m-%Y", "%d/%m/%Y", "%m/%d/%Y", "%d-%b-%Y", "%d %b %Y")
    cases = ["2024-03-01", "2024-3-1", "01-03-2024", "1/3/2024", "12/31/2023", "31/12/2023",
             "05-Mar-2024", "5-mar-2024", "05 Mar 2024", " 2024-03-01 ", "2024-02-30", "soon", "",
             "13/13/2024", "2024/03/01", "1-13-2024", "29-02-2023", "7  Apr  2021", "24-03-01"]

    def expect(t):
        for f in formats:
            try:
                return datetime.strptime(t.strip(), f).date()
            except ValueError:
                continue
        return None

    assert column(spark, cases, V.parse_date) == [expect(c) for c in cases]


def test_redaction_cases(spark):
    cases = ["pay to someone@okbank now", "call +91 9876543210", "call 9876543210",
             "PAN ABCDE1234F ok", "ifsc HDFC0001234 branch", "aadhaar 1234 5678 9012",
             "card 4111 1111 1111 1111 charged", "acct 123456789 x", "nothing here", "",
             "naïve café 9876543210é", "٣٤٥٦٧٨٩٠١٢٣٤ digits"]
    assert column(spark, cases, X.redact) == [plain_redact(c) for c in cases]


def test_redaction_of_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "text", X.redact(F.col("text")).alias("r")).collect()
    assert rows and all(r["r"] == plain_redact(r["text"]) for r in rows)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="ab1234567890 -@.XYZ+\t₹é", max_size=40), min_size=200,
                max_size=200))
def test_redaction_of_any_text(spark, texts):
    assert column(spark, texts, X.redact) == [plain_redact(t) for t in texts]


def test_categories(spark):
    cases = {"Swiggy order": "dining", "BigBasket groceries": "groceries", "Uber trip": "transport",
             "Netflix subscription": "subscriptions", "Salary ACME": "income", "xyz": "other",
             "coca cola": "transport", "small box": "shopping", "coffee": "fees",
             "current account": "rent"}
    assert column(spark, list(cases), X.categorize) == list(cases.values())

    def expect(t):
        return next((n for n, ws in CATEGORY_RULES if any(w in t.lower() for w in ws)), "other")

    words = [w.upper() + " z" for _, ws in CATEGORY_RULES for w in ws]
    assert column(spark, words, X.categorize) == [expect(w) for w in words]


def test_strip_takes_every_white_space(spark):
    cases = ["\t a b \n", " x ", "", "\x1cy\x0b"]
    assert column(spark, cases, V.strip) == [c.strip() for c in cases]


def test_hash_vector_is_md5_mod_dim(spark):
    texts = ["Swiggy food order food", "", "A-b_c 12 12 12", "naïve CAFÉ"]
    for dim in (64, 1536, 100_003):
        for text, got in zip(texts, column(spark, texts, lambda c: H.hash_vector(c, dim))):
            want = {}
            for token in re.findall(r"[a-z0-9]+", text.lower()):
                b = int(hashlib.md5(token.encode()).hexdigest(), 16) % dim
                want[b] = want.get(b, 0) + 1
            assert dict(zip(got["indices"], got["counts"])) == want
            assert got["indices"] == sorted(got["indices"])


def test_dense_vector_has_unit_length(spark):
    df = spark.createDataFrame([("hello world hello",), ("",)], "x string")
    v = df.withColumn("v", H.hash_vector(F.col("x"), 64)).select(
        H.dense(F.col("v.indices"), H.weights(F.col("v")), 64).alias("d")).collect()
    assert len(v[0]["d"]) == 64 and math.isclose(sum(x * x for x in v[0]["d"]), 1.0)
    assert set(v[1]["d"]) == {0.0}


def test_cosine(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]),
         ([3.0, 4.0, 9.0], [3.0, 4.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(H.cosine(F.col("a"), F.col("b"))).collect()]
    want = [1.0, 0.0, 0.0, 25 / (math.sqrt(9 + 16 + 81) * 5)]
    assert all(math.isclose(g, w) for g, w in zip(got, want))


def test_numbers_as_text(spark):
    money = [Decimal("-450.00"), Decimal("1.10"), Decimal("2.25"), Decimal("0.00")]
    assert column(spark, money, X.plain_number, "decimal(18,2)") == [str(float(m)) for m in money]
    halves = [0.5, 1.5, 2.5, 1234.5, 1235.5]
    assert column(spark, halves, X.grouped, "double") == [f"{h:,.0f}" for h in halves]
