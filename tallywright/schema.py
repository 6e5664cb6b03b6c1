"""Types, the category list and the rule tables every other module reads."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# The order of this list is the serving key of a category and its
# code as a model feature.
CATEGORIES = (
    "income", "groceries", "dining", "transport", "utilities", "rent", "shopping",
    "entertainment", "health", "travel", "subscriptions", "transfers", "fees", "other",
)
CATEGORY_KEY = {name: key for key, name in enumerate(CATEGORIES)}

# Keyword groups, tried in this order; a keyword may sit anywhere in the text.
CATEGORY_RULES = (
    ("income", ("salary", "payroll", "interest credit", "refund", "cashback")),
    ("rent", ("rent", "landlord", "lease")),
    ("groceries", ("grocery", "supermarket", "bigbasket", "dmart", "more retail", "zepto")),
    ("dining", ("restaurant", "cafe", "swiggy", "zomato", "dominos", "mcdonald", "starbucks")),
    ("transport", ("uber", "ola", "fuel", "petrol", "metro", "irctc", "fastag", "rapido")),
    ("utilities", ("electricity", "water bill", "gas", "broadband", "mobile recharge",
                   "airtel", "jio")),
    ("subscriptions", ("netflix", "spotify", "prime", "subscription", "youtube premium",
                       "hotstar")),
    ("shopping", ("amazon", "flipkart", "myntra", "ajio", "shopping", "mall")),
    ("entertainment", ("bookmyshow", "pvr", "cinema", "gaming", "steam")),
    ("health", ("pharmacy", "apollo", "hospital", "clinic", "medical", "1mg", "pharmeasy")),
    ("travel", ("makemytrip", "goibibo", "indigo", "airlines", "hotel", "oyo", "airbnb")),
    ("fees", ("fee", "charge", "penalty", "gst", "service tax")),
    ("transfers", ("upi", "neft", "imps", "transfer", "atm", "withdrawal")),
)

# Personal-data patterns, applied in this order.
PII_RULES = (
    ("EMAIL", r"\b[\w.+-]+@[\w.-]+\b"),
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    ("IFSC", r"\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    ("CARD", r"\b(?:\d[ -]?){13,16}\b"),
    ("AADHAAR", r"\b\d{4}\s?\d{4}\s?\d{4}\b"),
    ("PHONE", r"\b(?:\+?91[-\s]?)?[6-9]\d{9}\b"),
    ("ACCOUNT", r"\b\d{9,18}\b"),
)

# Header names (stripped, lower case) of each logical column.
COLUMN_ALIASES = {
    "date": ("date", "txn date", "transaction date", "value date", "posting date"),
    "description": ("description", "narration", "details", "particulars", "remarks"),
    "amount": ("amount", "amount (inr)", "txn amount", "transaction amount"),
    "debit": ("debit", "withdrawal", "withdrawal amt", "dr"),
    "credit": ("credit", "deposit", "deposit amt", "cr"),
    "balance": ("balance", "closing balance", "available balance", "running balance"),
}

# Accepted date layouts, first match wins (so day before month).
DATE_FORMATS = ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "M/d/yyyy", "d-MMM-yyyy", "d MMM yyyy")

# Cell texts a CSV reader takes as "no value".
NULL_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Spend types of the card data set.
EXPENSE_TYPES = {
    "Bills": "utilities", "Food": "dining", "Grocery": "groceries", "Fuel": "transport",
    "Entertainment": "entertainment", "Travel": "travel",
}

# Sign of a transaction type.
FLOW_SIGNS = {
    "debit": -1, "credit": 1, "withdrawal": -1, "deposit": 1, "payment": -1,
    "transfer_out": -1, "transfer_in": 1, "purchase": -1, "refund": 1,
}

# The admission rules of an upload.
ADMITTED_SUFFIXES = (".csv", ".xlsx", ".xls", ".pdf")
MAX_UPLOAD_BYTES = 10 * 1024 * 1024

# Saved models carry these names, in this order.
FEATURES = (
    "log_amount", "amount_to_median_ratio", "amount_zscore", "is_round_amount", "day_of_week",
    "day_of_month", "is_weekend", "is_month_boundary", "desc_length", "desc_word_count",
    "desc_has_digits", "category_code",
)

BRONZE = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("row_idx", T.IntegerType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("places", T.StructType([T.StructField(n, T.IntegerType())
                                          for n in COLUMN_ALIASES])),
    T.StructField("cells", T.ArrayType(T.StringType())),
])

TRANSACTIONS = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("row_idx", T.IntegerType()),
    T.StructField("txn_date", T.DateType()),
    T.StructField("description", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("balance", MONEY),
    T.StructField("currency", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("is_outflow", T.BooleanType()),
])

DIM_CATEGORY = T.StructType([
    T.StructField("category_key", T.IntegerType()),
    T.StructField("category_name", T.StringType()),
])

# Parts of column names by which a data set's columns are found, in this order.
NAME_PROBES = {
    "bank_day": ("date", "time"), "bank_amount": ("amount", "value"),
    "bank_kind": ("type", "direction"),
    "bank_detail": ("merchant", "description", "category", "narration", "name", "detail"),
    "ledger_day": ("date",), "ledger_amount": ("amount",),
    "ledger_flow": ("income", "expense", "type"), "ledger_category": ("categor",),
}
# Whole column names.
ACCOUNT_NAMES = ("account_id", "accountid", "account", "customerid")
NOTE_NAMES = ("note", "description", "narration", "subcategory")
