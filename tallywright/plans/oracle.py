"""Plain SQL over the benchmark tables that states what the operators must give."""

from ..schema import CATEGORIES, CATEGORY_RULES, PII_RULES
from .fixtures import FILE_ROWS, HEADERS, MERCHANTS


def redacted(text: str) -> str:
    for label, pattern in PII_RULES:
        text = f"regexp_replace({text}, '{pattern}', '<{label}>', 'g')"
    return text


def category_of(text: str) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({text}), '{word}')" for word in words)
        + f" THEN '{name}'" for name, words in CATEGORY_RULES)
    return f"CASE {cases} ELSE 'other' END"


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def one_of(values, index: str) -> str:
    return f"([{listed(values)}])[cast({index} AS int) + 1]"


def grouped_cents(cents: str) -> str:
    """1234567 -> 12,345.67"""
    return (f"(format('{{:,}}', {cents} // 100) || '.' || "
            f"lpad(cast({cents} % 100 AS varchar), 2, '0'))")


def half_even(cents: str) -> str:
    """Whole units of a number of cents, halves to the even unit, with separators."""
    return (f"format('{{:,}}', cast({cents} // 100 + CASE WHEN {cents} % 100 > 50 OR "
            f"({cents} % 100 = 50 AND ({cents} // 100) % 2 = 1) THEN 1 ELSE 0 END AS bigint))")


def plain(cents: str) -> str:
    """Signed cents as a float prints: -45050 -> -450.5"""
    size = f"abs({cents})"
    return (f"(CASE WHEN {cents} < 0 THEN '-' ELSE '' END || cast({size} // 100 AS varchar) || '.' "
            f"|| CASE WHEN {size} % 10 = 0 THEN cast(({size} % 100) // 10 AS varchar) "
            f"ELSE lpad(cast({size} % 100 AS varchar), 2, '0') END)")


_CATEGORY_KEYS = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATEGORIES))


def category_key(column: str) -> str:
    return f"CASE {column} {_CATEGORY_KEYS} ELSE 13 END"


# Transactions (t): one statement per customer, conformed, redacted, categorized.
T = f"""
WITH base AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, o_custkey,
         concat('cust_', cast(o_custkey AS varchar), '.csv') AS source_file,
         cast(l_shipdate AS date) AS txn_date,
         concat({one_of(MERCHANTS, 'l_partkey % 16')},
           CASE l_orderkey % 13
             WHEN 0 THEN concat(' UPI user', cast(o_custkey AS varchar), '@okbank')
             WHEN 1 THEN concat(' ph ', cast(9000000000 + l_orderkey AS varchar))
             WHEN 2 THEN concat(' card 4111 1111 1111 ', cast(1000 + l_partkey % 9000 AS varchar))
             ELSE '' END) AS raw_description,
         CASE WHEN l_partkey % 16 = 0 THEN 1 ELSE -1 END
           * cast(floor(cast(round(l_extendedprice * 100) AS bigint) / (1 + l_suppkey % 25))
                  AS bigint) AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), dup AS (
  SELECT base.*, 0 AS copy_no FROM base
  UNION ALL SELECT base.*, 1 AS copy_no FROM base WHERE l_orderkey % 97 = 0
), fx AS (
  SELECT *, cast(row_number() OVER (PARTITION BY source_file ORDER BY txn_date, l_orderkey,
              l_linenumber, l_partkey, l_suppkey, l_extendedprice, copy_no) - 1 AS int) AS row_idx,
         cast(cents * 0.01 AS decimal(18,2)) AS amount
  FROM dup
), red AS (SELECT *, {redacted('raw_description')} AS description FROM fx
), t AS MATERIALIZED (
  SELECT source_file, row_idx, txn_date, raw_description, description, cents, amount,
         amount < 0 AS is_outflow, 'INR' AS currency, {category_of('description')} AS category
  FROM red
)
"""

# Rows of the statement files (f) and what each line must become.
FILES = T + f""", placed AS (
  SELECT *, row_number() OVER (ORDER BY source_file, row_idx) - 1 AS pos FROM t
), f AS MATERIALIZED (
  SELECT *, cast(pos // {FILE_ROWS} AS varchar) AS file_no,
         cast(pos % {FILE_ROWS} AS int) AS place,
         CASE WHEN (pos // {FILE_ROWS}) % 8 = 7 THEN 3 ELSE (pos // {FILE_ROWS}) % 4 % 3 END
           AS layout,
         pos % {FILE_ROWS} % 50 = 7 AS blank, pos % {FILE_ROWS} % 50 = 13 AS bad,
         {grouped_cents('abs(cents)')} AS money
  FROM placed
), lines AS MATERIALIZED (
  SELECT *,
    CASE layout WHEN 0 THEN '{HEADERS[0].replace(",", "|")}'
                WHEN 1 THEN 'Amount (INR)| Txn Date |Narration'
                WHEN 2 THEN '{HEADERS[2].replace(",", "|")}'
                ELSE 'Foo|Bar' END AS header,
    CASE WHEN blank THEN NULL WHEN bad THEN '2024-02-30'
         WHEN layout = 0 THEN strftime(txn_date, '%Y-%m-%d')
         WHEN layout = 1 THEN strftime(txn_date, '%d-%m-%Y')
         WHEN layout = 2 THEN strftime(txn_date, '%-d %b %Y') END AS raw_date,
    CASE layout WHEN 2 THEN raw_description || ', "ref"' ELSE raw_description END AS raw_text,
    CASE WHEN layout = 1 THEN CASE WHEN cents < 0 THEN '-' ELSE '' END || money END AS raw_amount,
    CASE WHEN layout = 0 AND cents < 0 THEN money
         WHEN layout = 2 THEN CASE WHEN cents < 0 THEN '₹' || money ELSE '-' END END AS raw_debit,
    CASE WHEN layout IN (0, 2) AND cents >= 0 THEN money END AS raw_credit
  FROM f
), good AS MATERIALIZED (
  SELECT file_no, place, txn_date, amount, cents, raw_text,
         {redacted('raw_text')} AS description
  FROM lines WHERE layout < 3 AND NOT blank AND NOT bad
), silver AS MATERIALIZED (
  SELECT *, amount < 0 AS is_outflow, {category_of('description')} AS category FROM good
)
"""

STATS = T + """, o AS (SELECT *, -cents AS mag FROM t WHERE cents < 0),
stats AS MATERIALIZED (
  SELECT source_file, median(mag) AS median, count(*) AS n,
         cast(sum(mag) AS double) / count(*) AS mean,
         sqrt(cast(count(*) * sum(cast(mag AS hugeint) * mag)
                   - sum(cast(mag AS hugeint)) * sum(cast(mag AS hugeint)) AS double))
           / count(*) AS std
  FROM o GROUP BY source_file)
"""

def _large(scope: str, rows: str) -> str:
    return f"""
  SELECT {scope} 'large_transaction' AS type,
         CASE WHEN mag > 8 * median THEN 'high' ELSE 'medium' END AS severity,
         'Unusually large charge of ' || {half_even('mag')} || ' (~'
           || cast(cast(round_even(mag / median, 0) AS bigint) AS varchar)
           || 'x your typical spend)' AS message,
         source_file AS src, txn_date, description, amount, category, 1 AS copies
  FROM {rows}
  WHERE n >= 3 AND median > 0 AND mag > 4 * median AND mag > 100000
"""

def _duplicate(scope: str) -> str:
    return f"""
  SELECT {scope} 'possible_duplicate' AS type,
         CASE WHEN mag > 100000 THEN 'high' ELSE 'medium' END AS severity,
         cast(n AS varchar) || ' identical charges of ' || {half_even('mag')} || ' for '''
           || description || '''' AS message, min_src AS src, description, amount, n
  FROM (SELECT {scope} description, amount, max(mag) AS mag, count(*) AS n,
               min(source_file) AS min_src
        FROM o GROUP BY {scope} description, amount HAVING count(*) >= 2)
"""

ANOMALIES = STATS + f""", large AS MATERIALIZED (
  {_large('source_file,', '(SELECT o.*, s.median, s.n FROM o JOIN stats s USING (source_file))')}
), dupes AS MATERIALIZED (
  {_duplicate('source_file,')}
), rule_members AS MATERIALIZED (
  SELECT DISTINCT source_file, txn_date, description, amount FROM large
  UNION SELECT o.source_file, o.txn_date, o.description, o.amount
  FROM o JOIN dupes d ON o.source_file = d.source_file AND o.description = d.description
                      AND o.amount = d.amount
)
"""

ALL_ANOMALIES = STATS + f""", whole AS (SELECT median(mag) AS median, count(*) AS n FROM o),
large AS MATERIALIZED (
  {_large('', '(SELECT o.*, w.median, w.n FROM o, whole w)')}
), dupes AS MATERIALIZED (
  {_duplicate('')}
)
"""

EVENTS_SLOTS = """
WITH slots AS (
  SELECT date_trunc('minute', ts) AS slot, event_type, count(*) AS c FROM events GROUP BY ALL)
"""
