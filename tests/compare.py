"""Run a query and its SQL side by side, as the benchmark driver does."""

import datetime
import decimal

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(value):
    if isinstance(value, decimal.Decimal):
        return format(value.normalize(), "f") if value else "0"
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def differences(spark, con, fn, sql, sf_dir):
    """None when equal, otherwise a short account."""
    df = fn(spark, sf_dir)
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if have[0] != want[0]:
        return f"columns {have[0]} != {want[0]}"
    if have[1] == want[1]:
        return None if have[1] else "no rows"
    from collections import Counter

    a, b = Counter(have[1]), Counter(want[1])
    extra, lost = list((a - b).items())[:3], list((b - a).items())[:3]
    return f"{len(have[1])} rows, wanted {len(want[1])}; only here {extra}; only there {lost}"
