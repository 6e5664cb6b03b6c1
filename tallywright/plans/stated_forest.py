"""A small forest written by hand, as a model over the benchmark tables and as SQL.

A trained forest depends on hashes that SQL engines don't share, so what the model layer makes of a
forest (scores, predictions, metrics, anomalies) is stated for this one; what training makes is
stated as facts of the trained one.
"""

from ..operators import iforest as I
from ..schema import FEATURES
from .oracle import ANOMALIES, category_key

OFFSET = -600_000_000_000  # in units of 1e-12
SAMPLE = 256

#: A node is (feature, threshold, at most, above), a leaf its depth. Thresholds of fractions lie
#: where no value does.
TREES = (
    ("amount_to_median_ratio", 1.9876543, ("category_code", 6.0, 9.5, 8.25),
     ("amount_to_median_ratio", 2.4567891, 5.0, 2.5)),
    ("log_amount", 9.1234567, ("day_of_month", 15.0, 10.0, 9.0), ("is_weekend", 0.5, 4.0, 2.0)),
    ("desc_length", 12.0, 8.0, ("is_round_amount", 0.5, ("desc_word_count", 1.0, 6.0, 7.5), 3.0)),
)

_SQL = {
    "amount_to_median_ratio": "(mag / median)", "log_amount": "ln(1 + mag / 100.0)",
    "category_code": category_key("category"), "day_of_month": "day(txn_date)",
    "is_weekend": "(CASE WHEN isodow(txn_date) >= 6 THEN 1 ELSE 0 END)",
    "desc_length": "length(description)",
    "is_round_amount": "(CASE WHEN mag <> 0 AND mag % 10000 = 0 THEN 1 ELSE 0 END)",
    "desc_word_count": "len(regexp_extract_all(description, '[^ ]+'))",
}


def forest(spark) -> I.Forest:
    nodes = []

    def put(tree: int, node, place: int, free: int) -> int:
        """Adds ``node`` at ``place``; returns the next free place."""
        if isinstance(node, float):
            nodes.append((tree, place, -1, 0.0, -1, -1, node, 0))
            return free
        feature, threshold, low, high = node
        nodes.append((tree, place, FEATURES.index(feature), threshold, free, free + 1, 0.0, 0))
        return put(tree, high, free + 1, put(tree, low, free, free + 2))

    for i, root in enumerate(TREES):
        put(i, root, 0, 1)
    return I.Forest(spark.createDataFrame(nodes, I._NODES), OFFSET, FEATURES, {"sample": SAMPLE})


def _depth(node) -> str:
    if isinstance(node, float):
        return str(node)
    feature, threshold, low, high = node
    return f"CASE WHEN {_SQL[feature]} <= {threshold} THEN {_depth(low)} ELSE {_depth(high)} END"


def score_sql() -> str:
    mean = "(" + " + ".join(f"({_depth(t)})" for t in TREES) + f") / {len(TREES)}.0"
    usual = repr(I.mean_path(SAMPLE))
    return f"(round(-pow(2.0, -({mean}) / {usual}) * 1e12) - ({OFFSET})) / 1e12"


#: ``scored``: every outflow with its score; ``hits``: the model's anomalies.
SCORED = ANOMALIES + f""", scored AS MATERIALIZED (
  SELECT o.*, s.n AS outflows, {score_sql()} AS score FROM o JOIN stats s USING (source_file)
), hits AS MATERIALIZED (
  SELECT *, CASE WHEN score < -0.15 THEN 'high' WHEN score < -0.05 THEN 'medium' ELSE 'low' END
         AS severity,
         'ML model flagged this as unusual for your spending pattern (anomaly score '
           || printf('%+.3f', score) || ')' AS message
  FROM scored WHERE score < 0 AND outflows >= 5
)
"""
