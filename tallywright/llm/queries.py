"""The registered query of each operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.store import small_batches

QUERIES = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in ("documents", "pages"):
        small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    """The public vocabulary file, where it is installed; never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def fold(modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a document is held out; one without an id is not (and nothing is learned from it)."""
    return F.coalesce(fold(modulus) == remainder, F.lit(False)).alias("held_out")


@_query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywright.llm import language

    docs = _read(spark, sf_dir, "documents")
    crf = language.fit(docs.where(fold(3) != 1))
    return language.predict(docs, crf).select("doc_id", held_out(3, 1), "lang_pred", "score")


@_query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywright.llm import line_dedup

    return line_dedup.dedup(_read(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


@_query
def op10_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywright.llm import parity_join

    return parity_join.classes(_read(spark, sf_dir, "documents"))


@_query
def op3_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywright.llm import positional_index

    found = positional_index.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(listed.cast("binary"), 256).alias("items_sha256"), "contaminated")


@_query
def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywright.llm import packing

    packed = packing.pack(_read(spark, sf_dir, "documents"), tokenizer(), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_query
def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywright.llm import compression

    docs = _read(spark, sf_dir, "documents")
    labels = _read(spark, sf_dir, "labels").where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").alias("label"))
    scored = compression.score(docs, compression.fit(docs.where(fold(5) != 0), labels))
    return scored.select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywright.llm import severity

    docs = _read(spark, sf_dir, "documents")
    labels = _read(spark, sf_dir, "labels").where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").alias("grade"))
    graded = severity.predict(docs, severity.fit(docs.where(fold(5) != 0), labels))
    return graded.select("doc_id", held_out(5, 0), "grade", "expected_severity", F.col("p_above").alias("p_toxic"), (F.col("p_above") >= 0.5).alias("toxic"))


@_query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywright.llm import html_text

    return html_text.extract_pages(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@_query
def op5_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywright.llm import threshold_search

    return threshold_search.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@_query
def op9_gru_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywright.llm import lm_scoring

    docs = _read(spark, sf_dir, "documents")
    train = docs.where(fold(7) != 2)
    counts = lm_scoring.count_tokens(train)
    scored = lm_scoring.score(docs, lm_scoring.fit(train, counts), counts)
    return scored.select("doc_id", held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywright.llm import hard_negatives

    vectors = _read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


@_query
def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywright.llm import structure_repair

    return structure_repair.repair(structure_repair.damaged(_read(spark, sf_dir, "conversations")))


@_query
def op13_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywright.llm import window_packing

    return window_packing.pack(_read(spark, sf_dir, "documents"), tokenizer())


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


ORACLE["op5_threshold_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLE["op11_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

ORACLE["op12_structure_repair"] = r"""
WITH RECURSIVE z AS (
  SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') AS conv, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ord(k[i])::BIGINT),
        lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)),
        4294967295::BIGINT), 4294967295) % 20 AS fault FROM z),
m AS (SELECT conv, conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
        CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS pos FROM m),
f AS (SELECT *, role[1] AS initial, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS solid,
        row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS again FROM o),
g AS (SELECT *, solid = '' AS blank, solid <> '' AND again AS duplicate,
        solid <> '' AND NOT again AND NOT contains('.!?', solid[-1]) AS truncated,
        lag(initial) OVER (PARTITION BY conv ORDER BY pos) || initial AS pair FROM f),
d AS (
  SELECT conv, 0::BIGINT AS pos, {'c': 0::BIGINT, 't': ''} AS e, {'c': 1000000000::BIGINT, 't': ''} AS y,
         {'c': 3::BIGINT, 't': 'I'} AS u, {'c': 6::BIGINT, 't': 'II'} AS a FROM (SELECT DISTINCT conv FROM g)
  UNION ALL
  SELECT conv, pos, e, y, u, list_min([a, {'c': u.c + 3, 't': u.t || 'I'}]) FROM (
    SELECT conv, pos, e, y, a, list_min([u, {'c': e.c + 3, 't': e.t || 'I'}, {'c': y.c + 3, 't': y.t || 'I'}, {'c': a.c + 3, 't': a.t || 'I'}]) AS u FROM (
      SELECT d.conv, g.pos, {'c': e.c + 4, 't': e.t || 'D'} AS e,
        list_min([{'c': y.c + 4, 't': y.t || 'D'}, {'c': CASE WHEN ok AND initial = 's' THEN e.c + extra ELSE 1000000000 END, 't': e.t || 'K'}]) AS y,
        list_min([{'c': u.c + 4, 't': u.t || 'D'}]
          || list_transform([e, y, a], lambda s: {'c': CASE WHEN ok AND initial = 'u' THEN s.c + extra ELSE 1000000000 END, 't': s.t || 'K'})
          || list_transform([e, y, a], lambda s: {'c': CASE WHEN ok THEN s.c + extra + 3 ELSE 1000000000 END, 't': s.t || 'R'})) AS u,
        list_min([{'c': a.c + 4, 't': a.t || 'D'}, {'c': CASE WHEN ok AND initial = 'a' THEN u.c + extra ELSE 1000000000 END, 't': u.t || 'K'},
          {'c': CASE WHEN ok THEN u.c + extra + 3 ELSE 1000000000 END, 't': u.t || 'R'}]) AS a
      FROM d JOIN (SELECT *, NOT blank AND NOT duplicate AS ok, CASE WHEN truncated THEN 3 ELSE 0 END AS extra FROM g) g
        ON g.conv = d.conv AND g.pos = d.pos + 1))),
b AS (SELECT conv, list_min([e, a]) AS best FROM d QUALIFY row_number() OVER (PARTITION BY conv ORDER BY pos DESC) = 1),
x AS (SELECT conv, i, best.t[i] AS op FROM b, unnest(range(1, length(best.t) + 1)) AS r(i)),
p AS (SELECT *, sum((op <> 'I')::INT) OVER w AS pos, sum((op <> 'D')::INT) OVER w AS nth FROM x
      WINDOW w AS (PARTITION BY conv ORDER BY i ROWS UNBOUNDED PRECEDING)),
q AS (SELECT p.conv, i, op, nth, g.role, g.text, max((op = 'K' AND nth = 1 AND initial = 's')::INT) OVER (PARTITION BY p.conv) AS lead
      FROM p LEFT JOIN g ON g.conv = p.conv AND g.pos = p.pos),
v AS (SELECT conv, string_agg(CASE WHEN op = 'K' THEN role WHEN (nth - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
        || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS whole FROM q WHERE op <> 'D' GROUP BY conv),
n AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
        count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.t, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv FROM conversations) c
LEFT JOIN n USING (conv) LEFT JOIN b USING (conv) LEFT JOIN v USING (conv)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op3_positional_index"] = f"""
WITH b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
g AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
      FROM b, unnest(range(1, greatest(len(w) - 11, 2))) AS t(i) WHERE len(w) > 0),
s AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM d, (SELECT DISTINCT n FROM g) AS sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
m AS (SELECT doc_id, i, s.n, item_id FROM s JOIN g ON s.g = g.g AND s.n = g.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""

ORACLE["op10_parity_join"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
      FROM d, unnest(range(1, greatest(len(w) - 1, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) AS c ON c.a = d.doc_id
"""
