"""Benchmark decontamination by a positional inverted index over the training documents.

The index is one row per segment (a run of documents of about a MB of text): for each term the
positions at which it stands, in order, as gaps. A segment's documents are searched where they
lie, so no posting is ever shuffled. A phrase starts from the positions of its rarest term (by
count over the whole index), shifted by the term's offset, and keeps what the offset-adjusted
lists of the next rarest terms also hold. A proximity match asks for every term within a distance
of the rarest one.

Words are runs of [0-9a-z] and non-ASCII characters, A-Z as a-z. A phrase is `window` consecutive
words of a benchmark item, or the whole item if it has fewer.

Defined cases: null or wordless texts and items have no words and match nothing; repeated items
each count, repeated rows are each reported; an empty benchmark leaves every document clean;
other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright import session
from tallywright.llm import text as X

WINDOW = 13
#: Phrases broadcast at once; more are searched block by block over the stored index.
BLOCK = 1 << 18
_INDEX = ("doc_ids array<bigint>, doc_starts array<int>, terms array<bigint>, term_starts array<int>, gaps array<int>")
_HITS = "doc_id bigint, row_at bigint, n_words bigint, spans array<struct<first:bigint,after:bigint>>, items array<bigint>"


@dataclass
class Phrases:
    """Distinct phrases: offset-ordered terms, CSR; and the items each stands in, CSR."""

    terms: np.ndarray
    bounds: np.ndarray
    items: np.ndarray
    item_bounds: np.ndarray


def item_phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, terms (hashes in order) of every phrase of items(item_id, text)."""

    def run(batches):
        for batch in batches:
            for rows, data, bounds in X.slices(batch, "text"):
                starts, ends, at = X.words(data, bounds, X.ALNUM)
                h = X.word_hashes(data, starts, ends)
                n = np.diff(at)
                per = np.where(n > window, n - window + 1, np.minimum(n, 1))
                row = np.repeat(np.arange(len(per)), per)
                first = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())
                size = np.minimum(window, n[row])
                out = np.concatenate([[0], np.cumsum(size)])
                flat = h[np.repeat(first - out[:-1], size) + np.arange(out[-1])]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), X.ragged(flat.view(np.int64), out)], names=["item_id", "terms"])

    return items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(run, "item_id bigint, terms array<bigint>")


def _collected(rows) -> Phrases:
    size = [len(r["terms"]) for r in rows]
    return Phrases(np.array([t for r in rows for t in r["terms"]], np.int64).view(np.uint64), np.concatenate([[0], np.cumsum(size, dtype=np.int64)]),
                   np.array([i for r in rows for i in r["items"]], np.int64), np.concatenate([[0], np.cumsum([len(r["items"]) for r in rows], dtype=np.int64)]))


def _segment_arrays(data, bounds, vocabulary):
    starts, ends, at = X.words(data, bounds, X.ALNUM)
    h = X.word_hashes(data, starts, ends)
    if vocabulary is None:
        terms, term = np.unique(h, return_inverse=True)
        place = np.arange(len(h))
    else:
        term = np.searchsorted(vocabulary, h)
        term[term == len(vocabulary)] = 0
        known = vocabulary[term] == h if len(vocabulary) else np.zeros(len(h), bool)
        place = np.flatnonzero(known)
        term, terms = term[place], vocabulary
    order = np.argsort(term.astype(np.uint16) if len(terms) < 1 << 16 else term, kind="stable")
    count = np.bincount(term, minlength=len(terms)) if len(terms) else np.zeros(0, np.int64)
    place = place[order]
    held = np.flatnonzero(count)
    term_starts = np.concatenate([[0], np.cumsum(count[held])])
    gaps = np.diff(place, prepend=0)
    gaps[term_starts[:-1]] = place[term_starts[:-1]]
    return at, terms[held], term_starts, gaps


def build(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """The stored index of docs(doc_id, text), of all terms or of those in `vocabulary` (sorted
    hashes, of bounded size): terms no search asks for need not be kept."""
    spark = docs.sparkSession
    shared = None if vocabulary is None else spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        asked = None if shared is None else shared.value
        for batch in batches:
            for rows, data, bounds in X.slices(batch, "text"):
                at, terms, term_starts, gaps = _segment_arrays(data, bounds, asked)
                one = lambda v: X.ragged(v, np.array([0, len(v)]))
                ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(0))
                yield pa.RecordBatch.from_arrays([ids, one(at.astype(np.int32)), one(terms.view(np.int64)), one(term_starts.astype(np.int32)), one(gaps.astype(np.int32))],
                                                 names=["doc_ids", "doc_starts", "terms", "term_starts", "gaps"])

    path = session.scratch(spark, "positional-index")
    docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _INDEX).write.parquet(path)
    return spark.read.parquet(path)


def term_counts(index: DataFrame) -> DataFrame:
    """term, n: occurrences over the whole index."""
    both = F.explode(F.arrays_zip("terms", F.transform(F.sequence(F.lit(1), F.size("terms")), lambda i: F.element_at("term_starts", i + 1) - F.element_at("term_starts", i)).alias("n")))
    return index.where(F.size("terms") > 0).select(both.alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.n").alias("n"))


def _opened(batch: pa.RecordBatch):
    """Each segment of a batch of index rows: doc ids, doc starts, terms, term starts, positions."""
    lists = [batch.column(i) for i in range(5)]
    for r in range(batch.num_rows):
        ids = lists[0][r].values
        starts, terms, term_starts, gaps = (x[r].values.to_numpy(zero_copy_only=False) for x in lists[1:])
        run = np.cumsum(gaps, dtype=np.int64)
        before = np.where(term_starts[:-1] > 0, run[term_starts[:-1] - 1], 0) if len(terms) else np.zeros(0, np.int64)
        yield ids, starts, terms.view(np.uint64), term_starts, run - np.repeat(before, np.diff(term_starts))


class Plan:
    """Phrases made ready: term numbers, and each phrase's offsets from its rarest term on."""

    def __init__(self, phrases: Phrases, counts: dict[int, int]):
        self.phrases = phrases
        self.vocabulary = np.unique(phrases.terms)
        self.size = np.diff(phrases.bounds)
        number = np.searchsorted(self.vocabulary, phrases.terms)
        often = np.array([counts.get(int(t), 0) for t in self.vocabulary.view(np.int64)], np.int64)
        row = X.rows_of(phrases.bounds)
        order = np.lexsort((often[number], row))
        self.term = number[order]
        self.offset = order - phrases.bounds[:-1][row]
        lead = self.term[phrases.bounds[:-1]] if len(self.size) else self.term[:0]
        self.by_lead = np.argsort(lead, kind="stable")
        self.lead_bounds = np.searchsorted(lead[self.by_lead], np.arange(len(self.vocabulary) + 1))

    def matches(self, terms, term_starts, places, n_words):
        """(phrase, first position) of every occurrence in a segment, documents apart."""
        number = np.searchsorted(self.vocabulary, terms)
        number[number == len(self.vocabulary)] = 0
        ours = np.flatnonzero(self.vocabulary[number] == terms) if len(self.vocabulary) else np.zeros(0, int)
        at_place = np.full(n_words, -1, np.int64)
        held = np.diff(term_starts)
        keep = np.zeros(len(terms), bool)
        keep[ours] = True
        chosen = np.repeat(keep, held)
        at_place[places[chosen]] = np.repeat(number, held)[chosen]
        found = []
        leads = ours[self.lead_bounds[number[ours] + 1] > self.lead_bounds[number[ours]]]
        for t in leads:
            spot = places[term_starts[t]:term_starts[t + 1]]
            led = self.by_lead[self.lead_bounds[number[t]]:self.lead_bounds[number[t] + 1]]
            step = max(1, (1 << 20) // max(1, len(spot)))
            for i in range(0, len(led), step):
                some = led[i:i + step]
                phrase = np.repeat(some, len(spot))
                first = np.tile(spot, len(some)) - self.offset[self.phrases.bounds[phrase]]
                ok = (first >= 0) & (first + self.size[phrase] <= n_words)
                phrase, first = phrase[ok], first[ok]
                rank, done = 1, []
                while len(phrase):
                    ended = self.size[phrase] <= rank
                    done.append((phrase[ended], first[ended]))
                    phrase, first = phrase[~ended], first[~ended]
                    j = self.phrases.bounds[phrase] + rank
                    same = at_place[first + self.offset[j]] == self.term[j]
                    phrase, first = phrase[same], first[same]
                    rank += 1
                found += done
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _merged(first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans in order, of spans in any order."""
    order = np.argsort(first, kind="stable")
    first, after = first[order], np.maximum.accumulate(after[order])
    opens = np.ones(len(first), bool)
    opens[1:] = first[1:] > after[:-1]
    edge = np.flatnonzero(opens)
    return first[edge], after[np.append(edge[1:], len(first)) - 1]


def _search(shared):
    def run(batches):
        plan = shared.value
        for batch in batches:
            for ids, starts, terms, term_starts, places in _opened(batch):
                n = len(ids)
                phrase, first = plan.matches(terms, term_starts, places, int(starts[-1]))
                doc = np.searchsorted(starts, first, "right") - 1
                inside = first + plan.size[phrase] <= starts[doc + 1] if len(first) else np.zeros(0, bool)
                phrase, first, doc = phrase[inside], first[inside], doc[inside]
                order = np.argsort(doc, kind="stable")
                phrase, first, doc = phrase[order], first[order], doc[order]
                at = np.searchsorted(doc, np.arange(n + 1))
                spans, items = [[]] * n, [[]] * n
                for d in np.flatnonzero(np.diff(at)):
                    s = slice(at[d], at[d + 1])
                    a, b = _merged(first[s] - starts[d], first[s] - starts[d] + plan.size[phrase[s]])
                    spans[d] = [{"first": int(x), "after": int(y)} for x, y in zip(a, b, strict=True)]
                    seen = np.unique(phrase[s])
                    items[d] = np.unique(np.concatenate([plan.phrases.items[plan.phrases.item_bounds[p]:plan.phrases.item_bounds[p + 1]] for p in seen])).tolist()
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.arange(n, dtype=np.int64)), pa.array(np.diff(starts).astype(np.int64)),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))), pa.array(items, pa.list_(pa.int64()))],
                    names=["doc_id", "row_at", "n_words", "spans", "items"])

    return run


def _blocks(phrases: DataFrame, block: int):
    """The distinct phrases with their items, at most `block` at a time."""

    distinct = session.cut(phrases.groupBy("terms").agg(F.collect_set("item_id").alias("items")))
    parts = max(1, -(-distinct.count() // block))
    for i in range(parts):
        yield _collected(distinct.where(F.pmod(F.hash("terms"), F.lit(parts)) == i).collect()), parts


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, spans (disjoint word ranges inside phrases), items of every document."""
    spark = docs.sparkSession
    phrases = session.cut(item_phrases(items, window))
    vocabulary = phrases.select(F.explode("terms").alias("term")).distinct()
    # Beyond a bounded vocabulary the index keeps every term.
    known = np.unique(np.array([r["term"] for r in vocabulary.collect()], np.int64).view(np.uint64)) if vocabulary.count() <= 1 << 22 else None
    index = build(docs, known)
    counted = session.cut(term_counts(index))
    out = None
    for some, parts in _blocks(phrases, block):
        asked = np.unique(some.terms.view(np.int64)).tolist()
        # As an Arrow table: a list of rows is made ready by Python workers of its own, which stay beside the others.
        wanted = spark.createDataFrame(pa.table({"term": pa.array(asked, pa.int64())}))
        counts = {r["term"]: r["n"] for r in counted.join(F.broadcast(wanted), "term").collect()} if asked else {}
        shared = spark.sparkContext.broadcast(Plan(some, counts))
        hits = index.mapInArrow(_search(shared), _HITS)
        if parts == 1:
            return hits.drop("row_at")
        keyed = hits.withColumn("segment", F.monotonically_increasing_id() - F.col("row_at"))
        out = keyed if out is None else out.union(keyed)
    raise_to = out.groupBy("segment", "row_at").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    @F.pandas_udf("array<struct<first:bigint,after:bigint>>")
    def merged(all_spans):
        def one(spans):
            if not len(spans):
                return []
            a, b = _merged(np.array([s["first"] for s in spans]), np.array([s["after"] for s in spans]))
            return [{"first": int(x), "after": int(y)} for x, y in zip(a, b, strict=True)]

        return all_spans.map(one)

    return raise_to.select("doc_id", "n_words", merged("spans").alias("spans"), "items")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans, contaminated (a twentieth of the words are hit)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["after"] - x["first"])
    found = matches(docs, items, window).withColumn("n_hit", n_hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def near(docs: DataFrame, queries: dict[int, list[str]], within: int) -> DataFrame:
    """doc_id, query, place: where a query's rarest term stands with all its other terms at most
    `within` words away. `queries` (id -> words) is a small driver-side list."""
    spark = docs.sparkSession
    hashed = {}
    for q, words in queries.items():
        raw = [w.encode() for w in dict.fromkeys(words)]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(w) for w in raw])
        hashed[q] = X.word_hashes(data, ends - [len(w) for w in raw], ends)
    index = build(docs, np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed.values()])))
    counts = {r["term"]: r["n"] for r in term_counts(index).collect()}
    ready = {q: sorted(h.tolist(), key=lambda t: (counts.get(np.array(t, np.uint64).view(np.int64).item(), 0), t)) for q, h in hashed.items() if len(h)}
    shared = spark.sparkContext.broadcast(ready)

    def run(batches):
        for batch in batches:
            for ids, starts, terms, term_starts, places in _opened(batch):
                lists = {t: places[term_starts[i]:term_starts[i + 1]] for i, t in enumerate(terms.tolist())}
                for q, order in shared.value.items():
                    if any(t not in lists for t in order):
                        continue
                    spot = lists[order[0]]
                    doc = np.searchsorted(starts, spot, "right") - 1
                    for t in order[1:]:
                        low, high = np.maximum(spot - within, starts[doc]), np.minimum(spot + within, starts[doc + 1] - 1)
                        ok = np.searchsorted(lists[t], high, "right") > np.searchsorted(lists[t], low)
                        spot, doc = spot[ok], doc[ok]
                    if len(spot):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(np.full(len(spot), q, np.int64)), pa.array((spot - starts[doc]).astype(np.int64))], names=["doc_id", "query", "place"])

    return index.mapInArrow(run, "doc_id bigint, query bigint, place bigint")
