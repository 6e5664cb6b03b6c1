"""Jaccard join of word-shingle sets by parity sketches.

A set of n shingles is XOR-hashed into `parts` words of 64 bits: each shingle flips one bit of one
part. A bit differs only if a shingle does, so the Hamming distance of two sketches is at most the
size of the symmetric difference. Sets with Jaccard similarity >= 90/100 differ in at most
(a + b) / 19 shingles; sizes are banded so that linked sets meet in one band's sketch layout, whose
number of parts exceeds that bound by `slack` and one. By the pigeonhole more than `slack` parts
then have the same shingles: (band, part, XOR of the part's shingle hashes) is the join key. Empty
parts are equal between strangers too, so a set with at most `slack` of them gives no keys for
them: with any linked set it still shares a part that is not empty. Candidates are held against
the Hamming bound on their sketches, and what is left against the sets themselves. For that the
words of every `FOLD` parts are XORed into one: that can only lower a distance, so the bound holds,
and there are still about eight bits to each shingle that linked sets may differ by.

Equal sets are one class with one representative before the join. In a key's group every member
is paired with the least one only. Where members of a group are in different components
afterwards, those outside the group's commonest component (the strays) are compared with the
members of other components: pair by pair in small groups, and in larger ones by sketches, block
against block inside tasks that return only what passes the Hamming bound. So every two members
of a group are in one component or were compared, no link is lost, and no group is expanded into
all its pairs.

Defined cases: null texts and texts without words have no set, n_shingles 0, and link with nothing;
a text of fewer words than a shingle is one shingle; rows with a null id have the size of their set,
take no part in links and have no component; repeated rows link as equal sets; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm import graph
from tallywright.llm import text as X
from tallywright.llm.store import stored

#: Members of a group whose strays are paired in the plan; larger groups go block by block.
SMALL_GROUP = 32
BLOCK_ROWS = 2048
#: Bytes of text worked on at a time: more are no faster and only take memory.
SLICE_BYTES = 1 << 17
#: Parts of a layout whose words become one word of the sketch that candidates carry.
FOLD = 8
#: Lists of ids up to this many rows (of 8 bytes) are broadcast; longer ones are shuffled.
BROADCAST_IDS = 1 << 20


def bands(percent: int, largest: int = 1 << 40) -> np.ndarray:
    """Least sizes of the bands: a set linked with one of band i is in band i - 1, i or i + 1."""
    low = [1]
    while low[-1] <= largest:
        low.append(low[-1] * 100 // percent + 1)
    return np.array(low, np.int64)


def most_apart(low: np.ndarray, band: np.ndarray, percent: int) -> np.ndarray:
    """Most shingles that two linked sets can differ by if the smaller is of the band."""
    a = low[band + 1] - 1
    return (a + a * 100 // percent) * (100 - percent) // (100 + percent)


def slack(apart: np.ndarray, percent: int) -> np.ndarray:
    """Spare parts: several times the empty ones to be expected, and one."""
    each = (100 + percent) / (2 * (100 - percent))  # shingles in a part
    return 1 + (apart * 5 * np.exp(-each)).astype(np.int64)


def parts_of(low: np.ndarray, band: np.ndarray, percent: int) -> np.ndarray:
    """Parts of a band's layout; none if linked sets are equal there."""
    apart = most_apart(low, band, percent)
    return np.where(apart > 0, apart + 1 + slack(apart, percent), 0)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and the rows' bounds."""
    starts, ends, at = X.words(data, bounds)
    sums = X.running(X.word_hashes(data, starts, ends))
    count = np.diff(at)
    per = np.where(count >= n_words, count - n_words + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(per)), per)
    first = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())
    h = X.span_hash(sums, first, np.minimum(first + n_words, at[1:][row]))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(per) + 1))


def sketch(h: np.ndarray, bounds: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parity sketches of sorted sets in layouts of `parts` parts each: a word of parity bits, the
    XOR of the shingle hashes and the number of shingles of every part, and the rows' bounds."""
    row = X.rows_of(bounds)
    # The high half of a hash picks the part, in order; the low bits pick the bit.
    part = ((h >> np.uint64(32)) * parts[row].astype(np.uint64)) >> np.uint64(32)
    at = np.concatenate([[0], np.cumsum(parts)])
    used = parts[row] > 0
    h, row, part = h[used], row[used], part[used]
    # Parts without shingles are words of zeros.
    edge = np.searchsorted(at[:-1][row] + part.astype(np.int64), np.arange(at[-1] + 1))
    mixed = X.mix(h)

    def folded(values):
        run = np.zeros(len(values) + 1, np.uint64)
        np.bitwise_xor.accumulate(values, out=run[1:])
        return run[edge[1:]] ^ run[edge[:-1]]

    return folded(np.uint64(1) << (mixed & np.uint64(63))), folded(X.mix(mixed ^ np.uint64(0x5157))), np.diff(edge), at


def folded(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The XOR of every FOLD words of each row (the last ones of a row may be fewer), and the rows' bounds."""
    size = -(-np.diff(bounds) // FOLD)
    at = np.concatenate([[0], np.cumsum(size)])
    starts = np.repeat(bounds[:-1], size) + FOLD * (np.arange(at[-1]) - np.repeat(at[:-1], size))
    return (np.bitwise_xor.reduceat(words, starts) if len(starts) else words[:0]), at


def _sets(n_words: int):
    def run(batches):
        for batch in batches:
            for rows, data, bounds in X.slices(batch, "text", SLICE_BYTES):
                h, at = shingle_sets(data, bounds, n_words)
                total = np.concatenate([[np.uint64(0)], np.cumsum(X.mix(h), dtype=np.uint64)])
                other = np.concatenate([[np.uint64(0)], np.cumsum(X.mix(h ^ np.uint64(0xABCD)), dtype=np.uint64)])
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), pa.array(np.diff(at)), pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)),
                    pa.array((other[at[1:]] - other[at[:-1]]).view(np.int64))], names=["doc_id", "n", "sum_a", "sum_b"])

    return run


def _keys(n_words: int, percent: int):
    """doc_id, text -> doc_id, key, seat: one row per part of the document's two layouts, its own
    band's (even seats) and that of the band below (odd seats)."""
    low = bands(percent)

    def run(batches):
        for batch in batches:
            for rows, data, bounds in X.slices(batch, "text", SLICE_BYTES):
                h, at = shingle_sets(data, bounds, n_words)
                size = np.diff(at)
                own = np.searchsorted(low, size, "right") - 1
                ids = rows.column(0).to_numpy(zero_copy_only=False)
                for below in (0, 1):
                    band = np.maximum(own - below, 0)
                    parts = np.where((size > 0) & (own >= below), parts_of(low, band, percent), 0)
                    _, value, count, pat = sketch(h, at, parts)
                    row = X.rows_of(pat)
                    place = np.arange(len(value)) - pat[:-1][row]
                    sparse = X.row_sums(count == 0, pat) > slack(most_apart(low, band, percent), percent)
                    use = np.flatnonzero((count > 0) | sparse[row])
                    where = X.mix((band[row].astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row[use]]), pa.array(X.mix(value ^ where)[use].view(np.int64)),
                                                      pa.array((2 * place + below)[use].astype(np.int32))], names=["doc_id", "key", "seat"])

    return run


def _items(n_words: int):
    """doc_id, text -> doc_id, items: the set itself."""

    def run(batches):
        for batch in batches:
            for rows, data, bounds in X.slices(batch, "text", SLICE_BYTES):
                h, at = shingle_sets(data, bounds, n_words)
                yield pa.RecordBatch.from_arrays([rows.column(0), X.ragged(h.view(np.int64), at)], names=["doc_id", "items"])

    return run


def _packed(n_words: int, percent: int):
    """doc_id, text -> the size of the set and its two sketches, folded (own band, band below)."""
    low = bands(percent)

    def run(batches):
        for batch in batches:
            for rows, data, bounds in X.slices(batch, "text", SLICE_BYTES):
                h, at = shingle_sets(data, bounds, n_words)
                size = np.diff(at)
                own = np.searchsorted(low, size, "right") - 1
                columns = [rows.column(0), pa.array(own), pa.array(size)]
                for shift in (0, 1):
                    words, _, _, wat = sketch(h, at, np.where(size > 0, parts_of(low, np.maximum(own - shift, 0), percent), 0))
                    words, wat = folded(words, wat)
                    columns.append(X.ragged(words.view(np.int64), wat))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "band", "n", "sketch", "below"])

    return run


def only(docs: DataFrame, ids: DataFrame, how: str, on: str = "doc_id") -> DataFrame:
    """Rows of `docs` whose doc_id (or `on`) is (left_semi) or is not (left_anti) in `ids`; the texts stay
    where they are unless the list is long."""
    small = ids.count() <= BROADCAST_IDS
    return docs.join(ids.hint("broadcast" if small else "shuffle_hash"), on, how)


def _linked(pairs: DataFrame, packed: DataFrame, texts: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Those of pairs(a, b) that pass the Hamming bound and then the exact comparison. Sketches,
    a small part of the sets' size, go to the pairs first; sets are made anew from the texts, and only of
    documents in the pairs that are left."""

    def side(df, name, *columns):
        return df.select(F.col("doc_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    # Sizes first: they say which layout a pair is compared in, that of the lower band of the two,
    # and sets of too different sizes need no sketches.
    sized = pairs.join(side(packed, "a", "band", "n"), "a").join(side(packed, "b", "band", "n"), "b")
    near = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent
    sized = sized.where((F.abs(F.col("a_band") - F.col("b_band")) <= 1) & near)
    words = ("sketch", "below")
    mine = F.when(F.col("a_band") <= F.col("b_band"), F.col("a_sketch")).otherwise(F.col("a_below"))
    yours = F.when(F.col("b_band") <= F.col("a_band"), F.col("b_sketch")).otherwise(F.col("b_below"))
    half = sized.join(side(packed, "a", *words), "a").withColumn("mine", mine).drop("a_sketch", "a_below")
    both = half.join(side(packed, "b", *words), "b")
    apart = F.aggregate(F.zip_with("mine", yours, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    fits = apart * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent)
    close = stored(both.where(fits).select("a", "b"), "close", release=True)
    wanted = stored(close.select(F.col("a").alias("doc_id")).union(close.select("b")).distinct(), "close")
    sets = only(texts, wanted, "left_semi").mapInArrow(_items(n_words), "doc_id bigint, items array<bigint>")
    left = close.join(side(sets, "a", "items"), "a").join(side(sets, "b", "items"), "b")
    common = F.size(F.array_intersect("a_items", "b_items"))
    return left.where(common * 100 >= (F.size("a_items") + F.size("b_items") - common) * percent).select("a", "b")


def links(docs: DataFrame, n_words: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Membership (doc_id, n_shingles, rep: the class of equal sets) of all documents with an id;
    links (a, b) between representatives, enough to connect all that are linked; and the linked
    representatives' components (node, root)."""
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sized = stored(named.mapInArrow(_sets(n_words), "doc_id bigint, n bigint, sum_a bigint, sum_b bigint"), "shingle-classes")
    same = ["n", "sum_a", "sum_b"]
    reps = sized.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"))
    member = sized.join(reps, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep")).alias("rep"))

    # Copies carry the set of their representative and add nothing.
    member = stored(member, "shingle-classes")
    texts = only(named, member.where("n_shingles > 0 and rep <> doc_id").select("doc_id"), "left_anti")
    keys = texts.mapInArrow(_keys(n_words, percent), "doc_id bigint, key bigint, seat int")
    by_key = Window.partitionBy("key").orderBy("doc_id")
    met = keys.withColumn("pivot", F.first("doc_id").over(by_key)).withColumn("after", F.lead("doc_id").over(by_key))
    met = stored(met.where("doc_id <> pivot or after is not null").select("key", "doc_id", "seat", "pivot"), "meetings", release=True)
    pairs = stored(met.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct(), "candidates")
    wanted = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "candidates")
    # The id's text may be in several rows: the members of a class are read once.
    texts = only(named, wanted, "left_semi")
    if not member.groupBy("doc_id").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["doc_id"])
    packed = stored(texts.mapInArrow(
        _packed(n_words, percent), "doc_id bigint, band bigint, n bigint, sketch array<bigint>, below array<bigint>"), "sketches", release=True)
    found = stored(_linked(pairs, packed, texts, n_words, percent), "links", release=True)
    return member, *_resolve(met, pairs, found, packed, texts, n_words, percent)


def _matrix(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [x.values.to_numpy().view(np.uint64) for x in column]


def _compared(percent: int):
    """Strays against members of one group: the pairs within the Hamming bound. A pair is looked
    at in the first of the large groups that both are in by the layouts they meet in here, and, if
    both sets are of one band, in that band's layout."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            here = key[0].as_py()
            words = _matrix(right.column("words"))
            width = min(map(len, words))
            alike = np.flatnonzero([len(w) == width for w in words])
            held = {c: right.column(c).to_numpy()[alike] for c in ("doc_id", "root", "n", "below", "stray", "pivot")}
            member, met = np.stack([words[i] for i in alike]), right.column("keys").take(pa.array(alike))
            mine = zip(*(left.column(c).to_pylist() for c in ("doc_id", "root", "n", "below", "pivot")), _matrix(left.column("words")), left.column("keys"), strict=True)
            for doc, root, n, below, pivot, own, keys in mine:
                if doc == pivot or len(own) != width:
                    continue
                # Of two strays the one with the greater id looks at the other.
                use = np.flatnonzero((held["root"] != root) & (held["doc_id"] != held["pivot"]) & ~(held["below"] & below)
                                     & (~held["stray"] | (held["doc_id"] < doc)))
                apart = np.bitwise_count(member[use] ^ own).sum(1, dtype=np.int64)
                use = use[apart * (100 + percent) <= (held["n"][use] + n) * (100 - percent)]
                keys = set(keys.as_py()) if len(use) else ()
                for i in use.tolist():
                    if here == min(keys.intersection(met[i].as_py())):
                        other = int(held["doc_id"][i])
                        a.append(min(other, doc))
                        b.append(max(other, doc))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _resolve(met: DataFrame, done: DataFrame, found: DataFrame, packed: DataFrame, texts: DataFrame, n_words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links between members of a key's group that are in different components, added to those
    found, and the components then."""
    root = graph.components(found)
    marked = met.join(root.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    marked = stored(marked, "meetings")
    per_root = marked.groupBy("key", "root").agg(F.count("*").alias("n"))
    groups = per_root.groupBy("key").agg(F.sum("n").alias("members"), F.max(F.struct("n", "root")).alias("main"))
    groups = groups.where("members > main.n").select("key", "members", (F.col("members") - F.col("main.n")).alias("strays"), F.col("main.root").alias("main"))
    rows = stored(marked.join(groups, "key").withColumn("stray", F.expr("root <> main")), "open-groups")

    small = rows.where(F.col("members") <= SMALL_GROUP)
    other = small.where("stray").select("key", F.col("doc_id").alias("x"), F.col("root").alias("x_root"))
    pairs = small.join(other, "key").where("root <> x_root and doc_id <> pivot and x <> pivot and (not stray or doc_id < x)")
    pairs = pairs.select(F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b"))

    large = rows.where(F.col("members") > SMALL_GROUP).withColumn("below", F.col("seat") % 2 == 1)
    keys = large.groupBy("doc_id", "below").agg(F.collect_list("key").alias("keys"))
    sketches = packed.select("doc_id", "n", "sketch", F.col("below").alias("lower"))
    large = large.join(keys.join(sketches, "doc_id"), ["doc_id", "below"])
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    own = lambda n: F.pmod(F.xxhash64("doc_id"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    large = large.select("key", "doc_id", "root", "n", "below", "pivot", "stray", "members", "strays",
                         F.when(F.col("below"), F.col("lower")).otherwise(F.col("sketch")).alias("words"), "keys")
    left = large.where("stray").withColumn("x", own("strays")).withColumn("y", every("members")).drop("members", "strays")
    right = large.withColumn("y", own("members")).withColumn("x", every("strays")).drop("members", "strays")
    right = right.toDF(*right.columns)  # apart from the left side's columns
    near = left.groupBy("key", "x", "y").cogroup(right.groupBy("key", "x", "y")).applyInArrow(_compared(percent), "a bigint, b bigint")

    fresh = stored(pairs.union(near).distinct().join(done, ["a", "b"], "left_anti"), "candidates")
    new = stored(_linked(fresh, packed, texts, n_words, percent), "links")
    if new.isEmpty():
        return found, root
    found = stored(found.union(new), "links")
    return found, graph.components(found)


def classes(docs: DataFrame, n_words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) of every document."""
    member, _, root = links(docs, n_words, percent)
    root = root.select(F.col("node").alias("rep"), "root")
    nameless = docs.where("doc_id is null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _sets(n_words), "doc_id bigint, n bigint, sum_a bigint, sum_b bigint")
    nameless = nameless.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"))
    return member.join(root, "rep", "left").select("doc_id", "n_shingles", F.coalesce("root", "rep", "doc_id").alias("component_id")).union(nameless)
