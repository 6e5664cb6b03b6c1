"""CSV files larger than a task should hold: read by Spark's line reader, which splits them.

A line end inside quotes does not end a record, and whether a split begins inside quotes depends on
all text before it. So a first pass says, for both cases, how many records begin in each split and
how it ends; one row for each split, put together file by file, gives every split its beginning
and the number of its first record. A second pass cuts the records. A record that runs over a split's
end is put together from its pieces. A file whose last quote is not closed gives no rows.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

#: Rows of one for each split (of many MB) that are sent to every task at a time.
_SPLITS = 1 << 18


def lines(spark: SparkSession, folder: str, larger_than: int) -> DataFrame:
    """file, source_file, start (of the split), value of each line of the CSV files of more than
    ``larger_than`` bytes."""
    text = spark.read.text(folder, lineSep="\n", pathGlobFilter="*.[cC][sS][vV]", recursiveFileLookup=True)
    return text.where(F.col("_metadata.file_size") > larger_than).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("start"), "value")


def _closing(text: str, at: int) -> int:
    """The place after the quote that closes a cell, from inside it; -1 where none does."""
    while (at := text.find('"', at)) >= 0:
        if text[at + 1:at + 2] != '"':
            return at + 1
        at += 2
    return -1


def pieces(value: str, inside: bool) -> Iterator[tuple[str, bool, bool]]:
    """The parts of records in a line: (text, whether a record begins, whether it ends)."""
    if '"' not in value and "\r" not in value[:-1]:
        if inside:
            yield value + "\n", False, False
        else:
            yield value.removesuffix("\r"), True, True
        return
    begin, at, begins = 0, 0, not inside
    if inside:
        at = _closing(value, 0)
        if at < 0:
            yield value + "\n", False, False
            return
    elif value.startswith('"'):
        at = _closing(value, 1)
    while at >= 0:
        comma, end = value.find(",", at), value.find("\r", at)
        if comma >= 0 and (end < 0 or comma < end):
            at = comma + 1
        else:
            end = len(value) if end < 0 else end
            yield value[begin:end], begins, True
            if end + 1 >= len(value):
                return
            begin, at, begins = end + 1, end + 1, True
        if value[at:at + 1] == '"':
            at = _closing(value, at + 1)
    yield value[begin:] + "\n", begins, False


def _step(value: str, inside: bool) -> tuple[int, bool]:
    """Records that begin in a line, and whether it ends inside quotes."""
    n = 0
    for text, begins, ends in pieces(value, inside):
        n += begins and text != ""
        inside = not ends
    return n, inside


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _summed(batches):
    """How each split ends and how many records begin in it, from either beginning."""
    import pyarrow as pa

    names = ("file", "start", "n_out", "ends_out", "n_in", "ends_in")
    key, count, state = None, [0, 0], [False, True]

    def out():
        row = (*key, count[0], state[0], count[1], state[1])
        return pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, row, strict=True)})

    for file, start, value in _rows(batches):
        if (file, start) != key:
            if key is not None:
                yield out()
            key, count, state = (file, start), [0, 0], [False, True]
        if state[0] == state[1]:
            n, ends = _step(value, state[0])
            count, state = [count[0] + n, count[1] + n], [ends, ends]
        else:
            for i in (0, 1):
                n, state[i] = _step(value, state[i])
                count[i] += n
    if key is not None:
        yield out()


def _beginnings(spark: SparkSession, text: DataFrame) -> DataFrame:
    """file, start, inside, number (of the first record that begins in it), closed (the file as a
    whole) of each split."""
    path = scratch(spark, "splits")
    text.select("file", "start", "value").mapInArrow(
        _summed, "file string, start bigint, n_out bigint, ends_out boolean, n_in bigint, ends_in boolean"
    ).write.parquet(path)
    splits = spark.read.parquet(path)
    listed = splits.groupBy("file").agg(F.sort_array(F.collect_list(F.struct(
        "start", "n_out", "ends_out", "n_in", "ends_in"))).alias("splits"))
    at = F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(False).alias("inside"), F.lit(0).cast("bigint").alias("number"))
    first = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("bigint").alias("number"),
                     F.slice(F.array(at), 1, 0).alias("done"))
    whole = F.aggregate("splits", first, lambda s, x: F.struct(
        F.when(s["inside"], x["ends_in"]).otherwise(x["ends_out"]).alias("inside"),
        (s["number"] + F.when(s["inside"], x["n_in"]).otherwise(x["n_out"])).alias("number"),
        F.concat(s["done"], F.array(F.struct(x["start"].alias("start"), s["inside"].alias("inside"), s["number"].alias("number")))).alias("done")))
    done = listed.select("file", whole.alias("w")).select("file", (~F.col("w.inside")).alias("closed"), F.inline("w.done"))
    made = scratch(spark, "beginnings")
    done.write.parquet(made)
    return spark.read.parquet(made)


def _cut(batches):
    """file, number, part, text, whole: the records, and pieces of those that splits part."""
    import pyarrow as pa

    key, inside, number, held, mine = None, False, 0, [], False
    out: list[tuple] = []

    def give():
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)],
            names=["file", "number", "part", "text", "whole"])

    def left_over():
        # The end, or the middle, of a record that this split does not hold whole.
        if held:
            out.append((key[0], number - 1, key[1], "".join(held), False))
            held.clear()

    for file, start, begins_inside, first, value in _rows(batches):
        if (file, start) != key:
            left_over()
            key, inside, number, mine = (file, start), begins_inside, first, False
        for text, begins, ends in pieces(value, inside):
            inside = not ends
            if begins and not text:
                continue
            if begins:
                number, mine = number + 1, True
            held.append(text)
            if ends:
                out.append((file, number - 1, start, "".join(held), mine))
                held.clear()
        if len(out) >= 8192:
            yield give()
    left_over()
    if out:
        yield give()


def records(text: DataFrame) -> DataFrame:
    """file, number (0 is the header), text of the records of ``lines``."""
    spark = text.sparkSession
    known = _beginnings(spark, text).where("closed")
    blocks = max(1, -(-known.count() // _SPLITS))
    out = None
    for b in range(blocks):
        some = known if blocks == 1 else known.where(F.pmod(F.xxhash64("file"), F.lit(blocks)) == b)
        # Sent to the lines, which so stay in order.
        met = text.join(F.broadcast(some.drop("closed")), ["file", "start"])
        cut = met.select("file", "start", "inside", "number", "value").mapInArrow(
            _cut, "file string, number bigint, part bigint, text string, whole boolean")
        out = cut if out is None else out.unionByName(cut)
    parted = (out.where(~F.col("whole")).groupBy("file", "number")
              .agg(F.array_join(F.sort_array(F.collect_list(F.struct("part", "text")))["text"], "").alias("text")))
    return out.where("whole").select("file", "number", "text").unionByName(parted)


def unclosed(text: DataFrame) -> DataFrame:
    """file of those whose last quote is not closed."""
    return _beginnings(text.sparkSession, text).where(~F.col("closed")).select("file").distinct()
