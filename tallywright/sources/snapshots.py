"""Tables whose rows are replaced by key: snapshots of bucket files, named by a manifest.

A load writes new files aside and then one small file, the manifest of the next version, which says
which folders make up each bucket now. Readers take the highest version, so they see the table
before a load or after it and nothing in between; a load that is killed leaves files that no
manifest names. Two loads at a time can't both take the next version: the later one fails and
changes nothing. Rows lie in buckets by a hash of their key: a load only looks at the buckets it
brings keys for. Of the folders there that hold one of them already, it rewrites those that are not much larger
than what is brought; for a larger one the manifest notes that the keys of this load don't count in it
any more, and readers leave them out. It is rewritten when loads have brought half its size, so what loads
rewrite grows with what they bring and not with the table. Of many folders of a bucket the smaller ones are folded. The
number of buckets is a power of two that grows with the table. The schema is in the manifest, so no
footers are merged.
"""

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import anti_join

BUCKET_BYTES = 256 * 1024 * 1024  # a table with more than this in a bucket gets more of them
MOST_FOLDERS = 8  # the smaller half at least of a bucket's folders, if so many, is folded by a load that meets it
MOST_LISTS = 64  # a folder in which the keys of so many loads don't count is written anew
SENT_BYTES = 8 * 1024 * 1024  # of key lists, as written, that are sent to all tasks
KEPT_VERSIONS = 2  # readers of the version before finish undisturbed


class Conflict(RuntimeError):
    """Another load was committed first; this one changed nothing and can be run again."""


@dataclass
class Manifest:
    version: int
    key: str
    buckets: int
    schema: str
    parts: dict[str, list[str]] = field(default_factory=dict)  # bucket: folders below the data
    bytes: dict[str, int] = field(default_factory=dict)  # folder: size
    written: dict[str, int] = field(default_factory=dict)  # snapshot: folders it was written with
    #: folder: the key lists of loads whose keys don't count in it any more, and what these loads brought
    gone: dict[str, dict[str, int]] = field(default_factory=dict)

    def lists(self) -> set[str]:
        return {name for some in self.gone.values() for name in some}

    def folders(self, only: set[int] | None = None) -> list[str]:
        return [f for b, fs in sorted(self.parts.items()) if only is None or int(b) in only for f in fs]


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    files, at = _path(spark, path)
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


def _delete(spark: SparkSession, path: str) -> None:
    files, at = _path(spark, path)
    files.delete(at, True)


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{path}/_manifest") if n.endswith(".json"))


def _manifest_file(path: str, version: int) -> str:
    return f"{path}/_manifest/{version:012d}.json"


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """The table's newest manifest, or one of the kept ones; None where there is no such table."""
    if version is None:
        found = _versions(spark, path)
        if not found:
            return None
        version = found[-1]
    files, at = _path(spark, _manifest_file(path, version))
    lines = files.open(at)
    try:
        return Manifest(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(lines, "UTF-8")))
    finally:
        lines.close()


def _commit(spark: SparkSession, path: str, made: Manifest) -> None:
    """Written under another name, then renamed: the switch is one operation of the file system."""
    aside = f"{path}/_manifest/.{uuid.uuid4().hex}"
    files, at = _path(spark, aside)
    out = files.create(at, False)
    try:
        out.write(bytearray(json.dumps(asdict(made)).encode()))
    finally:
        out.close()
    _, target = _path(spark, _manifest_file(path, made.version))
    if files.exists(target) or not files.rename(at, target):
        files.delete(at, False)
        raise Conflict(f"version {made.version} of {path} is there already")


def _remove_old(spark: SparkSession, path: str) -> None:
    """Drop the versions before the kept ones, and the folders only they name."""
    found = _versions(spark, path)
    old, kept = found[:-KEPT_VERSIONS], found[-KEPT_VERSIONS:]
    if not old:
        return
    stay = [manifest(spark, path, v) for v in kept]
    used, lists = {f for m in stay for f in m.folders()}, {n for m in stay for n in m.lists()}
    for v in old:
        before = manifest(spark, path, v)
        gone = set(before.folders()) - used
        whole = {_snapshot_of(f) for f in gone} - {_snapshot_of(f) for f in used}
        for folder in whole | {f for f in gone if _snapshot_of(f) not in whole}:
            _delete(spark, f"{path}/_snapshots/{folder}")
        for name in before.lists() - lists:
            _delete(spark, _key_list(path, name))
        _delete(spark, _manifest_file(path, v))


def _size(spark: SparkSession, path: str) -> int:
    files, at = _path(spark, path)
    return files.getContentSummary(at).getLength()


def _key_list(path: str, name: str) -> str:
    return f"{path}/_keys/{name}"


def read(spark: SparkSession, path: str, only: set[int] | None = None, at: Manifest | None = None) -> DataFrame | None:
    """The table as its newest manifest has it, or some of its buckets."""
    at = at or manifest(spark, path)
    return None if at is None else _rows(spark, path, at, at.folders(only)).drop("_folder")


def _rows(spark: SparkSession, path: str, at: Manifest, folders: list[str]) -> DataFrame:
    """The rows that count in some folders, each with its ``_folder``."""
    schema = T.StructType.fromJson(json.loads(at.schema))
    place = F.regexp_extract("_metadata.file_path", r"/([^/]+/_bucket=[^/]+)/[^/]+$", 1)

    def scan(some):
        # A snapshot of which all buckets are wanted is one folder to list.
        listed, whole = [], {}
        for f in some:
            whole.setdefault(_snapshot_of(f), []).append(f)
        for snapshot, parts in whole.items():
            listed += [snapshot] if len(parts) == at.written[snapshot] else parts
        return (spark.read.schema(schema).option("recursiveFileLookup", True)
                .parquet(*[f"{path}/_snapshots/{f}" for f in listed]).withColumn("_folder", place))

    clean, late = [f for f in folders if f not in at.gone], [f for f in folders if f in at.gone]
    found = [scan(clean)] if clean else []
    if late:
        # One row for each folder and each load noted at it.
        pairs = [(f, name) for f in late for name in at.gone[f]]
        lists = [_key_list(path, name) for name in sorted({name for _, name in pairs})]
        keys = (spark.read.schema(T.StructType([schema[at.key]])).parquet(*lists)
                .withColumn("_list", F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+$", 1)))
        noted = spark.createDataFrame(pairs, "_at string, _list string")
        dead = keys.join(F.broadcast(noted), "_list").select("_at", F.col(at.key).alias("_key")).distinct()
        # Few keys are sent to the folders. Spark takes a join for as large as the product of its sides.
        most = max(len(at.gone[f]) for f in late)
        if len(late) * most * max(_size(spark, name) for name in lists) <= SENT_BYTES:
            dead = F.broadcast(dead)
        meets = (F.col("_folder") == F.col("_at")) & F.col(at.key).eqNullSafe(F.col("_key"))
        found.append(scan(late).join(dead, meets, "left_anti"))
    if not found:
        return spark.createDataFrame([], schema).withColumn("_folder", F.lit(""))
    return found[0].unionByName(found[1]) if len(found) > 1 else found[0]


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, key: str, buckets: int, fresh: list[str]) -> dict[str, int]:
    """A new snapshot: its folders, by size. A bucket that one key has made large is split over
    tasks; rows are not gathered by bucket."""
    spark, name = df.sparkSession, uuid.uuid4().hex[:12]
    folder = f"{path}/_snapshots/{name}"
    fresh.append(name)
    (df.withColumn("_bucket", _bucket(key, buckets)).hint("rebalance", F.col("_bucket"))
     .write.partitionBy("_bucket").parquet(folder))
    files, _ = _path(spark, folder)
    return {f"{name}/{n}": files.getContentSummary(_path(spark, f"{folder}/{n}")[1]).getLength()
            for n in _names(spark, folder) if n.startswith("_bucket=")}


def _snapshot_of(folder: str) -> str:
    return folder.split("/")[0]


def _bucket_of(folder: str) -> str:
    return folder.rsplit("=", 1)[1]


def _merged(old: str, new: T.StructType) -> str:
    """All columns of both; those of the table come first."""
    fields = T.StructType.fromJson(json.loads(old)).fields
    known = {f.name for f in fields}
    return T.StructType(fields + [f for f in new.fields if f.name not in known]).json()


def _wanted(total: int, buckets: int) -> int:
    while total > buckets * BUCKET_BYTES:
        buckets *= 2
    return buckets


def _starting(spark: SparkSession) -> int:
    """As many as a shuffle has partitions, rounded up to a power of two."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(0, n - 1).bit_length()


def replace_by_key(df: DataFrame, path: str, key: str, buckets: int | None = None) -> None:
    """Put the rows of ``df`` in place of all rows with the same keys (null is a key too). No rows:
    no change. With another number of ``buckets`` the table is laid out anew."""
    spark = df.sparkSession
    fresh: list[str] = []  # snapshots written by this load
    named: set[str] = set()
    lists: set[str] = set()
    try:
        made = _load(df, path, key, buckets, fresh)
        if made:
            _commit(spark, path, made)
            named, lists = {_snapshot_of(f) for f in made.bytes}, made.lists()
    finally:
        for name in set(fresh) - named:
            _delete(spark, f"{path}/_snapshots/{name}")
        for name in set(fresh[:1]) - lists:
            _delete(spark, _key_list(path, name))
    if made:
        _remove_old(spark, path)


def _load(df: DataFrame, path: str, key: str, buckets: int | None, fresh: list[str]) -> Manifest | None:
    """The manifest after the load; its files are written."""
    spark = df.sparkSession
    now = manifest(spark, path)
    layout = buckets or (now.buckets if now else _starting(spark))
    new = _write(df, path, key, layout, fresh)
    if not new:
        return None
    made = Manifest(now.version + 1 if now else 1, key, layout, _merged(now.schema, df.schema) if now else df.schema.json())
    if now is None:
        return _filled(made, {}, new)
    incoming = (spark.read.schema(df.schema).option("recursiveFileLookup", True)
                .parquet(f"{path}/_snapshots/{fresh[0]}"))
    kept = {f: now.bytes[f] for f in now.folders()}
    made.buckets = buckets or _wanted(sum(kept.values()) + sum(new.values()), layout)
    if made.buckets != now.buckets or key != now.key:
        whole = anti_join(read(spark, path, at=now), incoming, [key])
        whole = whole.unionByName(incoming, allowMissingColumns=True)
        return _filled(made, {}, _write(whole, path, key, made.buckets, fresh))
    dropped, stay, noted = _survivors(spark, path, now, incoming, new, key, fresh)
    kept = {f: n for f, n in kept.items() if f not in dropped}
    made.gone = {f: some for f, some in (now.gone | noted).items() if f in kept}
    return _filled(made, kept, new | stay, now.written)


def _filled(made: Manifest, kept: dict[str, int], new: dict[str, int], before: dict[str, int] | None = None) -> Manifest:
    made.bytes = kept | new
    made.written = {_snapshot_of(f): (before or {})[_snapshot_of(f)] for f in kept}
    for f in new:
        made.written[_snapshot_of(f)] = made.written.get(_snapshot_of(f), 0) + 1
    for f in sorted(made.bytes):
        made.parts.setdefault(_bucket_of(f), []).append(f)
    return made


def _survivors(spark: SparkSession, path: str, now: Manifest, incoming: DataFrame, new: dict[str, int], key: str,
               fresh: list[str]) -> tuple[set[str], dict[str, int], dict[str, dict[str, int]]]:
    """The folders that go, the folders of the rows that stay of them, and what is noted at others."""
    bring: dict[str, int] = {}
    for f, n in new.items():
        bring[_bucket_of(f)] = bring.get(_bucket_of(f), 0) + n
    shared = {b for b in bring if b in now.parts}
    if not shared:
        return set(), {}, {}
    # Written, so that Spark knows how few keys meet the table.
    name = fresh[0]
    incoming.select(key).distinct().write.parquet(_key_list(path, name))
    keys = spark.read.schema(T.StructType([incoming.schema[key]])).parquet(_key_list(path, name))
    here = _rows(spark, path, now, now.folders({int(b) for b in shared})).select(key, "_folder")
    met = here.join(keys.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    dropped: set[str] = set()
    noted: dict[str, dict[str, int]] = {}
    for f in (r["_folder"] for r in met.select("_folder").distinct().collect()):  # a name per folder at most
        some = now.gone.get(f, {}) | {name: bring[_bucket_of(f)]}
        if 2 * sum(some.values()) >= now.bytes[f] or len(some) > MOST_LISTS:
            dropped.add(f)
        else:
            noted[f] = some
    for b in shared:
        rest = sorted((f for f in now.parts[b] if f not in dropped), key=now.bytes.get)
        if len(rest) >= MOST_FOLDERS:
            dropped |= set(_small(rest, now.bytes))
    noted = {f: some for f, some in noted.items() if f not in dropped}
    if not dropped:
        return dropped, {}, noted
    stay = anti_join(_rows(spark, path, now, sorted(dropped)).drop("_folder"), keys, [key])
    return dropped, _write(stay, path, key, now.buckets, fresh), noted


def _small(folders: list[str], size: dict[str, int]) -> list[str]:
    """Of folders by size, the smaller half at least, and the next as long as it is no larger than those
    together; so a row is folded again only when its folder has about doubled."""
    n = (len(folders) + 1) // 2
    total = sum(size[f] for f in folders[:n])
    while n < len(folders) and size[folders[n]] <= total:
        total += size[folders[n]]
        n += 1
    return folders[:n]


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove snapshots that no kept manifest names, as loads that were killed leave them. Not while
    a load is running. Returns how many."""
    kept = [manifest(spark, path, v) for v in _versions(spark, path)]
    used, lists = {_snapshot_of(f) for m in kept for f in m.folders()}, {n for m in kept for n in m.lists()}
    lost = [n for n in _names(spark, f"{path}/_snapshots") if n not in used]
    for name in lost:
        _delete(spark, f"{path}/_snapshots/{name}")
    for name in _names(spark, f"{path}/_keys"):
        if name not in lists:
            _delete(spark, _key_list(path, name))
    return len(lost)
