"""Conversation structure repair by a dynamic program over persistent edit histories.

A conversation is repaired to nothing, or to an optional system turn followed by pairs of a user
and an assistant turn. Its turns are kept, given the role that is due, or deleted, and empty turns
are inserted, at least cost; of the cheapest repairs the one whose audit (the edits' initials in
order) is least in ASCII is taken.

The states of the program are what the repaired turns end with so far: nothing, system, user or
assistant. A state's best history is a node that links to the history it extends, so prefixes are
shared; a node also holds its ancestors at distances 1, 2, 4, ... and a rolling hash of its edits.
Two histories of one cost are compared at the end of their longest common prefix, which is searched
by hashes over those ancestors; equal hashes are verified by walking up to a shared node.

Turns are dealt over tasks by ranges of (conversation, turn, ...), so a conversation of any length
is split: a task finishes the conversations that lie wholly in it, and sums up its part of the
first and the last one as the best history from each state to each state. The parts of a
conversation are then joined in order. Its repaired turns are hashed in one pass over them in
order, as SHA-256 needs; that pass streams and holds no more than the audit.

Which turns repeat an earlier one (role and text) is found by an aggregation over digests; a repeat
goes to its turn's task as a marker row beside it.

Defined cases: a null conversation id is an id of its own; a null turn, role or text counts as one
space, and null turns come first; turns that are equal are ordered by role, then by a digest of
role and text; equal rows are one turn and its duplicates; a missing table row leaves no trace, a
conversation whose rows are all dropped has zeros, an empty audit and the empty text's hash; gaps
beyond the range of long are its greatest value; an empty table gives none; other columns are not
read. Roles count by their first character, and those but system, user and assistant can only be
given another role or be deleted.
"""

from __future__ import annotations

import hashlib
import json
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.store import stored

SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, UNFINISHED = 4, 3, 3, 3
_EMPTY, _SYSTEM, _USER, _ASSISTANT = range(4)
_DUE = {_EMPTY: _USER, _SYSTEM: _USER, _ASSISTANT: _USER, _USER: _ASSISTANT}
_NAME = {_USER: "user", _ASSISTANT: "assistant"}
_KEPT = {(_EMPTY, "s"): _SYSTEM, (_EMPTY, "u"): _USER, (_SYSTEM, "u"): _USER, (_ASSISTANT, "u"): _USER, (_USER, "a"): _ASSISTANT}
_LEGAL = {"su", "ua", "au"}
_PRIME, _BASE = (1 << 61) - 1, 1_000_003
_TURNS = 50_000


class Histories:
    """Edit histories as nodes of a tree; node 0 is the empty one."""

    def __init__(self):
        self.edit, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def extend(self, node: int, edit: str) -> int:
        up, at, k = [node], node, 0
        while len(self.up[at]) > k:
            at = self.up[at][k]
            up.append(at)
            k += 1
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(edit)) % _PRIME)
        self.up.append(tuple(up))
        return len(self.edit) - 1

    def ancestor(self, node: int, depth: int) -> int:
        while (far := self.depth[node] - depth) > 0:
            node = self.up[node][far.bit_length() - 1]
        return node

    def same(self, a: int, b: int) -> bool:
        """Do two nodes of one depth hold the same edits?"""
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def common(self, a: int, b: int) -> int:
        """The length of the longest common prefix."""
        depth = min(self.depth[a], self.depth[b])
        a, b = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.same(a, b):
            return depth
        while True:
            # The farthest ancestors that still differ; then the parents are the same.
            far = [k for k in range(len(self.up[a])) if not self.same(self.up[a][k], self.up[b][k])]
            if not far:
                return self.depth[a] - 1
            a, b = self.up[a][far[-1]], self.up[b][far[-1]]

    def less(self, a: int, more_a: str, b: int, more_b: str) -> bool:
        """Are the edits of `a` and `more_a` before those of `b` and `more_b` in ASCII?"""
        at = self.common(a, b)
        ends = []
        for node, more in ((a, more_a), (b, more_b)):
            deep = self.depth[node]
            ends.append(self.edit[self.ancestor(node, at + 1)] + (more if at + 1 == deep else "") if at < deep else more)
        if ends[0][:1] != ends[1][:1]:
            return ends[0][:1] < ends[1][:1]
        if self.depth[a] == self.depth[b]:
            return ends[0] < ends[1]
        return self.depth[a] < self.depth[b]

    def edits(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def solve(turns: list[tuple[str, bool, bool]], entry: int = _EMPTY) -> list[tuple[int, str] | None]:
    """The cost and audit of the best repair that begins in state `entry` and ends in each state, of
    turns (role initial, must go, unfinished)."""
    tree = Histories()
    best: list[tuple | None] = [None] * 4
    best[entry] = (0, 0)

    def better(new, old):
        return old is None or new[0] < old[0] or (new[0] == old[0] and tree.less(new[1], new[2], old[1], old[2]))

    def insert():
        for state in (_EMPTY, _SYSTEM, _ASSISTANT, _USER):
            if best[state]:
                cost, node = best[state]
                due = _DUE[state]
                new, old = (cost + INSERT, node, "I"), best[due] and (*best[due], "")
                if better(new, old):
                    best[due] = (new[0], tree.extend(node, "I"))

    insert()
    for initial, gone, unfinished in turns:
        offers: list[tuple | None] = [None] * 4
        extra = UNFINISHED if unfinished else 0
        for state in range(4):
            if best[state]:
                cost, node = best[state]
                moves = [(state, cost + DELETE, "D")]
                if not gone:
                    if (state, initial) in _KEPT:
                        moves.append((_KEPT[state, initial], cost + extra, "K"))
                    moves.append((_DUE[state], cost + REROLE + extra, "R"))
                for to, total, edit in moves:
                    if better((total, node, edit), offers[to]):
                        offers[to] = (total, node, edit)
        best = [x and (x[0], tree.extend(x[1], x[2])) for x in offers]
        insert()
    return [x and (x[0], tree.edits(x[1])) for x in best]


def join(parts: list[list[list]]) -> tuple[int, str]:
    """The best repair of a whole conversation from those of its parts, in order: for each entry
    state, what `solve` returned."""
    best: list = [(0, ""), None, None, None]
    for part in parts:
        after: list = [None] * 4
        for entry, so_far in enumerate(best):
            for state, more in enumerate(part[entry]) if so_far else ():
                if more:
                    new = (so_far[0] + more[0], so_far[1] + more[1])
                    after[state] = new if after[state] is None else min(after[state], new)
        best = after
    return min(x for x in (best[_EMPTY], best[_ASSISTANT]) if x)


class Repaired:
    """Applies an audit to turns in order; `digest` is that of the repaired turns so far."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.count = audit, 0, _EMPTY, 0
        self.digest = hashlib.sha256()

    def _out(self, role: str, text: str, edit: str) -> tuple[int, str, str, str]:
        self.digest.update((("\n" if self.count else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.count += 1
        return self.count - 1, role, text, edit

    def _inserted(self):
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.state = _DUE[self.state]
            yield self._out(_NAME[self.state], "", "I")

    def turn(self, role: str, text: str):
        """The repaired turns (position, role, text, edit) that one more turn leads to."""
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.state = _DUE[self.state] if edit == "R" else _KEPT[self.state, role[:1]]
            yield self._out(role if edit == "K" else _NAME[self.state], text, edit)

    def end(self):
        yield from self._inserted()


class Part:
    """What one task holds of a conversation, in order."""

    def __init__(self):
        self.turns, self.rows = [], []
        self.facts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "low": None, "high": None, "first": None, "last": None}

    def add(self, turn: int | None, role: str, text: str, repeat: bool) -> None:
        f, solid = self.facts, text.rstrip(SPACE)
        blank = not solid
        duplicate = repeat and not blank
        truncated = not blank and not duplicate and solid[-1] not in ".!?"
        f["blank"] += blank
        f["duplicate"] += duplicate
        f["truncated"] += truncated
        initial = role[:1]
        if f["first"] is None:
            f["first"] = initial
        else:
            f["illegal"] += f["last"] + initial not in _LEGAL
        f["last"] = initial
        if turn is not None:
            f["turns"] += f["high"] != turn
            f["low"] = turn if f["low"] is None else f["low"]
            f["high"] = turn
        self.turns.append((initial, blank or duplicate, truncated))
        self.rows.append((role, text))

    @staticmethod
    def merged(facts: list[dict]) -> dict:
        out = Part().facts
        for f in facts:
            if f["first"] is not None:
                if out["first"] is not None:
                    out["illegal"] += out["last"] + f["first"] not in _LEGAL
                out["first"], out["last"] = f["first"] if out["first"] is None else out["first"], f["last"]
            for name in ("blank", "duplicate", "truncated", "illegal"):
                out[name] += f[name]
            if f["low"] is not None:
                out["turns"] += f["turns"] - (f["low"] == out["high"])
                out["low"], out["high"] = f["low"] if out["low"] is None else out["low"], f["high"]
        return out


_REPORT, _SUMMARY, _ROW, _TURN = range(4)
_COLUMNS = {"conv": pa.string(), "kind": pa.int32(), "chunk": pa.int32(), "seq": pa.int64(), "gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(),
            "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string(), "summary": pa.binary(), "role": pa.string(), "text": pa.string(), "edit": pa.string()}
_SCHEMA = ("conv string, kind int, chunk int, seq bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
           "repaired_sha256 string, summary binary, role string, text string, edit string")


def _batches(rows, size: int = 4096):
    """Dicts as record batches of bounded size."""
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += len(r.get("text") or "") + len(r.get("audit") or "")
        if len(held) >= size or chars > 1 << 22:
            yield pa.RecordBatch.from_pydict({k: pa.array([h.get(k) for h in held], t) for k, t in _COLUMNS.items()})
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pydict({k: pa.array([h.get(k) for h in held], t) for k, t in _COLUMNS.items()})


def _report(conv: str, facts: dict, cost: int, audit: str, digest) -> dict:
    gaps = 0 if facts["low"] is None else facts["high"] - facts["low"] + 1 - facts["turns"]
    return {"conv": conv, "kind": _REPORT, "gaps": min(gaps, (1 << 63) - 1), "cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest(),
            **{k: facts[k] for k in ("blank", "duplicate", "truncated", "illegal")}}


def _turns(conv: str, made, keep: bool):
    for position, role, text, edit in made:
        if keep:
            yield {"conv": conv, "kind": _TURN, "seq": position, "role": role, "text": text, "edit": edit}


def _first_pass(with_turns: bool):
    def whole(conv: str, part: Part):
        cost, audit = join([[solve(part.turns)]])
        repaired = Repaired(audit)
        for role, text in part.rows:
            yield from _turns(conv, repaired.turn(role, text), with_turns)
        yield from _turns(conv, repaired.end(), with_turns)
        yield _report(conv, part.facts, cost, audit, repaired.digest)

    def open_(conv: str, part: Part, chunk: int):
        body = json.dumps({"facts": part.facts, "best": [solve(part.turns, entry) for entry in range(4)]})
        yield {"conv": conv, "kind": _SUMMARY, "chunk": chunk, "seq": 0, "summary": zlib.compress(body.encode("utf-8", "surrogatepass"))}
        for i, (role, text) in enumerate(part.rows):
            yield {"conv": conv, "kind": _ROW, "chunk": chunk, "seq": i, "role": role, "text": text}

    def rows(batches):
        chunk, conv, part, first, repeat = TaskContext.get().partitionId(), None, None, True, False
        for batch in batches:
            for key, turn, role, text, dropped, marker in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part is None or key != conv:
                    if part is not None:
                        # The first conversation may have begun in the task before.
                        yield from open_(conv, part, chunk) if first else whole(conv, part)
                        first = False
                    conv, part = key, Part()
                if marker:
                    repeat = True
                else:
                    if not dropped:
                        part.add(turn, role, text, repeat)
                    repeat = False
        if part is not None:
            yield from open_(conv, part, chunk)

    return lambda batches: _batches(rows(batches))


def _second_pass(with_turns: bool):
    def rows(batches):
        conv, parts, repaired, facts, cost = None, [], None, None, 0

        def begin():
            nonlocal repaired, facts, cost, parts
            facts = Part.merged([p["facts"] for p in parts])
            cost, audit = join([p["best"] for p in parts])
            repaired, parts = Repaired(audit), []

        def close():
            if repaired is None:
                begin()
            yield from _turns(conv, repaired.end(), with_turns)
            yield _report(conv, facts, cost, repaired.audit, repaired.digest)

        for batch in batches:
            for key, kind, summary, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != conv:
                    if conv is not None:
                        yield from close()
                    conv, parts, repaired = key, [], None
                if kind == _SUMMARY:
                    parts.append(json.loads(zlib.decompress(summary)))
                else:
                    if repaired is None:
                        begin()
                    yield from _turns(conv, repaired.turn(role, text), with_turns)
        if conv is not None:
            yield from close()

    return lambda batches: _batches(rows(batches))


def _passes(rows: DataFrame, with_turns: bool) -> DataFrame:
    """Reports and, if asked for, repaired turns of all conversations of `rows`."""
    spark = rows.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    plain = rows.select(text("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"), gone.alias("dropped"))
    plain = plain.withColumn("text", F.when(~F.col("dropped"), F.col("text")))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    # Written with an id, so that equal rows have an order that stays.
    kept = stored(plain.withColumn("digest", digest).withColumn("id", F.monotonically_increasing_id()), "turns")
    place = F.struct(F.col("turn").isNotNull(), "turn", "id")
    slim = kept.where("not dropped").select("conv", "turn", "role", "digest", "id")
    repeats = slim.groupBy("conv", "digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("conv", "digest", "first")
    markers = slim.join(repeats, ["conv", "digest"]).where(place > F.col("first"))
    none = F.lit(None).cast("string").alias("text")
    both = kept.withColumn("marker", F.lit(False)).unionByName(
        markers.select("conv", "turn", "role", none, F.lit(False).alias("dropped"), "digest", "id", F.lit(True).alias("marker")))
    order = ["conv", "turn", "role", "digest", "id"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), kept.count() // _TURNS)
    dealt = both.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.desc("marker"))
    first = stored(dealt.select("conv", "turn", "role", "text", "dropped", "marker").mapInArrow(_first_pass(with_turns), _SCHEMA), "repairs")
    open_ = first.where(F.col("kind").isin(_SUMMARY, _ROW)).repartition("conv").sortWithinPartitions("conv", "kind", "chunk", "seq")
    second = open_.select("conv", "kind", "summary", "role", "text").mapInArrow(_second_pass(with_turns), _SCHEMA)
    return first.where(F.col("kind").isin(_REPORT, _TURN)).unionByName(second).withColumn("conv_id", F.expr("try_cast(conv as bigint)"))


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each
    conversation of rows(conv_id, turn, role, text). Rows with a true `dropped` are not turns, but
    keep their conversation in the result."""
    return _passes(rows, False).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, position, role, text, edit: the repaired conversations."""
    return _passes(rows, True).where(F.col("kind") == _TURN).select("conv_id", F.col("seq").alias("position"), "role", "text", "edit")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with one fault in four, chosen by a hash of conversation and turn: a turn is dropped
    (kept as a row with a true `dropped`), emptied, unfinished, repeated or given to the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", fault.alias("fault"), part("role").alias("role"), part("text").alias("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") == 0).alias("dropped"), F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")).drop("copy")
