"""Conversation structure repair: a secondary-sorted stream with dynamic programming.

Rows are dealt out by conversation and sorted by turn, so a task reads each conversation
once, in order, across Arrow batches. Four states follow the role initials read so far:
nothing, s, u, a. Per state the stream carries the least cost and the rank of its audit
among the states' audits; each row adds four bytes of backpointers, which go to a temporary
file of the task once they exceed SPOOL bytes. At the end of a conversation they are read
backwards, block by block. So memory is bounded whatever a conversation's length, but for
the audit itself. Texts are not read for this: the sort carries their 128-bit hashes.

A second stream puts each conversation's audit in front of its rows and applies it.

Edits: K keeps a row (0), R gives it the role user or assistant (3), D deletes it (4), I
inserts an empty turn (3); a truncated row that stays costs 3 more. Blank rows (no
character but \\x20 and \\x09-\\x0D) and repeats of an earlier (role, text) must go. The roles'
initials must become `(s?(ua)+)?`. Among the cheapest edits the least audit in ASCII wins.
Inserts are only tried before kept and re-roled rows and at the end: before a deleted row,
moving the D forward gives the same turns and a smaller audit.

Nulls in role and text are read as one space. Rows without a turn come first; rows of one
turn are ordered by role, then by the text's hash. Rows without a conv_id are one
conversation. Repeated rows are duplicates. An empty table gives an empty one. Further
columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import ship, staged

_SPACES = " \t\n\x0b\x0c\r"
#: Backpointers of a conversation that stay in memory, in bytes.
SPOOL = 1 << 20
#: Bytes read back at once.
BLOCK = 1 << 18
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States by the last role's initial; the first is the start.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
LETTERS = "DKR"


def _reached(state: int, role: int) -> bool:
    """Whether a turn of `role` (a state) may follow `state`."""
    if role == SYSTEM:
        return state == START
    return (state == USER) == (role == ASSISTANT)


def _inserted(state: int, n: int) -> int:
    """The state after n inserted turns; there is one choice for each."""
    for _ in range(n):
        state = ASSISTANT if state == USER else USER
    return state


@lru_cache(maxsize=4096)
def steps(initial: str, fault: str) -> list[tuple[int, int, int, str, int]]:
    """(state before, state after, cost, letters, backpointer) of every way to take a row."""
    role = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(initial)
    out = []
    for state in range(STATES):
        out.append((state, state, DELETE, "D", state))
        if fault in ("blank", "duplicate"):
            continue
        extra = CUT if fault == "truncated" else 0
        for n in range(2):
            mid = _inserted(state, n)
            ways = [(role, KEEP, "K")] if role is not None else []
            ways += [(r, REROLE, "R") for r in (USER, ASSISTANT) if r != role]
            for target, cost, letter in ways:
                if _reached(mid, target):
                    code = state | n << 2 | LETTERS.index(letter) << 4
                    out.append((state, target, n * INSERT + cost + extra, "I" * n + letter, code))
    return out


class Audit:
    """The cheapest edits of one conversation, row by row."""

    def __init__(self) -> None:
        self.cost: list[int | None] = [0, None, None, None]
        self.rank = [0] * STATES
        self.rows = 0
        self.back = tempfile.SpooledTemporaryFile(max_size=SPOOL)

    def add(self, initial: str, fault: str) -> None:
        best: list[tuple | None] = [None] * STATES
        for before, after, cost, letters, code in steps(initial, fault):
            had = self.cost[before]
            if had is not None:
                key = (had + cost, self.rank[before], letters, code)
                if best[after] is None or key < best[after]:
                    best[after] = key
        # Audits up to a row end in a letter that takes it, so none begins another.
        order = sorted((k[1], k[2], s) for s, k in enumerate(best) if k is not None)
        for place, (_, _, s) in enumerate(order):
            self.rank[s] = place
        self.cost = [None if k is None else k[0] for k in best]
        self.back.write(bytes(0 if k is None else k[3] for k in best))
        self.rows += 1

    def finish(self) -> tuple[int, str]:
        """Cost and audit; closes the spilled backpointers."""
        ends = []
        for state, more in ((START, 0), (ASSISTANT, 0), (USER, 1), (SYSTEM, 2)):
            if self.cost[state] is not None:
                ends.append((self.cost[state] + more * INSERT, self.rank[state], more, state))
        cost, _, more, state = min(ends)
        letters = bytearray(b"I" * more)
        end = self.rows * STATES
        while end:
            start = max(0, end - BLOCK)
            self.back.seek(start)
            block = self.back.read(end - start)
            for at in range(len(block) - STATES, -1, -STATES):
                code = block[at + state]
                letters += LETTERS[code >> 4].encode() + b"I" * (code >> 2 & 3)
                state = code & 3
            end = start
        self.back.close()
        letters.reverse()
        return cost, letters.decode()


class _Conversation:
    """What the first stream carries of the conversation it reads."""

    def __init__(self, conv) -> None:
        self.conv, self.edits = conv, Audit()
        self.first = self.last = self.prior = None
        self.turns = self.illegal = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None:
            if self.first is None:
                self.first = turn
            self.turns += turn != self.last
            self.last = turn
        if self.prior is not None and self.prior + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.prior = initial
        if fault:
            self.faults[fault] += 1
        self.edits.add(initial, fault)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        cost, letters = self.edits.finish()
        return (self.conv, gaps, *self.faults.values(), self.illegal, cost, letters)


def _prepared(turns: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    """conv_id, turn, role, text, here: nulls read as one space."""
    here = F.lit(True) if present is None else F.coalesce(F.col(f"`{present}`"), F.lit(False))
    return turns.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
        here.alias("here"),
    )


def _hashes() -> list[Column]:
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def _stream(rows: DataFrame, before: list[str], schema: T.StructType, fn) -> DataFrame:
    """One task a conversation, its rows in order, `fn` over all batches of the task.

    A row may hold a whole text, so ship() bounds the rows of a batch."""
    ship(rows.sparkSession)
    return rows.sortWithinPartitions("conv_id", *before, F.asc_nulls_first("turn"), "role", "h1", "h2").mapInArrow(fn, schema)


def _long(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def audits(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None,
) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows where the boolean column `present` is not true only name their conversation.
    """
    rows = _prepared(turns, conv, turn, role, text, present)
    end = F.substring(F.rtrim("text", F.lit(_SPACES)), -1, 1)
    fault = F.when(end == "", "blank").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    narrow = rows.select("conv_id", "turn", "role", *_hashes(), fault.alias("fault"), "here").repartition("conv_id")
    # The window's keys begin with the key of the deal, so it sorts without another shuffle.
    first = narrow.select(
        "*", F.expr("row_number() OVER (PARTITION BY conv_id, here, role, h1, h2 ORDER BY turn ASC NULLS FIRST)").alias("seen")
    )
    marked = first.select(
        "conv_id", "turn", "role", "h1", "h2", "here",
        F.when((F.col("fault") != "blank") & (F.col("seen") > 1), "duplicate").otherwise(F.col("fault")).alias("fault"),
    )
    given = rows.schema["conv_id"]
    schema = T.StructType([given, *_long("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), T.StructField("audit", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = None, None
        types = [pa.int64()] * 6 + [pa.string()]
        for batch in batches:
            done, kind = [], batch.schema.field("conv_id").type
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "here", "fault"))
            for c, t, r, here, f in zip(*columns):
                if now is None or c != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(c)
                if here:
                    now.add(t, r[:1], f)
            yield _batch(done, schema.names, [kind, *types])
        if now is not None:
            yield _batch([now.row()], schema.names, [kind, *types])

    return _stream(marked, [], schema, run)


class _Repair:
    """Applies an audit to the rows that follow it."""

    def __init__(self, conv, audit: str) -> None:
        self.conv, self.audit, self.at, self.place, self.state = conv, audit, 0, 0, START

    def _out(self, turn, role, text, edit) -> tuple:
        self.place += 1
        self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
        return (self.conv, self.place - 1, turn, role, text, edit)

    def _next(self) -> str:
        return "assistant" if self.state == USER else "user"

    def inserts(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._out(None, self._next(), "", "I")

    def take(self, turn, role, text) -> Iterator[tuple]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._out(turn, role if edit == "K" else self._next(), text, edit)


def repaired(
    turns: DataFrame, found: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None,
) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), turn (null if inserted), role, text, edit.

    `found` is what audits() returned for the same table. Within a task, rows come in order
    of conversation and place.
    """
    rows = _prepared(turns, conv, turn, role, text, present).where("here")
    body = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", *_hashes(), "text")
    none = F.lit(0).cast("long")
    heads = found.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), none.alias("h1"), none.alias("h2"),
        F.col("audit").alias("text"),
    )
    given = rows.schema["conv_id"]
    schema = T.StructType([
        given, *_long("place", "turn"), *[T.StructField(n, T.StringType()) for n in ("role", "text", "edit")],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kinds = None, None
        for batch in batches:
            out = []
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text"))
            for c, kind, t, r, x in zip(*columns):
                if kind == 0:
                    if now is not None:
                        out += now.inserts()
                    now = _Repair(c, x)
                else:
                    out += now.take(t, r, x)
            yield _batch(out, schema.names, kinds)
        if now is not None:
            yield _batch(list(now.inserts()), schema.names, kinds)

    return _stream(heads.unionByName(body).repartition("conv_id"), ["kind"], schema, run)


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of repaired()'s rows: `role:text`, joined by newlines.

    Reads the stream as it comes, so call it on repaired()'s result itself."""
    import hashlib

    given = rows.schema["conv_id"]
    schema = T.StructType([given, T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, conv, digest, kind = False, None, None, None
        for batch in batches:
            out, kind = [], batch.schema.field("conv_id").type
            for c, place, r, x in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if open_:
                        out.append((conv, digest.hexdigest()))
                    open_, conv, digest = True, c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{r}:{x}".encode())
            yield _batch(out, schema.names, [kind, pa.string()])
        if open_:
            yield _batch([(conv, digest.hexdigest())], schema.names, [kind, pa.string()])

    return rows.select("conv_id", "place", "role", "text").mapInArrow(run, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """Faults planted by crc32(`conv_id:turn`) % 20, a null as one space: 0 drops a row, which
    stays with `present` false, 1 empties its text, 2 removes its `.!?`, 3 repeats it, 4 sets
    its role to user."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat_ws(":", word("conv_id"), word("turn")).cast("binary")) % 20).alias("kind")
    rows = turns.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("kind") != 0).alias("present"), F.explode(times).alias("copy"),
    ).drop("copy")


def structure(turns: DataFrame, present: str | None = None) -> DataFrame:
    """audits() with the digest of each conversation's repaired turns."""
    found = staged(audits(turns, present=present), "audits")
    made = digests(repaired(turns, found, present=present)).withColumnRenamed("conv_id", "__conv")
    empty = F.lit("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")
    return found.join(made, found["conv_id"].eqNullSafe(made["__conv"]), "left").drop("__conv").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", empty)
    )
