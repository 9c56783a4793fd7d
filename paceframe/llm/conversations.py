"""Repair of the turn structure of conversations by alignment with an alternating grammar.

A repaired conversation is empty, or an optional system turn followed by pairs of user and
assistant. Rows can be kept, given the role user or assistant, deleted, and empty turns inserted.
The cheapest repair is an alignment (Wagner and Fischer) of the rows with one of the strings of the
grammar. The strings ``ua``, ``uaua``, .. are suffixes of each other, so one table over suffixes has
the costs of all lengths. The cost of a plain repair, the incumbent, bounds deletions and
insertions, so only a band around the diagonal is filled (Ukkonen). Each length with the least cost
is traced back to its least audit, the string of the edits' initials, and the audits are compared.

Texts don't meet in memory. Faults come from digests, alignments from a byte a row, and the repaired
rows are streamed in the order of the conversation behind their audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REROLE, INSERT, DELETE, TRUNCATED = 2, 2, 3, 1
ROLES = {"u": "user", "a": "assistant"}
# Codes of a row: its role's place here, and whether it is truncated; FORCED must be deleted.
INITIALS = "uas"
FORCED = 255
TRUNCATED_BIT = 4
# A table of more numbers is kept in part only and filled again where it is traced back.
CELLS = 1 << 22
# Alignments of short conversations that a task remembers.
REMEMBERED = 50_000
SHORT = 64
FAR = np.int32(1 << 29)

AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Table:
    """Least costs of aligning the rows from ``i`` on with the last ``k`` turns of (user assistant)*.

    A row of the table holds k from ``rows left - most_deletes`` on. ``roles`` has 0 for user, 1 for
    assistant, and others; ``deletes`` what deleting costs beyond the row's own fault.
    """

    def __init__(self, roles: np.ndarray, deletes: np.ndarray, budget: int):
        self.roles, self.deletes, self.n = roles, deletes, len(roles)
        # Without its fault a deletion costs 2 at least, as does an insertion.
        self.most_deletes = min(self.n, budget // 2)
        self.width = self.most_deletes + budget // 2 + 1
        self.step = 1 if (self.n + 1) * self.width <= CELLS else int(np.ceil(np.sqrt(self.n + 1)))
        self.kept: dict[int, np.ndarray] = {}
        self.block: dict[int, np.ndarray] = {}
        row = self._last()
        self.kept[self.n] = row
        for i in range(self.n - 1, -1, -1):
            row = self._before(i, row)
            if i % self.step == 0:
                self.kept[i] = row

    def first_k(self, i: int) -> int:
        return self.n - i - self.most_deletes

    def _last(self) -> np.ndarray:
        k = np.arange(self.width) + self.first_k(self.n)
        return np.where(k < 0, FAR, INSERT * k).astype(np.int32)

    def _before(self, i: int, after: np.ndarray) -> np.ndarray:
        """The row of ``i`` from that of ``i + 1``, which begins one k lower."""
        k = np.arange(self.width) + self.first_k(i)
        deleted = np.append(after[1:], FAR) + self.deletes[i]
        # Before the last k turns an odd k begins with the assistant.
        used = after + np.where(k % 2 == self.roles[i], 0, REROLE)
        best = np.minimum(deleted, np.where(k > 0, used, FAR))
        best[k < 0] = FAR
        spent = INSERT * np.arange(self.width, dtype=np.int32)
        best = np.minimum.accumulate(best - spent) + spent
        best[k < 0] = FAR
        return np.minimum(best, FAR).astype(np.int32)

    def row(self, i: int) -> np.ndarray:
        if i in self.kept:
            return self.kept[i]
        if i not in self.block:
            end = min(self.n, (i // self.step + 1) * self.step)
            self.block, row = {}, self.kept[end]
            for k in range(end - 1, i - i % self.step, -1):
                row = self.block[k] = self._before(k, row)
        return self.block[i]

    def cost(self, i: int, k: int) -> int:
        at = k - self.first_k(i)
        return int(self.row(i)[at]) if 0 <= at < self.width else int(FAR)

    def lengths(self, i: int, least: int) -> tuple[int, list[int]]:
        """The least cost from row ``i`` on over even lengths from ``least``, and those with it."""
        k = np.arange(self.width) + self.first_k(i)
        row = np.where((k >= least) & (k % 2 == 0), self.row(i), FAR)
        best = int(row.min())
        return best, k[row == best].tolist() if best < FAR else []

    def audit(self, i: int, k: int) -> str:
        """The least of the cheapest audits from row ``i`` on with ``k`` turns."""
        out = []
        while i < self.n or k:
            cost = self.cost(i, k)
            if i < self.n and self.cost(i + 1, k) + self.deletes[i] == cost:
                out.append("D")
                i += 1
            elif k and self.cost(i, k - 1) + INSERT == cost:
                out.append("I")
                k -= 1
            else:
                out.append("K" if k % 2 == self.roles[i] else "R")
                i, k = i + 1, k - 1
        return "".join(out)


def _incumbent(roles: list[int]) -> int:
    """Cost of a plain repair beyond the faults: insert what is missing before each row."""
    cost, expected, begun = 0, 0, False
    for role in roles:
        if role == 2 and not begun:
            begun = True
            continue
        if role in (0, 1):
            cost += INSERT * (role != expected)
            expected = 1 - role
        else:
            cost += REROLE
            expected = 1 - expected
        begun = True
    # A system turn on its own needs a pair behind it.
    only = roles[:1] == [2] and len(roles) == 1
    return cost + INSERT * (expected == 1) + 2 * INSERT * only


def align(codes: bytes) -> tuple[int, str]:
    """Least cost and least audit of a conversation, from a code a row."""
    rows = np.frombuffer(codes, dtype=np.uint8)
    free = rows[rows != FORCED]
    truncated = (free & TRUNCATED_BIT) > 0
    kinds = (free & 3).astype(np.int32)
    # Every truncated row costs 1 whatever happens, and so the rest of a deletion is cheaper.
    base = DELETE * (len(rows) - len(free)) + TRUNCATED * int(truncated.sum())
    deletes = (DELETE - TRUNCATED * truncated).astype(np.int32)
    roles = np.where(kinds == 0, 0, np.where(kinds == 1, 1, 2))
    table = Table(roles, deletes, _incumbent(kinds.tolist()))
    # The table deals with all but a system turn, which only stands first.
    best, lengths = table.lengths(0, 0)
    starts = [(0, k) for k in lengths]
    spent = np.cumsum(deletes) - deletes
    for i in np.flatnonzero(kinds == 2).tolist():
        before = int(spent[i])
        if before > best:
            break
        cost, lengths = table.lengths(i + 1, 2)
        if before + cost < best:
            best, starts = before + cost, []
        if before + cost == best:
            starts += [(i + 1, k) for k in lengths]
    audits = []
    for i, k in starts:
        # Behind a system turn: the rows before it are deleted.
        lead = "D" * (i - 1) + "K" if i else ""
        audits.append(lead + table.audit(i, k))
    # Forced deletions stand at the same places in all.
    return base + best, min(_with_forced(a, rows) for a in audits)


def _with_forced(audit: str, rows: np.ndarray) -> str:
    """An audit of the free rows with the deletion of the others, each as early as its place allows."""
    out, at = [], 0
    for edit in audit:
        while at < len(rows) and rows[at] == FORCED:
            out.append("D")
            at += 1
        out.append(edit)
        at += edit != "I"
    return "".join(out) + "D" * (len(rows) - at)


class Conversation:
    """What is known of a conversation while its rows pass in order."""

    def __init__(self) -> None:
        self.codes = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low: int | None = None
        self.high: int | None = None
        self.initial: str | None = None

    def add(self, turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        role = INITIALS.find(initial) if initial else -1
        self.codes.append(FORCED if blank or duplicate else (role if role >= 0 else 3) | TRUNCATED_BIT * truncated)

    def row(self, remembered: dict[bytes, tuple[int, str]]) -> tuple:
        codes = bytes(self.codes)
        found = remembered.get(codes) or align(codes)
        if len(codes) <= SHORT:
            if len(remembered) >= REMEMBERED:
                remembered.clear()
            remembered[codes] = found
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *found


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    remembered: dict[bytes, tuple[int, str]] = {}
    names = ["conv_id", *[part.split(" ")[0] for part in AUDIT.split(", ")]]
    kinds = [pa.int64(), *[pa.int64()] * 6, pa.string()]
    done: list[tuple] = []

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    current: Conversation | None = None
    conv: int | None = None
    for conv_id, *rest in _rows(batches):
        if current is None or conv_id != conv:
            if current is not None:
                done.append((conv, *current.row(remembered)))
            current, conv = Conversation(), conv_id
            if len(done) >= 1000:
                yield block()
                done.clear()
        current.add(*rest)
    if current is not None:
        done.append((conv, *current.row(remembered)))
    if done:
        yield block()


def _with_digests(df: DataFrame) -> DataFrame:
    """Rows with null roles and texts as a blank, and the digest that orders rows of one turn."""
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


# The order of a conversation; Spark sorts nulls first.
ORDER = ["turn", "role", "digest"]


def audits(df: DataFrame) -> DataFrame:
    """One row for each conv_id of ``df`` (conv_id, turn, role, text): faults, and the cheapest repair.

    Rows are taken by turn, null turns first, those of one turn by role and by digest of their text.
    Null roles and texts count as one blank, and null ids as an id. The first fault of a row counts:
    blank (only white space), duplicate (role and text stood before), truncated (the last character
    that isn't white space is none of ``.!?``). ``gaps`` are turns missing between the least and the
    largest, ``illegal`` pairs of neighbours whose roles don't begin with su, ua or au. ``cost`` and
    ``audit`` are as the module says; a repeated row is a duplicate like any other. Other columns are
    ignored, and an empty table gives no rows.

    A conversation's faults are found across tasks. Its alignment needs one task with some bytes a
    row, and time that grows with its rows times its cost.
    """
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1))
    rows = _with_digests(df).select(
        "conv_id", "turn", "role", "digest", (last == "").alias("is_blank"), (~last.isin(".", "!", "?")).alias("is_open")
    )
    same = Window.partitionBy("conv_id", "role", "digest").orderBy("turn")
    flagged = rows.withColumn("seen", F.row_number().over(same) > 1)
    faults = flagged.select(
        "conv_id",
        "turn",
        F.left("role", F.lit(1)).alias("initial"),
        "is_blank",
        (~F.col("is_blank") & F.col("seen")).alias("duplicate"),
        (~F.col("is_blank") & ~F.col("seen") & F.col("is_open")).alias("truncated"),
        "role",
        "digest",
        "seen",
    )
    # Of equal rows in a turn the one that isn't a duplicate comes first.
    ordered = faults.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER, "seen").drop("role", "digest", "seen")
    return ordered.mapInArrow(_audits, f"conv_id long, {AUDIT}")


class Turn(NamedTuple):
    place: int
    edit: str
    turn: int | None
    role: str
    text: str


def _repaired_turns(rows: Iterator[tuple]) -> Iterator[tuple[int | None, Turn | None]]:
    """The turns of repaired conversations, and None where one ends. Of ``rows`` (conv_id, audit, turn,
    role, text) the first of a conversation has its audit."""
    conv: int | None = None
    audit, at, place, k = "", 0, 0, 0
    begun = False

    def inserted() -> Iterator[tuple[int | None, Turn]]:
        nonlocal at, place, k
        while at < len(audit) and audit[at] == "I":
            yield conv, Turn(place, "I", None, ROLES["ua"[k % 2]], "")
            at, place, k = at + 1, place + 1, k - 1

    for conv_id, found, turn, role, text in rows:
        if found is not None:
            if begun:
                yield conv, None
            conv, audit, at, place, begun = conv_id, found, 0, 0, True
            k = len(audit) - audit.count("D")
            yield from inserted()
            continue
        edit = audit[at]
        at += 1
        if edit != "D":
            # An odd number of turns begins with the system's, which is kept as it is.
            yield conv, Turn(place, edit, turn, role if edit == "K" else ROLES["ua"[k % 2]], text)
            place, k = place + 1, k - 1
        yield from inserted()
    if begun:
        yield conv, None


def _with_audits(df: DataFrame, found: DataFrame) -> DataFrame:
    """Rows in the order of their conversations, each led by its audit."""
    rows = _with_digests(df).withColumn("audit", F.lit(None).cast("string"))
    null = F.lit(None)
    heads = found.select(
        "conv_id", null.cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), null.cast("binary").alias("digest"), "audit"
    )
    both = rows.unionByName(heads).withColumn("is_row", F.col("audit").isNull())
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", *ORDER)
    return ordered.select("conv_id", "audit", "turn", "role", "text")


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"conv_id": pa.int64(), "place": pa.int32(), "edit": pa.string(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}
    held: list[tuple] = []
    for conv, turn in _repaired_turns(_rows(batches)):
        if turn is not None:
            held.append((conv, *turn))
        if len(held) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds.values())], names=list(kinds))
            held.clear()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds.values())], names=list(kinds))


def repaired(df: DataFrame, found: DataFrame) -> DataFrame:
    """The turns of the repaired conversations (conv_id, place, edit, turn, role, text), from the rows
    and their :func:`audits`; inserted turns have a null turn and an empty text."""
    return _with_audits(df, found).mapInArrow(_repair, "conv_id long, place int, edit string, turn long, role string, text string")


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, ids, found = hashlib.sha256(), [], []
    for conv, turn in _repaired_turns(_rows(batches)):
        if turn is not None:
            digest.update(f"{chr(10) if turn.place else ''}{turn.role}:{turn.text}".encode())
            continue
        ids.append(conv)
        found.append(digest.hexdigest())
        digest = hashlib.sha256()
        if len(ids) >= 1000:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, pa.int64()), "repaired_sha256": found})
            ids, found = [], []
    if ids:
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, pa.int64()), "repaired_sha256": found})


def repaired_digests(df: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the digest of the turns of :func:`repaired` as ``role:text`` lines."""
    return _with_audits(df, found).mapInArrow(_hash, "conv_id long, repaired_sha256 string")


def damaged(df: DataFrame) -> DataFrame:
    """Rows of conversations with faults by a checksum of their ids; nulls become one blank."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), fault.alias("fault"))
    text: Column = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = rows.where("fault <> 0").withColumns({"text": text, "role": F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))})
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return changed.select("conv_id", "turn", "role", "text", F.explode(times).alias("copy")).drop("copy")
