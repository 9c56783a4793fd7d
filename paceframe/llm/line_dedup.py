"""Removal of repeated lines, nearly equal ones included, by a segment-partition edit join.

A line is removed if an equal line stands earlier in the corpus, in the order of (doc_id, line
number), or, from MIN_CHARS characters on, one within EDITS edits. Lines within that distance
share one of EDITS + 1 even segments: a line is cut into segments, which form an index by length,
number and content, and every line probes it with those substrings that a segment of a line of
each allowed length can have been moved to. Candidates are verified with a bit-parallel edit
distance that keeps only the diagonal band of the matrix that EDITS edits can reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paceframe.llm.shingles import mixed
from paceframe.session import materialise

EDITS = 2
MIN_CHARS = 20
# Characters or substrings of lines that are hashed together.
SUBSTRINGS = 1 << 20
_WHITE = " \t\n\v\f\r"
_LAST = 2**63 - 1

OCCURRENCE = "k1 long, k2 long, doc_id long, line int"
SIGNATURE = "segment long, k1 long, bits int, probe boolean"
# Ids of lines are broadcast up to so many, 16 MB; more are joined by a shuffle.
MAX_BROADCAST = 2_000_000


def compared(text: str | None, min_chars: int = 1) -> Iterator[tuple[int, str]]:
    """The lines of a text that are long enough to be compared, without white space around them."""
    for number, line in enumerate((text or "").split("\n")):
        line = line.strip(_WHITE)
        if len(line) >= min_chars:
            yield number, line


def line_key(line: str) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(line.encode())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def segments(length: int) -> list[tuple[int, int]]:
    """Start and length of each segment of a line; the last ones take the characters left over."""
    base, longer = divmod(length, EDITS + 1)
    out, start = [], 0
    for i in range(EDITS + 1):
        size = base + (i > EDITS - longer)
        out.append((start, size))
        start += size
    return out


def probes(length: int, partner: int) -> Iterator[tuple[int, int, int]]:
    """(segment, start, size) of the substrings with which a line of ``length`` has to probe the
    index of lines of ``partner <= length`` characters.

    Some segment is matched with at most i edits to its left and EDITS - i to its right, and the
    lengths differ by what the edits inserted; both bound how far it can have moved.
    """
    shift = length - partner
    for i, (start, size) in enumerate(segments(partner)):
        low = max(0, start - i, start + shift - (EDITS - i))
        high = min(length - size, start + i, start + shift + (EDITS - i))
        for at in range(low, high + 1):
            yield i, at, size


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


class Plan(NamedTuple):
    """The substrings that lines of a length look up: seed, start, end, and whether it only probes."""

    seeds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    probe: np.ndarray


@lru_cache(maxsize=4096)
def _plan(n: int) -> Plan:
    own = [(n * (EDITS + 1) + i, start, start + size) for i, (start, size) in enumerate(segments(n))]
    # Its own segments in their own places are found among the index entries.
    others = {
        (partner * (EDITS + 1) + i, at, at + size)
        for partner in range(max(MIN_CHARS, n - EDITS), n + 1)
        for i, at, size in probes(n, partner)
    } - set(own)
    seeds, starts, ends = (np.array(c) for c in zip(*own, *sorted(others)))
    return Plan(mixed(seeds.astype(np.uint64) * _FACTOR), starts, ends, np.arange(len(seeds)) >= len(own))


def signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lines of one length: keys of their substrings (a row a line), which of the columns only
    probe, and the parities of the characters.

    A substring's key comes from the running sums of a polynomial. Keys that are equal by accident
    make a candidate more, no link: those are verified on the texts.
    """
    n = len(lines[0])
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), dtype="<u4").reshape(len(lines), n)
    plan = _plan(n)
    total = np.zeros((len(lines), n + 1), dtype=np.uint64)
    np.cumsum(mixed(codes.astype(np.uint64)) * np.cumprod(np.full(n, _FACTOR)), axis=1, out=total[:, 1:])
    inverse = np.cumprod(np.append(np.uint64(1), np.full(n, _INVERSE)))
    sums = (total[:, plan.ends] - total[:, plan.starts]) * inverse[plan.starts]
    return mixed(sums + plan.seeds).view(np.int64), plan.probe, character_bits(codes)


def character_bits(codes: np.ndarray) -> np.ndarray:
    """32 parities of the characters of lines (a row each); an edit changes two of them at most."""
    classes = codes.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(15) & np.uint64(31)
    return np.bitwise_xor.reduce(np.uint32(1) << classes.astype(np.uint32), axis=1).view(np.int32)


def near_parities(a: str, b: str) -> Column:
    """Whether so few parities differ that EDITS edits can explain them."""
    # bit_count widens an int with its sign, which would count parity 31 another 32 times.
    differ = F.col(a).bitwiseXOR(F.col(b)).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.bit_count(differ) <= 2 * EDITS


def within_edits(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether the edit distance is at most ``edits``.

    Bit k of a column's words stands for the row ``column - edits + k``: the band slides down with
    the columns, and one addition carries a change through all its cells.
    """
    if a == b:
        return True
    if abs(len(a) - len(b)) > edits:
        return False
    if len(a) > len(b):
        a, b = b, a
    first = _common(a, b)
    a, b = a[first:], b[first:]
    last = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - last], b[: len(b) - last]
    if not a:
        return len(b) <= edits
    places: dict[str, int] = {}
    for row, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << row
    width = 2 * edits + 1
    full = (1 << width) - 1
    # The difference of each cell to the one above it, +1 or -1; before the first column it is
    # +1 in the rows from 1 on.
    plus, minus = full & ~((1 << edits + 1) - 1), 0
    distance = 0
    for column, c in enumerate(b, 1):
        plus, minus = plus >> 1 | 1 << width - 1, minus >> 1
        offset = column - edits - 1
        match = places.get(c, 0)
        match = (match << -offset if offset < 0 else match >> offset) & full
        unchanged = (((match & plus) + plus) ^ plus | match | minus) & full  # along the diagonal
        rise = (minus | ~(unchanged | plus)) & full  # from the column before
        fall = unchanged & plus
        if column <= len(a):
            distance += not unchanged >> edits & 1
        else:  # the last row, which now moves up in the band
            place = edits - (column - len(a))
            distance += (rise >> place & 1) - (fall >> place & 1)
        above = (rise << 1 | 1) & full
        plus = (fall << 1 | ~(unchanged | above)) & full
        minus = above & unchanged
    return distance <= edits


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _occurrences(min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*line_key(line), doc_id, number) for doc_id, text in zip(batch["doc_id"], batch["text"]) for number, line in compared(text, min_chars)]
            yield pd.DataFrame(rows, columns=["k1", "k2", "doc_id", "line"]).astype({"k1": "int64", "k2": "int64", "doc_id": "int64", "line": "int32"})

    return run


def _different_lines(batch: pd.DataFrame) -> dict[tuple[int, int], str]:
    return {line_key(line): line for line in {line for text in batch["text"] for _, line in compared(text, MIN_CHARS)}}


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        by_length: dict[int, list[tuple[int, str]]] = {}
        for (k1, _), line in _different_lines(batch).items():
            by_length.setdefault(len(line), []).append((k1, line))
        for length, found in by_length.items():
            # So many lines at a time that their substrings stay a few megabytes.
            step = max(1, SUBSTRINGS // max(length, len(_plan(length).seeds)))
            for at in range(0, len(found), step):
                ids, lines = zip(*found[at : at + step])
                keys, probe, bits = signatures(list(lines))
                yield pd.DataFrame(
                    {
                        "segment": keys.ravel(),
                        "k1": np.repeat(np.array(ids, dtype=np.int64), len(probe)),
                        "bits": np.repeat(bits, len(probe)),
                        "probe": np.tile(probe, len(lines)),
                    }
                )


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(k1, k2, line) for (k1, k2), line in _different_lines(batch).items()]
        yield pd.DataFrame(rows, columns=["k1", "k2", "text"]).astype({"k1": "int64", "k2": "int64"})


def shared_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by (segment, k1, probe) the different ones whose segment others have too."""
    last: pd.DataFrame | None = None
    met = False  # whether the last row shares its segment with the one before it
    for batch in batches:
        rows = batch if last is None else pd.concat([last, batch], ignore_index=True)
        rows = rows[~rows.duplicated().to_numpy()].reset_index(drop=True)
        if not len(rows):
            continue
        same = rows["segment"].to_numpy()[1:] == rows["segment"].to_numpy()[:-1]
        before = np.append(met, same)
        kept = before | np.append(same, False)
        yield rows[:-1][kept[:-1]]
        last, met = rows[-1:], bool(before[-1])
    if last is not None and met:
        yield last


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        near = [within_edits(a, b) for a, b in zip(batch["text_a"], batch["text_b"])]
        yield batch.loc[near, ["a1", "a2", "b1", "b2"]]


def line_links(docs: DataFrame, parts: int) -> DataFrame:
    """Pairs (a1, a2, b1, b2) of keys of different lines within EDITS edits, each pair once."""
    found = docs.mapInPandas(_signatures, SIGNATURE).repartition(parts, "segment").sortWithinPartitions("segment", "k1", "probe")
    shared = materialise(found.mapInPandas(shared_segments, SIGNATURE), "segments")
    x = shared.where("not probe").select("segment", F.col("k1").alias("a1"), F.col("bits").alias("bits_a"))
    y = shared.select("segment", F.col("k1").alias("b1"), F.col("bits").alias("bits_b"), "probe")
    different = (F.col("a1") < F.col("b1")) | (F.col("probe") & (F.col("a1") != F.col("b1")))
    pairs = x.join(y, "segment").where(different & near_parities("bits_a", "bits_b"))
    pairs = materialise(pairs.select(F.least("a1", "b1").alias("a1"), F.greatest("a1", "b1").alias("b1")).distinct(), "pairs")
    wanted = materialise(pairs.select(F.col("a1").alias("k1")).unionByName(pairs.select(F.col("b1").alias("k1"))).distinct(), "wanted")
    lines = docs.mapInPandas(_lines, "k1 long, k2 long, text string")
    if wanted.count() <= MAX_BROADCAST:
        wanted = F.broadcast(wanted)
    texts = lines.join(wanted, "k1", "left_semi").dropDuplicates(["k1", "k2"])
    texts = materialise(texts, "lines", compression="zstd")
    a = texts.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("text").alias("text_a"))
    b = texts.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("text").alias("text_b"))
    return pairs.join(a, "a1").join(b, "b1").mapInPandas(_verified, "a1 long, a2 long, b1 long, b2 long")


def repeated_lines(df: DataFrame, parts: int | None = None, exact_chars: int = 1) -> DataFrame:
    """One row per removed line: doc_id, line, k1 (of its text), of_doc, of_line, exact.

    ``of_doc`` and ``of_line`` are the earliest line that is equal (``exact``) or, for lines of
    MIN_CHARS characters or more, within EDITS edits. Equal lines are found from ``exact_chars``
    characters on. A null id counts as the largest.
    """
    if not 1 <= exact_chars <= MIN_CHARS:
        raise ValueError(f"exact_chars must lie between 1 and {MIN_CHARS}")
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), "text")
    occurrences = materialise(docs.mapInPandas(_occurrences(exact_chars), OCCURRENCE), "occurrences")
    firsts = occurrences.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line")).alias("first"))
    firsts = materialise(firsts, "firsts")
    links = materialise(line_links(docs, parts), "links")

    def of(side: str) -> DataFrame:
        return firsts.select(F.col("k1").alias(f"{side}1"), F.col("k2").alias(f"{side}2"), F.col("first").alias(f"first_{side}"))

    met = links.join(of("a"), ["a1", "a2"]).join(of("b"), ["b1", "b2"])
    later = F.col("first_a") > F.col("first_b")
    near = met.select(
        F.when(later, F.col("a1")).otherwise(F.col("b1")).alias("k1"),
        F.when(later, F.col("a2")).otherwise(F.col("b2")).alias("k2"),
        F.least("first_a", "first_b").alias("earlier"),
    ).groupBy("k1", "k2").agg(F.min("earlier").alias("near"))
    own = F.struct("doc_id", "line")
    rows = occurrences.join(firsts.join(near, ["k1", "k2"], "left"), ["k1", "k2"])
    removed = rows.where((own != F.col("first")) | F.col("near").isNotNull())
    of_line = F.least("near", F.when(own != F.col("first"), F.col("first")))
    return removed.select("doc_id", "line", "k1", of_line["doc_id"].alias("of_doc"), of_line["line"].alias("of_line"), (of_line == F.col("first")).alias("exact"))


def _without_lines(min_chars: int):
    @F.pandas_udf(StringType())
    def run(text: pd.Series, lines: pd.Series, keys: pd.Series) -> pd.Series:
        def rest(t: str | None, numbers, own) -> str | None:
            if t is None or numbers is None:
                return t
            # Rows may share an id: a line goes only if it is the text that was found there.
            gone = set(zip(numbers, own))
            dropped = {n for n, line in compared(t, min_chars) if (n, line_key(line)[0]) in gone}
            return "\n".join(line for n, line in enumerate(t.split("\n")) if n not in dropped)

        return pd.Series([rest(*row) for row in zip(text, lines, keys)], dtype=object)

    return run


def dedup_lines(df: DataFrame, parts: int | None = None, report: str = "removed_lines", exact_chars: int = 1) -> DataFrame:
    """The rows of ``df`` with their repeated lines taken out of ``text``, and the column
    ``report``, which replaces one of that name: (line, of_doc, of_line, exact) of each, in order.

    Lines are compared without the white space around them, those of MIN_CHARS characters or more
    with EDITS edits, shorter ones for equality; with ``exact_chars`` over 1 the shortest ones stay.
    Lines that are empty but for white space always stay. Null texts stay null; no row is dropped, also where no line is left.
    Rows that share an id count as one document, within which a line at the same place is one
    line. All other columns pass unchanged, whatever their names.
    """
    found = repeated_lines(df, parts, exact_chars)
    entry = F.struct("line", "k1", F.nullif("of_doc", F.lit(_LAST)).alias("of_doc"), "of_line", "exact")
    by_doc = found.distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("gone"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    joined = df.select(row.alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id")).join(by_doc, "doc_id", "left")
    text = _without_lines(exact_chars)(F.col("row.text"), F.col("gone.line"), F.col("gone.k1"))
    removed = F.transform(F.coalesce("gone", F.array().cast(by_doc.schema["gone"].dataType)), lambda g: F.struct(g["line"].alias("line"), g["of_doc"].alias("of_doc"), g["of_line"].alias("of_line"), g["exact"].alias("exact")))
    columns = [text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in df.columns if c != report]
    return joined.select(*columns, removed.alias(report))
