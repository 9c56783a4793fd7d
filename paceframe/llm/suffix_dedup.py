"""Removal of every byte that lies in a string of WINDOW bytes that starts elsewhere too.

Each window has an anchor, the first of its runs of ANCHOR bytes with the least hash. Consecutive
windows with the same anchor form a stretch; equal windows have equal anchors at the same place,
so stretches are dealt out by the hash of their anchor. Stretches that are equal as a whole are
repeated as a whole. Where different stretches share an anchor, their texts are brought together
and their suffixes sorted: a merge sort compares two suffixes by a binary search for their common
beginning on polynomial prefix hashes, and what neighbours have in common is compared byte by byte
before it counts. An anchor with very many different stretches is split into single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceframe.llm.shingles import mixed
from paceframe.session import materialise

WINDOW = 200
ANCHOR = 32
# Anchors with more different stretches than this are split into windows; at most MAX_SPLIT are.
STRETCHES = 5_000
MAX_SPLIT = 10_000
# Texts hashed together, and texts sorted together, in bytes.
CHUNK_BYTES = 1 << 19
SORT_BYTES = 1 << 20

STRETCH = "anchor long, h1 long, h2 long, row long, start int, windows int"
SHARED = STRETCH + ", whole boolean, open boolean"
SPAN = "row long, first int, last int"
PACKED = "doc_id string, packed binary, n_bytes long, k1 long, k2 long"

_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Prefixes:
    """Polynomial hashes of all substrings of a buffer, modulo 2 ** 64."""

    def __init__(self, buffer: np.ndarray, factor: int):
        powers = np.cumprod(np.full(len(buffer) + 1, np.uint64(factor)))
        self.inverse = np.cumprod(np.full(len(buffer) + 1, np.uint64(pow(factor, -1, 2**64))))
        values = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(factor))
        self.total = np.zeros(len(buffer) + 1, dtype=np.uint64)
        np.cumsum(values[buffer] * powers[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.inverse[start])


def _anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least hash and its first place among the runs of each window."""
    value, place = hashes, np.arange(len(hashes))

    def merged(step: int) -> tuple[np.ndarray, np.ndarray]:
        later = value[step:] < value[:-step]
        return np.where(later, value[step:], value[:-step]), np.where(later, place[step:], place[:-step])

    runs, width = WINDOW - ANCHOR + 1, 1
    while 2 * width <= runs:
        value, place = merged(width)
        width *= 2
    if width < runs:
        value, place = merged(runs - width)
    return value, place


def stretches_of(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the text, rows of (anchor, h1, h2, start, windows)) of texts long enough."""
    chunk: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if len(text) >= WINDOW:
            chunk.append(i)
            size += len(text)
        if chunk and (size >= CHUNK_BYTES or i == len(texts) - 1):
            yield from _stretches(texts, chunk)
            chunk, size = [], 0


def _stretches(texts: list[bytes], chunk: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    buffer = np.frombuffer(b"".join([texts[i] for i in chunk]), dtype=np.uint8)
    ends = np.cumsum([len(texts[i]) for i in chunk])
    first, second = Prefixes(buffer, _FACTORS[0]), Prefixes(buffer, _FACTORS[1])
    runs = np.arange(len(buffer) - ANCHOR + 1)
    value, place = _anchors(first.of(runs, runs + ANCHOR))
    start = np.arange(len(value))
    text = np.searchsorted(ends, start, side="right")
    inside = start + WINDOW <= ends[text]
    new = inside.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    begins = np.flatnonzero(new)
    # A stretch ends before the next one or before the first window that leaves the text.
    limits = np.minimum(np.append(begins[1:], len(value)), ends[text[begins]] - WINDOW + 1)
    stops = limits - 1 + WINDOW
    offsets = ends - np.array([len(texts[i]) for i in chunk])
    table = np.stack(
        [
            value[begins].view(np.int64),
            first.of(begins, stops).view(np.int64),
            second.of(begins, stops).view(np.int64),
            begins - offsets[text[begins]],
            limits - begins,
        ],
        axis=1,
    )
    bounds = np.searchsorted(text[begins], np.arange(len(chunk) + 1))
    for k, i in enumerate(chunk):
        yield i, table[bounds[k] : bounds[k + 1]]


def _unpacked(batch: pd.DataFrame) -> list[bytes]:
    unpacker = zstandard.ZstdDecompressor()
    return [unpacker.decompress(p) for p in batch["packed"]]


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [(t or "").encode() for t in batch["text"]]
        digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(t), dtype=np.int64) for t in texts]).reshape(-1, 2)
        packed = [packer.compress(t) for t in texts]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "packed": packed, "n_bytes": [len(t) for t in texts], "k1": digests[:, 0], "k2": digests[:, 1]})


def _all_stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The stretches of each different text of a batch. Its copies need none: as a text that
    occurs twice they are repeated from end to end."""
    for batch in batches:
        batch = batch[~batch.duplicated(["k1", "k2"])]
        rows = batch["row"].to_numpy()
        found = [(rows[i], table) for i, table in stretches_of(_unpacked(batch))]
        if found:
            table = np.concatenate([t for _, t in found])
            out = pd.DataFrame(table, columns=["anchor", "h1", "h2", "start", "windows"])
            out.insert(3, "row", np.repeat([r for r, _ in found], [len(t) for _, t in found]))
            yield out.astype({"start": "int32", "windows": "int32"})


def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of stretches sorted by (anchor, h1, h2) those that matter.

    ``whole``: an equal stretch exists, so all its windows are repeated. ``open``: the first of
    its kind, while the anchor has other kinds; its text may share windows with theirs. Only the
    row before and the first kind of the anchor are held.
    """
    columns = [c.split()[0] for c in SHARED.split(", ")]
    last: list | None = None  # the row before, whose flags may still change
    first: list | None = None  # the first of the anchor's first kind while no other is known
    several = False
    for batch in batches:
        out: list[list] = []
        for row in zip(*[batch[c].tolist() for c in columns[:6]]):
            row = [*row, False, False]
            if last is not None and row[0] == last[0]:
                if row[1:3] == last[1:3]:
                    row[6] = last[6] = True
                    if first is not None and first[1:3] == row[1:3]:
                        first[6] = True
                else:
                    row[7] = True
                    if not several:
                        several = True
                        first[7] = True
            else:
                if first is not None and (first[6] or first[7]):
                    out.append(first)
                first, several = None, False
            if last is not None and last is not first and (last[6] or last[7]):
                out.append(last)
            if first is None:
                first = row
            last = row
        if out:
            yield pd.DataFrame(out, columns=columns)
    out = [row for row in ([first, last] if first is not last else [first]) if row is not None and (row[6] or row[7])]
    if out:
        yield pd.DataFrame(out, columns=columns)


def common_lengths(prefixes: Prefixes, limit: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common beginning of the suffixes at i and j, which end at ``limit`` of each."""
    low = np.zeros(len(i), dtype=np.int64)
    high = np.minimum(limit[i] - i, limit[j] - j)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = prefixes.of(i, i + middle) == prefixes.of(j, j + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def sort_suffixes(buffer: np.ndarray, prefixes: Prefixes, limit: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The starts in the order of their suffixes, equal suffixes in the order of their places.

    A merge sort from below. All pairs of runs of a level are merged at once: the place of each
    element in the other run is searched by halving.
    """

    def before(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = common_lengths(prefixes, limit, i, j)
        ends_i, ends_j = i + n == limit[i], j + n == limit[j]
        last = len(buffer) - 1
        smaller = buffer[np.minimum(i + n, last)] < buffer[np.minimum(j + n, last)]
        return np.where(ends_i & ends_j, i < j, np.where(ends_i, True, np.where(ends_j, False, smaller)))

    order = np.sort(starts)
    n, width = len(order), 1
    index = np.arange(n)
    while width < n:
        pair = index // (2 * width) * 2 * width
        left = index < pair + width
        other = np.where(left, np.minimum(pair + width, n), pair)
        size = np.where(left, np.minimum(pair + 2 * width, n) - other, width)
        low, high = np.zeros(n, dtype=np.int64), size
        while (low < high).any():
            active = low < high
            middle = (low + high) // 2
            smaller = np.zeros(n, dtype=bool)
            smaller[active] = before(order[(other + middle)[active]], order[active])
            low, high = np.where(active & smaller, middle + 1, low), np.where(active & ~smaller, middle, high)
        merged = np.empty_like(order)
        merged[pair + (index - np.where(left, pair, pair + width)) + low] = order
        order, width = merged, 2 * width
    return order


def repeated_windows(texts: list[bytes], known: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each text the runs (first window, number) of windows that another place has too.

    Texts that are ``known`` to be repeated only serve as partners. Windows whose hash is single
    are single. Of the others, the first of every run of windows and a partner of it are sorted
    as suffixes; what a suffix has in common with its neighbours settles the windows it covers,
    and the rest goes into another round.
    """
    buffer = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    limit = np.append(np.repeat(ends, [len(t) for t in texts]), len(buffer))
    prefixes = Prefixes(buffer, _FACTORS[0])
    start = np.arange(max(0, len(buffer) - WINDOW + 1))
    start = start[start + WINDOW <= limit[start]]
    hashes = prefixes.of(start, start + WINDOW)
    ranked = np.argsort(hashes, kind="stable")
    same = hashes[ranked[1:]] == hashes[ranked[:-1]]
    partner = np.full(len(buffer) + 1, -1, dtype=np.int64)
    partner[start[ranked[1:][same]]] = start[ranked[:-1][same]]
    first = ~np.append(False, same) & np.append(same, False)
    partner[start[ranked[first]]] = start[ranked[np.flatnonzero(first) + 1]]
    waiting = partner >= 0
    text_of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    waiting[:-1] &= ~known[text_of]
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    data = buffer.tobytes()
    while waiting.any():
        places = np.flatnonzero(waiting)
        begins = places[np.append(True, (places[1:] != places[:-1] + 1) | (text_of[places[1:]] != text_of[places[:-1]]))]
        order = sort_suffixes(buffer, prefixes, limit, np.unique(np.concatenate([begins, partner[begins]])))
        shared = common_lengths(prefixes, limit, order[:-1], order[1:])
        best: dict[int, tuple[int, int]] = {}
        for i, j, n in zip(order[:-1].tolist(), order[1:].tolist(), shared.tolist()):
            if n >= WINDOW:
                best[i] = max(best.get(i, (0, 0)), (n, j))
                best[j] = max(best.get(j, (0, 0)), (n, i))
        for i in begins.tolist():
            n, j = best.get(i, (0, -1))
            while n >= WINDOW and data[i : i + n] != data[j : j + n]:
                n -= 1  # hashes met by chance
            if n < WINDOW:
                # The partner was another string with the same hash: compare with all that have it.
                h = prefixes.of(np.array([i]), np.array([i + WINDOW]))[0]
                n = WINDOW * any(data[k : k + WINDOW] == data[i : i + WINDOW] for k in start[hashes == h].tolist() if k != i)
            covered = max(1, n - WINDOW + 1)
            if n:
                found[text_of[i]].append((i - int(ends[text_of[i]] - len(texts[text_of[i]])), covered))
            waiting[i : i + covered] = False
    return found


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The texts of the open stretches of each document."""
    for batch in batches:
        rows = []
        for row, text, wanted in zip(batch["row"], _unpacked(batch), batch["wanted"]):
            for w in wanted:
                rows.append((w["anchor"], row, w["start"], w["whole"], text[w["start"] : w["start"] + w["windows"] + WINDOW - 1]))
        yield pd.DataFrame(rows, columns=["anchor", "row", "start", "whole", "body"])


CUT_OUT = "anchor long, row long, start int, whole boolean, body binary"


def _sorted_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of repeated windows in stretches sorted by anchor; whole groups are sorted together."""
    held: list[tuple] = []
    size = 0

    def spans() -> pd.DataFrame:
        found = repeated_windows([bytes(r[4]) for r in held], np.array([r[3] for r in held], dtype=bool))
        rows = [(r[1], r[2] + at, r[2] + at + n + WINDOW - 1) for r, runs in zip(held, found) for at, n in runs]
        return pd.DataFrame(rows, columns=["row", "first", "last"]).astype({"row": "int64", "first": "int32", "last": "int32"})

    for batch in batches:
        for row in zip(batch["anchor"], batch["row"], batch["start"], batch["whole"], batch["body"]):
            if size >= SORT_BYTES and row[0] != held[-1][0]:
                yield spans()
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield spans()


def _single_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row, start, body in zip(batch["row"], batch["start"], batch["body"]):
            buffer = np.frombuffer(body, dtype=np.uint8)
            at = np.arange(len(buffer) - WINDOW + 1)
            h1, h2 = (Prefixes(buffer, f).of(at, at + WINDOW).view(np.int64) for f in _FACTORS)
            yield pd.DataFrame({"h1": h1, "h2": h2, "row": row, "first": (at + start).astype(np.int32)})


def _rests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch["doc_id"], _unpacked(batch), batch["spans"]):
            merged: list[list[int]] = []
            for span in sorted((s["first"], s["last"]) for s in (spans if spans is not None else ())):
                if merged and span[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], span[1])
                else:
                    merged.append(list(span))
            edges = [0, *[e for span in merged for e in span], len(text)]
            rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append((doc_id, len(text), len(text) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "rest"])


def repeated_spans(docs: DataFrame, parts: int) -> DataFrame:
    """(row, first, last): byte spans of repeated windows; those of a document may overlap.

    ``docs`` has different numbers ``row``, texts ``packed`` with their length ``n_bytes``, and
    128 bits of a digest of them, ``k1`` and ``k2``.
    """
    twice = docs.where(F.col("n_bytes") >= WINDOW).groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1")
    copied = docs.select("row", "n_bytes", "k1", "k2").join(twice, ["k1", "k2"])
    copied = copied.select("row", F.lit(0).alias("first"), F.col("n_bytes").cast("int").alias("last"))
    dealt = docs.select("row", "packed", "k1", "k2").mapInPandas(_all_stretches, STRETCH).repartition(parts, "anchor").sortWithinPartitions("anchor", "h1", "h2")
    shared = materialise(dealt.mapInPandas(classify, SHARED), "stretches")
    region = F.col("start") + F.col("windows") + (WINDOW - 1)
    whole = shared.where("whole").select("row", F.col("start").alias("first"), region.alias("last"))
    opened = shared.where("open")
    kinds = opened.groupBy("anchor").agg(F.count("*").alias("n"))
    limit = max(STRETCHES, -(-opened.count() // MAX_SPLIT))
    split = kinds.where(F.col("n") > limit).select("anchor", F.lit(True).alias("split"))  # MAX_SPLIT rows at most
    wanted = opened.groupBy("row").agg(F.collect_list(F.struct("anchor", "start", "windows", "whole")).alias("wanted"))
    bodies = docs.select("row", "packed").join(wanted, "row").mapInPandas(_cut_out, CUT_OUT)
    bodies = materialise(bodies.join(F.broadcast(split), "anchor", "left"), "bodies", compression="zstd")
    grouped = bodies.where("split is null").drop("split").repartition(parts, "anchor").sortWithinPartitions("anchor")
    sorted_spans = grouped.mapInPandas(_sorted_groups, SPAN)
    windows = bodies.where("split").select("row", "start", "body").mapInPandas(_single_windows, "h1 long, h2 long, row long, first int")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    single = windows.join(twice, ["h1", "h2"], "left_semi").select("row", "first", (F.col("first") + WINDOW).alias("last"))
    return copied.unionByName(whole).unionByName(sorted_spans).unionByName(single)


def remove_repeats(df: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, rest.

    Texts are bytes in UTF-8, null is empty; ``rest`` are the bytes that stay, which may cut a
    character. All copies of a string go, also the first, and strings are judged on the input.
    Texts shorter than WINDOW stay whole. Rows that repeat an id, and null ids, are documents of
    their own. Columns besides doc_id and text are not read.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(_packed, PACKED)
    docs = materialise(docs.withColumn("row", F.monotonically_increasing_id()), "packed", compression="none")
    spans = repeated_spans(docs, parts).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    rests = docs.join(spans, "row", "left").select("doc_id", "packed", "spans").mapInPandas(
        _rests, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, rest binary"
    )
    return rests.withColumn("doc_id", F.col("doc_id").cast(df.schema["doc_id"].dataType))
