"""Language of a text by prediction by partial matching.

For each language a context tree of bytes up to order three is counted on labelled texts and then
frozen. The cost of a byte is its code length: if the byte was seen in the context, the share of
its count; else the cost of an escape and that of the byte in the next shorter context. Escape
probabilities are those of method C, where a context with t symbols of d kinds escapes with
d / (t + d). The language whose tree codes the whole text shortest is the answer.

Scoring looks up whole rows, one column a language: costs of all strings of four bytes that any
tree knows are laid out in advance, the others are put together from shorter contexts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceframe.session import materialise

ORDER = 3
UNKNOWN = "und"
# Training reads so many bytes of each language, the lowest digests of the id first; the last text is cut there.
TRAIN_BYTES = 3_000_000
# Trees of so many languages are in memory at once; more are scored block by block.
BLOCK_LANGUAGES = 16
SCORED = "doc_id string, text string, held_out boolean, lang_pred string, bits double, mass double"
# Costs that are held at once: bytes times languages.
CHUNK_CELLS = 1 << 22
# Byte 0 stands for what precedes a text.
_SHIFTS = [0, 8, 16, 24]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def strings(texts: list[bytes], order: int) -> np.ndarray:
    """Each byte of the texts with the ``order`` bytes before it, the oldest in the highest place."""
    padded = [b"\0" * ORDER + t for t in texts]
    data = np.frombuffer(b"".join(padded), dtype=np.uint8).astype(np.uint32)
    out = np.zeros(len(data) - ORDER, dtype=np.uint32) if len(data) else np.zeros(0, dtype=np.uint32)
    for k in range(order + 1):
        out |= data[ORDER - k : len(data) - k] << np.uint32(8 * k)
    lengths = np.array([len(p) for p in padded])
    # Strings that end in the padding of the next text are not of any text.
    inside = np.ones(len(data), dtype=bool)
    starts = np.cumsum(lengths) - lengths
    for k in range(ORDER):
        inside[starts + k] = False
    return out[inside[ORDER:]]


@dataclass
class _Level:
    """Costs in bits of the strings of one length, a row each; NaN where a tree must escape."""

    keys: np.ndarray
    costs: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray  # bits to leave the context; 0 where the tree has no such context


class Trees:
    """The frozen trees of several languages."""

    def __init__(self, counts: list[list[tuple[np.ndarray, np.ndarray]]], languages: list[str]):
        """``counts[language][order]`` are sorted strings of ``order + 1`` bytes and their numbers."""
        self.languages = languages
        self.levels = [self._level([c[order] for c in counts]) for order in range(ORDER + 1)]
        self.slots = self._table()

    @staticmethod
    def _level(counts: list[tuple[np.ndarray, np.ndarray]]) -> _Level:
        keys = np.unique(np.concatenate([k for k, _ in counts]))
        contexts = np.unique(keys >> np.uint32(8))
        costs = np.full((len(keys), len(counts)), np.nan, dtype=np.float64)
        escapes = np.zeros((len(contexts), len(counts)), dtype=np.float64)
        for column, (k, n) in enumerate(counts):
            if not len(k):
                continue
            own, first, kinds = np.unique(k >> np.uint32(8), return_index=True, return_counts=True)
            total = np.add.reduceat(n, first)
            bits = np.log2(np.repeat(total + kinds, kinds) / n)
            costs[np.searchsorted(keys, k), column] = bits
            escapes[np.searchsorted(contexts, own), column] = np.log2((total + kinds) / kinds)
        return _Level(keys, costs, contexts, escapes)

    def costs(self, strings_: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of each string's last byte in each language, given the bytes before it."""
        if order < 0:
            return np.full((len(strings_), len(self.languages)), 8.0)
        level = self.levels[order]
        mask = np.uint32((1 << (8 * (order + 1))) - 1)
        key = strings_ & mask
        at = np.minimum(np.searchsorted(level.keys, key), max(0, len(level.keys) - 1))
        known = level.keys[at] == key if len(level.keys) else np.zeros(len(key), dtype=bool)
        bits = np.where(known[:, None], level.costs[at], np.nan)
        missing = np.isnan(bits).any(axis=1)
        if missing.any():
            context = key[missing] >> np.uint32(8)
            at = np.minimum(np.searchsorted(level.contexts, context), len(level.contexts) - 1)
            seen = level.contexts[at] == context
            escape = np.where(seen[:, None], level.escapes[at], 0.0)
            rest = escape + self.costs(strings_[missing], order - 1)
            bits[missing] = np.where(np.isnan(bits[missing]), rest, bits[missing])
        return bits

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.uint32, int]:
        """Costs of all known strings of full length by a hash that keeps the place of few."""
        keys = self.levels[ORDER].keys
        size = 1 << max(4, (4 * len(keys)).bit_length())
        slot = self._slot(keys, size)
        holder = np.zeros(size, dtype=np.uint32)
        row = np.full(size, len(keys), dtype=np.int32)
        holder[slot] = keys  # of strings that meet, the last holds the place
        row[slot] = np.arange(len(keys), dtype=np.int32)
        return holder, row, size, self.costs(keys).astype(np.float32)

    @staticmethod
    def _slot(keys: np.ndarray, size: int) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> np.uint32(33 - size.bit_length())).astype(np.int64)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text in each language.

        At most two times CHUNK_CELLS costs, a row a byte and a column a language, are in memory
        at once. Longer texts are added up part by part, cut at fixed places of their own, so that
        a text has the same sum whatever stands beside it.
        """
        out = np.zeros((len(texts), len(self.languages)))
        most = max(1, CHUNK_CELLS // len(self.languages))
        parts: list[tuple[int, int]] = []  # number of a text, first byte of its part
        size = 0
        for i, text in enumerate(texts):
            for start in range(0, len(text), most):
                parts.append((i, start))
                size += min(most, len(text) - start)
                if size >= most:
                    self._add_lengths(texts, parts, most, out)
                    parts, size = [], 0
        if parts:
            self._add_lengths(texts, parts, most, out)
        return out

    def _add_lengths(self, texts: list[bytes], parts: list[tuple[int, int]], most: int, out: np.ndarray) -> None:
        leads = [min(ORDER, start) for _, start in parts]
        cut = [texts[i][start - lead : start + most] for (i, start), lead in zip(parts, leads)]
        sizes = np.array([len(c) for c in cut])
        found = strings(cut, ORDER)
        if any(leads):  # bytes that only lead to a part belong to the part before
            place = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            found = found[place >= np.repeat(leads, sizes)]
            sizes = sizes - leads
        holder, row, size, known = self.slots
        slot = self._slot(found, size)
        hit = (holder[slot] == found) & (row[slot] < len(known))
        bits = np.empty((len(found), len(self.languages)))
        bits[hit] = known[row[slot[hit]]]
        if not hit.all():
            others, back = np.unique(found[~hit], return_inverse=True)
            bits[~hit] = self.costs(others)[back]
        sums = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0)
        np.add.at(out, [i for i, _ in parts], sums)


def count_strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, depth, string, n): strings of every order in the first ``room`` bytes of each text,
    added up per batch."""
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            texts = [t.encode()[:room] for t, room in zip(rows["text"], rows["room"])]
            for order in range(ORDER + 1):
                found, n = np.unique(strings(texts, order), return_counts=True)
                yield pd.DataFrame({"lang": lang, "depth": order, "string": found.astype(np.int64), "n": n})


def languages_of(df: DataFrame) -> list[str]:
    """Every language that a text of ``df`` has, by name."""
    return sorted(r["lang"] for r in df.where("text <> '' and lang is not null").select("lang").distinct().collect())


def train(df: DataFrame, languages: list[str], train_bytes: int = TRAIN_BYTES) -> Trees | None:
    """Trees of ``languages`` from the rows of ``df`` (text, lang, doc_id); None if there are none.

    The first ``train_bytes`` of a language are counted in the order of a digest of the id, or of
    the text where the id is null, so the trees are bounded: at most as many strings of a length
    as bytes. The text that crosses the bound is counted up to there.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text")).cast("binary"))
    size = F.least(F.octet_length("text"), F.lit(train_bytes))
    rows = df.where((F.col("text") != "") & F.col("lang").isin(languages)).select("lang", "text", digest.alias("digest"), size.alias("bytes"))
    sizes = rows.groupBy("lang").agg(F.sum("bytes").alias("total"), F.min("digest").alias("first")).collect()
    if not sizes:
        return None
    # A share of the digests that holds twice the bytes wanted bounds what the window sorts; the
    # lowest digest is learned also where the share holds none.
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * train_bytes / max(1, r["total"]))))])
    lowest = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(r["first"]))])
    part = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") / 2**32
    few = rows.where((part < F.try_element_at(share, F.col("lang"))) | (F.col("digest") == F.try_element_at(lowest, F.col("lang"))))
    upto = F.sum("bytes").over(Window.partitionBy("lang").orderBy("digest", "text").rowsBetween(Window.unboundedPreceding, 0))
    room = F.least(F.col("bytes"), F.lit(train_bytes) - F.col("upto") + F.col("bytes"))
    chosen = few.withColumn("upto", upto).select("lang", "text", room.cast("int").alias("room")).where("room > 0")
    counted = chosen.mapInPandas(count_strings, "lang string, depth int, string long, n long").groupBy("lang", "depth", "string").agg(F.sum("n").alias("n"))
    table = counted.toPandas()  # at most len(languages) * (ORDER + 1) * train_bytes rows
    languages = sorted(table["lang"].unique())
    if not languages:
        return None
    counts = []
    for lang in languages:
        own = table[table["lang"] == lang]
        levels = []
        for order in range(ORDER + 1):
            rows_ = own[own["depth"] == order].sort_values("string")
            levels.append((rows_["string"].to_numpy().astype(np.uint32), rows_["n"].to_numpy(dtype=np.float64)))
        counts.append(levels)
    return Trees(counts, languages)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict(trees: Broadcast, last: bool):
    """Rows of SCORED with the languages of ``trees`` added; ``last`` gives the score in place of
    the text, of ``bits``, the least code length so far, and ``mass``, the sum of the likelihoods
    of all languages so far, relative to that of ``lang_pred``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Trees | None = cloudpickle.loads(trees.value)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            known = np.array([model is not None and has_letter(t) for t in texts], dtype=bool)
            lang = batch["lang_pred"].to_numpy(dtype=object, copy=True)
            least, mass = (batch[c].to_numpy(dtype=float, copy=True) for c in ("bits", "mass"))
            if known.any():
                data = [t.encode() for t, k in zip(texts, known) if k]
                bits = model.lengths(data)
                best = bits.argmin(axis=1)
                own, before = bits.min(axis=1), least[known]
                now = np.minimum(own, before)
                # Probability of the language when all are as likely before.
                gap = (bits - now[:, None]) * math.log(2)
                mass[known] = mass[known] * np.exp((now - before) * math.log(2)) + np.exp(-gap).sum(axis=1)
                lang[known] = np.where(own < before, np.array(model.languages, dtype=object)[best], lang[known])
                least[known] = now
            out = {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": lang}
            if last:
                yield pd.DataFrame(out | {"score": np.divide(1, mass, out=np.zeros(len(mass)), where=mass > 0)})
            else:
                yield pd.DataFrame(out | {"text": batch["text"], "bits": least, "mass": mass})

    return run


def identify(df: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1).

    Documents whose crc32 of the id modulo 5 is 0 are held out and not learned from. Texts that
    are null or have no letter, and all texts when there is nothing to learn from, are ``und``
    with score 0. Ties go to the first language by name. A null id is not held out. Rows that
    repeat an id have a row each. Columns besides doc_id, text and lang are not read.

    Every language is learned. Beyond BLOCK_LANGUAGES the texts are written once for each further
    block, with the best language so far.
    """
    rows = df.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    labelled = rows.where("not held_out")
    languages = languages_of(labelled)
    # An integer id becomes a float beside a null in pandas, so it travels as text.
    out = rows.select(
        F.col("doc_id").cast("string").alias("doc_id"), "text", "held_out",
        F.lit(UNKNOWN).alias("lang_pred"), F.lit(math.inf).alias("bits"), F.lit(0.0).alias("mass"),
    )
    # By name, so that ties go to the first language.
    blocks = [languages[i : i + BLOCK_LANGUAGES] for i in range(0, len(languages), BLOCK_LANGUAGES)] or [[]]
    for block in blocks:
        trees = train(labelled, block, train_bytes) if block else None
        # Packed with its class, which executors need not have.
        sent = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(trees))
        if block is blocks[-1]:
            out = out.mapInPandas(predict(sent, True), "doc_id string, held_out boolean, lang_pred string, score double")
        else:
            out = materialise(out.mapInPandas(predict(sent, False), SCORED), "scored", compression="zstd")
            sent.destroy()
    return out.withColumn("doc_id", F.col("doc_id").cast(df.schema["doc_id"].dataType))
