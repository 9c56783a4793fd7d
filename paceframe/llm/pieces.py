"""SentencePiece ids by a streaming Viterbi search, and texts from ids.

A text is written with a mark for each space and cut into pieces of the vocabulary at the least
total cost; characters without a piece become pieces for their UTF-8 bytes. The search runs over
the text as a stream. It keeps the best costs of as many places as the longest piece has
characters, and gives out ids as soon as the backpointers of all places from which a path can go
on meet in one boundary: no later character can change what stands before it.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

MARK = "▁"
SCALE = 1_000_000
# Added to the cost of a byte piece, as much as the library takes off for unknown characters.
BYTE_PENALTY = 10
# Short strings between sure boundaries are kept with their ids up to so many bytes, for one task.
KEPT_BYTES = 24 << 20
LONGEST_KEPT = 64
# What an entry takes besides its characters and ids: two objects and a place in the table.
ENTRY_BYTES = 150
# Rows that are in Python at a time.
ROWS = 500


class Pieces:
    """The vocabulary of a model file, with integer costs.

    ``stored`` takes the negative scores of the file, which are log probabilities in a unigram
    model. A file of merges has ranks instead; there a piece costs the logarithm of its rank
    among the pieces, as frequencies of words fall with their rank.
    """

    def __init__(self, model: bytes, stored: bool = False):
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = processor.vocab_size()
        self.names = [processor.id_to_piece(i) for i in range(size)]
        self.byte_of = {i: int(self.names[i][3:5], 16) for i in range(size) if processor.is_byte(i)}
        self.byte_ids = [0] * 256
        for i, value in self.byte_of.items():
            self.byte_ids[value] = i
        special = {i for i in range(size) if processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)}
        normal = [i for i in range(size) if i not in special and i not in self.byte_of]
        self.costs: dict[str, tuple[int, int]] = {}
        for rank, i in enumerate(normal):
            cost = -processor.get_score(i) if stored else math.log(rank + 2)
            self.costs[self.names[i]] = (round(cost * SCALE), i)
        worst = max(c for c, _ in self.costs.values())
        self.byte_cost = worst + BYTE_PENALTY * SCALE
        self.longest = max(map(len, self.costs))
        # A space mark in the text itself is spelled in bytes, so that it comes back as itself.
        self.prefix = processor.normalize("a").startswith(MARK)
        long = [p for p in self.costs if len(p) > 1]
        # If the mark only ever begins a piece or repeats, every word is on its own; so is every
        # character that is in no longer piece, and so are letters if pieces don't mix them with
        # other characters.
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in long)
        inner = {c for p in long for c in p} - {MARK}
        letters = {c for c in inner if c.isalpha()}
        mixed = any(a.isalpha() != b.isalpha() for p in long for a, b in zip(p, p[1:]) if a != MARK)
        kinds = [inner] if mixed else [letters, inner - letters]
        runs = [f"{MARK}*[{re.escape(''.join(sorted(k)))}]+" for k in kinds if k]
        self.words = re.compile("|".join([*runs, f"{MARK}+", "."]), re.DOTALL)


    @cached_property
    def tree(self) -> dict:
        """All pieces by their characters; under None what ends there, as (cost, ids)."""
        root: dict = {}
        for name, (cost, i) in self.costs.items():
            node = root
            for c in name:
                node = node.setdefault(c, {})
            node[None] = (cost, (i,))
        return root


class Stream:
    """The search over one text, fed in parts."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.text = ""  # from the last boundary on
        self.done = 0  # places in it from which all pieces have been tried
        self.cost: list[int | None] = [0]  # least cost of each place, None where no path leads
        self.back: list[tuple[int, tuple[int, ...]]] = [(0, ())]

    def feed(self, part: str) -> list[int]:
        """Ids that are certain after ``part``."""
        out: list[int] = []
        size = 4 * self.pieces.longest
        for at in range(0, len(part), size):
            self._extend(part[at : at + size])
            # A place is done when the longest piece that begins there has been read.
            self._search(len(self.text) - self.pieces.longest + 1)
            out += self._commit()
        return out

    def hold(self, part: str) -> list[int]:
        """Takes a part that is too short to decide anything."""
        self._extend(part)
        return []

    def _extend(self, part: str) -> None:
        self.text += part
        self.cost += [None] * len(part)
        self.back += [(0, ())] * len(part)

    def _search(self, upto: int) -> None:
        text, cost, back, tree, n = self.text, self.cost, self.back, self.pieces.tree, len(self.text)
        for start in range(self.done, upto):
            base = cost[start]
            if base is None:
                continue
            node, end = tree.get(text[start]), start + 1
            if node is None or None not in node:
                data = text[start].encode()
                total = base + len(data) * self.pieces.byte_cost
                if cost[end] is None or total < cost[end]:
                    cost[end], back[end] = total, (start, tuple(self.pieces.byte_ids[b] for b in data))
            while node is not None:
                if None in node:
                    total = base + node[None][0]
                    if cost[end] is None or total < cost[end]:
                        cost[end], back[end] = total, (start, node[None][1])
                if end == n:
                    break
                node, end = node.get(text[end]), end + 1
        self.done = max(self.done, upto)

    def _commit(self) -> list[int]:
        """Gives out what lies before the place where the backpointers of all live places meet."""
        live = {place for place in range(self.done, len(self.cost)) if self.cost[place] is not None}
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(self.back[last][0])
        boundary = live.pop()
        if not boundary:
            return []
        ids = self._path(boundary)
        # No live path comes from before the boundary, so costs can be counted from it.
        base = self.cost[boundary]
        self.text = self.text[boundary:]
        self.done = max(0, self.done - boundary)
        self.cost = [0, *[None if c is None else c - base for c in self.cost[boundary + 1 :]]]
        self.back = [(0, ()), *[(start - boundary, found) for start, found in self.back[boundary + 1 :]]]
        return ids

    def _path(self, place: int) -> list[int]:
        parts = []
        while place:
            place, found = self.back[place]
            parts.append(found)
        return [i for found in reversed(parts) for i in found]

    def finish(self) -> list[int]:
        self._search(len(self.text))
        return self._path(len(self.text))


class Encoder:
    """Texts to ids and back."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.kept: dict[str, bytes] = {}
        self.kept_bytes = 0

    def _search(self, text: str) -> bytes:
        stream = Stream(self.pieces)
        certain = stream.feed(text) if len(text) > self.pieces.longest else stream.hold(text)
        return array("i", certain + stream.finish()).tobytes()

    def marked(self, text: str) -> str:
        return (MARK if self.pieces.prefix and text else "") + text.replace(" ", MARK)

    def encode(self, text: str) -> bytes:
        """The cheapest ids, 32 bits each; of equal paths to a place the one whose last piece is
        longest."""
        if MARK in text:  # not a space: each goes in bytes, with a boundary on both sides
            spelled = array("i", [self.pieces.byte_ids[b] for b in MARK.encode()]).tobytes()
            first, *rest = text.split(MARK)
            lead = array("i", [self.pieces.costs[MARK][1]] if self.pieces.prefix else []).tobytes()
            parts = [self._encode(self.marked(first)) if first else lead]
            for part in rest:
                parts += [spelled, self._encode(part.replace(" ", MARK))]
            return b"".join(parts)
        return self._encode(self.marked(text))

    def _encode(self, marked: str) -> bytes:
        if not self.pieces.by_word:
            return self._search(marked)
        kept, words = self.kept, self.pieces.words.findall(marked)
        try:
            return b"".join([kept[w] for w in words])
        except KeyError:
            if self.kept_bytes >= KEPT_BYTES:
                self.forget()
                kept = self.kept
        out = []
        for word in words:
            ids = kept.get(word)
            if ids is None:
                ids = self._search(word)
                if len(word) <= LONGEST_KEPT:
                    kept[word] = ids
                    self.kept_bytes += ENTRY_BYTES + len(word) + len(ids)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        names, byte_of = self.pieces.names, self.pieces.byte_of
        parts, data = [], bytearray()
        for i in ids:
            if i in byte_of:
                data.append(byte_of[i])
                continue
            if data:
                parts.append(data.decode("utf-8", "replace"))
                data.clear()
            parts.append(names[i].replace(MARK, " "))
        if data:
            parts.append(data.decode("utf-8", "replace"))
        text = "".join(parts)
        return text[1:] if self.pieces.prefix and text.startswith(" ") else text


def _encoder(model: Broadcast, stored: bool) -> Encoder:
    """A task's own encoder: workers outlive their tasks, and later ones need the memory."""
    return Encoder(Pieces(model.value, stored))


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _encode_texts(model: Broadcast, stored: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, stored)
        for batch in _small(batches):
            found = [None if t is None else encoder.encode(t) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *[len(f or b"") // 4 for f in found]])
            offsets = pa.array(ends, pa.int32(), mask=np.array([*[f is None for f in found], False]))
            values = pa.array(np.frombuffer(b"".join([f or b"" for f in found]), dtype=np.int32), pa.int32())
            ids = pa.ListArray.from_arrays(offsets, values)
            yield pa.RecordBatch.from_arrays([batch.column("row"), ids], names=["row", "ids"])

    return run


def _decode_ids(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, False)
        for batch in _small(batches):
            texts = [encoder.decode(i.values.to_numpy().tolist()) if i.is_valid else None for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return run


def _mapped(df: DataFrame, column: str, function: Callable, result: str, kind: DataType) -> DataFrame:
    """``df`` with ``column`` replaced by ``result``, which ``function`` makes of it."""
    rest = [c for c in df.columns if c not in (column, result)]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0))
    rows = df.select(row.alias("row"), F.col(column))
    made = rows.mapInArrow(function, StructType([rows.schema["row"], StructField(result, kind)]))
    return made.select(*[F.col("row").getField(c).alias(c) for c in rest], result)


def encode_pieces(df: DataFrame, model: bytes, stored: bool = False) -> DataFrame:
    """``df`` with ``ids`` (array of int) in the place of ``text``.

    Null texts have null ids, empty ones no ids. Other columns pass unchanged; a column that is
    called ids already is replaced.
    """
    return _mapped(df, "text", _encode_texts(df.sparkSession.sparkContext.broadcast(model), stored), "ids", ArrayType(IntegerType()))


def decode_pieces(df: DataFrame, model: bytes) -> DataFrame:
    """``df`` with ``text`` in the place of ``ids``, exactly the text that was encoded."""
    return _mapped(df, "ids", _decode_ids(df.sparkSession.sparkContext.broadcast(model)), "text", StringType())
