"""Token ids in files: frequency-ranked, byte-aligned, with the control bytes apart.

Ids are replaced by their rank in the corpus, so that frequent ones are small numbers. A number
takes one to four data bytes; two bits tell how many, four of them in a control byte. A file has
blocks of whole documents: ids and lengths of the documents, control bytes, data bytes. Blocks are
numbered by (part, seq) in ascending order of the document ids. Files are Parquet, with the ranks
in a table beside them, so that they can lie wherever Spark can write.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceframe.llm.common import worker_memory
from paceframe.session import materialise

END_ID = 0
# A block ends with the document that brings it to so many ids.
BLOCK_TOKENS = 1 << 18
# Texts are cut into words together up to so many characters.
ENCODE_CHARS = 1 << 22
WHITE_PAIR = re.compile(r"\s\s")
# New words that the library gets as one text.
JOINED = 256
# Fixed value: what stands for a space in a byte-level vocabulary.
SPACE_LETTER = "\u0120"

RAW = "doc_id long, ids binary"
BLOCK = "part int, seq long, before long, doc_ids array<long>, lengths array<int>, control binary, data binary"


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of numbers below 2 ** 32."""
    numbers = numbers.astype("<u4")
    sizes = 1 + (numbers > 0xFF) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    used = np.arange(4) < sizes[:, None]
    data = numbers.view(np.uint8).reshape(-1, 4)[used]
    codes = np.zeros(-(-len(numbers) // 4) * 4, dtype=np.uint8)
    codes[: len(numbers)] = sizes - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


# Sizes of the four numbers of each control byte.
_SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` numbers that :func:`pack` got; sizes come from a table of control bytes."""
    sizes = _SIZES[np.frombuffer(control, dtype=np.uint8)].ravel()[:count]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    source = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(3, dtype=np.uint8)]).astype(np.uint32)
    out = source[starts]
    for k in range(1, 4):
        longer = sizes > k
        out[longer] |= source[starts[longer] + k] << np.uint32(8 * k)
    return out


def _id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class WordEncoder:
    """Ids of texts by the tokenizers library, which is asked once for each word.

    A byte-level tokenizer cuts a text into runs before it merges anything. Where no two white
    space characters meet, every space begins a run and every line feed is one, so the ids of a
    text are those of the pieces between, one after the other; likewise a comma or full stop
    behind a letter begins a run. Other texts, those with special tokens, and all texts of a
    tokenizer of another kind go to the library whole.
    """

    CACHED = 1_500_000

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.kind = _id_type(self.tokenizer.get_vocab_size())
        self.code = "H" if self.kind == "<u2" else "I"
        self.known: dict[str, bytes] = {}
        spec = json.loads(model)
        split = spec.get("pre_tokenizer") or {}
        self.by_word = (
            spec.get("normalizer") is None
            and split.get("type") == "ByteLevel"
            and bool(split.get("use_regex", True))
            and not split.get("add_prefix_space")
        )
        self.special = ["\0", *(t["content"] for t in spec.get("added_tokens", []))]
        self.spaced = np.zeros(1 + max(self.tokenizer.get_vocab().values(), default=0), dtype=bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(SPACE_LETTER)]] = True

    def _whole(self, text: str) -> bool:
        return any(s in text for s in self.special) or WHITE_PAIR.search(text) is not None

    def _library(self, texts: list[str]) -> list[bytes]:
        codes = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, c.ids).tobytes() for c in codes]

    def _together(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that begin with their only space and end with no white space. Joined,
        they still begin runs at their spaces, and only the first token of a run begins with one."""
        texts = ["".join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)]
        if any(map(self._whole, texts)):
            return self._library(pieces)
        ids = np.frombuffer(b"".join(self._library(texts)), dtype=self.kind)
        bounds = np.append(np.flatnonzero(self.spaced[ids]), len(ids))
        if len(bounds) != len(pieces) + 1:
            return self._library(pieces)
        data, bounds = ids.tobytes(), (bounds * ids.itemsize).tolist()
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]

    def _learn(self, pieces: list[str]) -> None:
        known = self.known
        stops, joined, alone = [], {}, {",": None, ".": None}
        for piece in pieces:
            if len(piece) > 1 and piece[-1] in ",." and piece[-2].isalpha():
                stops.append(piece)
                piece = piece[:-1]
                if piece in known:
                    continue
            (joined if piece[0] == " " and not piece[-1].isspace() else alone)[piece] = None
        for new, learn in (joined, self._together), (alone, self._library):
            known.update(zip(new, learn(list(new))))
        known.update((piece, known[piece[:-1]] + known[piece[-1]]) for piece in stops)

    def _by_word(self, texts: list[str]) -> list[bytes]:
        marked = pa.array([t.replace(" ", "\0 ").replace("\n", "\0\n\0") for t in texts], pa.large_string())
        split = pc.split_pattern(marked, "\0")
        pieces = split.flatten().dictionary_encode()
        words, places = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy()
        known = self.known
        if len(known) > self.CACHED:
            known.clear()
        known.setdefault("", b"")
        found = list(map(known.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            self._learn([words[i] for i in new])
        for i in new:
            found[i] = known[words[i]]
        ids = np.frombuffer(b"".join(found), dtype=self.kind)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // ids.itemsize
        starts = (np.cumsum(sizes) - sizes)[places]
        sizes = sizes[places]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = ids[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)].tobytes()
        bounds = (ends[split.offsets.to_numpy()] * ids.itemsize).tolist()
        return [out[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, in the byte order and width of ``kind``."""
        if not self.by_word:
            return self._library(texts)
        plain = [not self._whole(t) for t in texts]
        found = iter(self._by_word([t for t, p in zip(texts, plain) if p]))
        return [next(found) if p else self._library([t])[0] for t, p in zip(texts, plain)]


def _word_encoder(model: str) -> WordEncoder:
    """The encoder of this worker process, which keeps its words from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
    kept = worker_memory()
    key = ("words", hashlib.sha256(model.encode()).digest())
    if key not in kept:
        kept[key] = WordEncoder(model)
    return kept[key]


def _encoder(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _word_encoder(model.value)
        end = array(encoder.code, [END_ID]).tobytes()
        for batch in batches:
            texts, out, size = [t or "" for t in batch.column("text").to_pylist()], [], 0
            held: list[str] = []
            for text in texts:
                held.append(text)
                size += len(text)
                if size >= ENCODE_CHARS:
                    out += encoder.encode(held)
                    held, size = [], 0
            out += encoder.encode(held)
            ids = pa.array([o + end for o in out], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return run


def _counter(kind: str, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                counts += np.bincount(np.frombuffer(ids.as_buffer(), dtype=kind), minlength=vocabulary)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"id": pa.array(seen, pa.int64()), "n": pa.array(counts[seen], pa.int64())})

    return run


def _blocks(kind: str, ranks: Broadcast):
    """Blocks of documents sorted by id; ``before`` counts the ids before a block in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, part = ranks.value, TaskContext.get().partitionId()
        seq = before = size = 0
        doc_ids: list[int | None] = []
        found: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            control, data = pack(rank[np.concatenate(found)])
            columns = {
                "part": pa.array([part], pa.int32()),
                "seq": pa.array([seq], pa.int64()),
                "before": pa.array([before], pa.int64()),
                "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                "lengths": pa.array([[len(f) for f in found]], pa.list_(pa.int32())),
                "control": pa.array([control], pa.binary()),
                "data": pa.array([data], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                doc_ids.append(doc_id)
                found.append(np.frombuffer(ids.as_buffer(), dtype=kind))
                size += len(found[-1])
                if size >= BLOCK_TOKENS:
                    yield block()
                    seq, before, size = seq + 1, before + size, 0
                    doc_ids, found = [], []
        if doc_ids:
            yield block()

    return run


def write_token_files(df: DataFrame, path: str, tokenizer_json: str, parts: int | None = None) -> None:
    """Encodes every text of ``df`` (null as empty), each followed by END_ID, and writes the ids
    to ``path``/blocks in ascending order of doc_id, null first; equal ids in any order.

    Texts are tokenized once. Their ids are kept beside the files until the frequencies of all
    are known, then dealt out by ranges of document ids and packed. The ranks, at most the
    vocabulary, go through the driver to ``path``/ranks.
    """
    spark = df.sparkSession
    encoder = WordEncoder(tokenizer_json)
    vocabulary, kind = encoder.tokenizer.get_vocab_size(), encoder.kind
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = spark.sparkContext.broadcast(tokenizer_json)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw = materialise(docs.mapInArrow(_encoder(model), RAW), "token-ids", compression="zstd")
    counts = raw.select("ids").mapInArrow(_counter(kind, vocabulary), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = counts.sort_values(["n", "id"], ascending=[False, True])
    rank = np.zeros(vocabulary, dtype=np.uint32)
    rank[counts["id"].to_numpy(dtype=np.int64)] = np.arange(len(counts), dtype=np.uint32)
    counts["rank"] = np.arange(len(counts))
    spark.createDataFrame(counts[["rank", "id", "n"]], "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    ordered = raw.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_blocks(kind, spark.sparkContext.broadcast(rank)), BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")


def _decoder(by_rank: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = by_rank.value
        for batch in batches:
            for row in batch.to_pylist():
                bounds = np.concatenate([[0], np.cumsum(row["lengths"], dtype=np.int64)])
                ids = id_of[unpack(row["control"], row["data"], int(bounds[-1]))]
                columns = {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(bounds[:-1] + row["before"] + row["offset"], pa.int64()),
                    "n_tokens": pa.array(row["lengths"], pa.int64()),
                    "ids": pa.array([ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in files: ``start`` counts the ids of all
    documents before, ``ids`` are little-endian unsigned 32-bit integers, the end id included."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()
    by_rank = spark.sparkContext.broadcast(ranks["id"].to_numpy().astype("<u4"))
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    n = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = blocks.select("part", n.alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    # As many rows as the files have parts, which the writer was told.
    rows = blocks.join(F.broadcast(offsets), "part")
    return rows.mapInArrow(_decoder(by_rank), "doc_id long, start long, n_tokens long, ids binary")
