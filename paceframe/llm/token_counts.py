"""Token counts of a byte-level BPE tokenizer by rank-synchronous merging of arrays.

Texts are cut into pre-tokens by the classes of their characters, held as ragged numpy arrays:
one buffer of bytes and the bounds of the pre-tokens in it. The different ones become sequences of
symbols, all in one array. In every round each sequence merges all occurrences of its own
lowest-rank pair, all sequences at the same time; sequences without a pair leave, and the symbols
they have left are their tokens. A merge makes a symbol that only later ranks use, so a round can
take all occurrences of a pair at once.

A task holds some million characters at a time. Longer texts are counted in parts, cut where a
pre-token ends whatever follows. One unbroken run without such a place is held whole.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters that are counted together, and pre-tokens whose counts a task remembers.
CHARS = 1 << 21
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64
# Symbols that are merged together.
SYMBOLS = 1 << 20

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
# The characters with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What is a pre-token of its own behind an apostrophe.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
# A pre-token of letters or digits ends before these, and nothing before them matters to the rest.
CUT = re.compile(r"[^\W_](?=[ \n,.;:!?、。，])")
NO_RANK = np.iinfo(np.int32).max


def character_classes() -> np.ndarray:
    """The class of every code point. Those that this Python doesn't know as assigned are UNKNOWN:
    the tokenizer's Unicode may be newer."""
    kinds = {"L": LETTER, "N": NUMBER}
    names = (unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1))
    classes = np.fromiter((UNKNOWN if k == "Cn" else kinds.get(k[0], OTHER) for k in names), np.uint8, sys.maxunicode + 1)
    classes[WHITE_SPACE] = SPACE
    return classes


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where it
    is visible, else the next one from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in seen else next(rest)) for b in range(256)]


class Merges:
    """The merges of a tokenizer file as sorted arrays."""

    def __init__(self, spec: dict):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(
            model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        )
        byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not plain or not byte_level or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normalizer, dropout, affixes and prefix space is supported")
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at their surroundings are not supported")
        vocabulary = model["vocab"]
        self.byte_ids = np.array([vocabulary[c] for c in byte_letters()], dtype=np.int64)
        self.width = 1 + max(vocabulary.values())
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int32)
        # Of a pair that is listed twice the last rank counts.
        keys, last = np.unique(keys[::-1], return_index=True)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.ranks = np.append(len(pairs) - 1 - last, NO_RANK).astype(np.int32)
        self.made = np.append(made, 0)  # by rank

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * np.int64(self.width) + right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)


def merged_lengths(merges: Merges, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many symbols are left of each sequence of bytes; ``lengths`` are 1 at least."""
    out = lengths.astype(np.int64)
    symbols = merges.byte_ids[data]
    number = np.repeat(np.arange(len(lengths)), lengths)
    last = np.zeros(len(data), dtype=bool)
    last[np.cumsum(lengths) - 1] = True
    ranks = np.full(len(data), NO_RANK, dtype=np.int32)
    inner = np.flatnonzero(~last)
    ranks[inner] = merges.ranks_of(symbols[inner], symbols[inner + 1])
    while len(symbols):
        starts = np.flatnonzero(np.diff(number, prepend=-1))
        sizes = np.diff(starts, append=len(symbols))
        best = np.minimum.reduceat(ranks, starts)
        going = best < NO_RANK
        ended = ~going
        out[number[starts[ended]]] = sizes[ended]
        if ended.any():
            stays = np.repeat(going, sizes)
            symbols, number, ranks, last = symbols[stays], number[stays], ranks[stays], last[stays]
            best, sizes = best[going], sizes[going]
            if not len(symbols):
                break
        hit = ranks == np.repeat(best, sizes)
        # Of overlapping pairs, as in a run of one symbol, the first, third and so on merge.
        at = np.flatnonzero(hit)
        heads = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        in_run = np.arange(len(at)) - np.repeat(heads, np.diff(heads, append=len(at)))
        at = at[in_run % 2 == 0]
        symbols[at] = merges.made[ranks[at]]
        last[at] = last[at + 1]
        kept = np.ones(len(symbols), dtype=bool)
        kept[at + 1] = False
        symbols, number, ranks, last = symbols[kept], number[kept], ranks[kept], last[kept]
        at -= np.arange(len(at))  # where the merged symbols are now
        before = at[at > 0] - 1
        changed = np.concatenate([at, before])
        open_pairs = changed[~last[changed]]
        ranks[changed] = NO_RANK
        ranks[open_pairs] = merges.ranks_of(symbols[open_pairs], symbols[open_pairs + 1])
    return out


class Counter:
    """Counts the tokens of texts; remembers the counts of short pre-tokens."""

    def __init__(self, tokenizer_json: str, classes: np.ndarray):
        spec = json.loads(tokenizer_json)
        self.json, self.merges, self.classes = tokenizer_json, Merges(spec), classes.copy()
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.tokenizer = None
        self._forget()

    def _forget(self) -> None:
        self.known, self.known_counts = pa.array([], pa.binary()), np.zeros(0, dtype=np.int64)

    def _learn_classes(self, codes: np.ndarray) -> None:
        """Asks the library about characters that this Python doesn't know."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(self.json).pre_tokenizer
        for code in np.unique(codes).tolist():
            beside = [k for k, c in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.tokenizer.pre_tokenize_str(c + chr(code))) == 1]
            self.classes[code] = beside[0] if beside else SPACE

    def _starts(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin, of texts that begin where ``first`` is true."""
        kinds = self.classes[codes]
        if (kinds == UNKNOWN).any():
            self._learn_classes(codes[kinds == UNKNOWN])
            kinds = self.classes[codes]
        start = first.copy()
        start[1:] |= kinds[1:] != kinds[:-1]
        # The last space character before other characters goes with them if it is a blank, else
        # it is on its own; those before it are one pre-token.
        behind = np.flatnonzero(start[1:] & ~first[1:] & (kinds[:-1] == SPACE)) + 1
        start[behind - 1] = True
        start[behind] = codes[behind - 1] != 0x20
        # A contraction is cut from what follows, if the apostrophe begins a pre-token.
        quotes = np.flatnonzero((codes[:-1] == 0x27) & start[:-1] & (kinds[1:] == LETTER) & ~first[1:])
        for ending in CONTRACTIONS:
            found = quotes[quotes + len(ending) < len(codes)]
            for k, c in enumerate(ending, 1):
                found = found[(codes[found + k] == ord(c)) & ~first[found + k]]
            start[found + 1] = False
            after = found + len(ending) + 1
            start[after[after < len(codes)]] = True
        return start

    def _lengths(self, words: pa.Array) -> np.ndarray:
        """Tokens of each of ``words``, which differ."""
        at = pc.index_in(words, value_set=self.known)
        new = np.flatnonzero(np.asarray(at.is_null()))
        out = np.zeros(len(words), dtype=np.int64)
        old = np.asarray(at.is_valid())
        out[old] = self.known_counts[np.asarray(at.drop_null())]
        fresh = words.take(pa.array(new))
        # A slice's offsets and bytes, without what lies before them in the buffers.
        bounds = np.frombuffer(fresh.buffers()[1], dtype=np.int32)[fresh.offset : fresh.offset + len(fresh) + 1] if len(fresh) else np.zeros(1, np.int32)
        data = np.frombuffer(fresh.buffers()[2], dtype=np.uint8) if len(fresh) else np.zeros(0, np.uint8)
        counts = np.zeros(len(fresh), dtype=np.int64)
        begin = 0
        while begin < len(fresh):
            end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + SYMBOLS)) - 1)
            piece = bounds[begin : end + 1]
            counts[begin:end] = merged_lengths(self.merges, data[piece[0] : piece[-1]], np.diff(piece))
            begin = end
        out[new] = counts
        short = np.diff(bounds) <= LONGEST_REMEMBERED
        if len(self.known) + short.sum() > REMEMBERED:
            self._forget()
        if len(fresh) <= REMEMBERED:
            self.known = pa.concat_arrays([self.known, fresh.filter(pa.array(short))])
            self.known_counts = np.concatenate([self.known_counts, counts[short]])
        return out

    def _count_parts(self, parts: list[str]) -> np.ndarray:
        """Tokens of each part; parts are not empty and hold no special string."""
        text = "".join(parts)
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        first = np.zeros(len(codes), dtype=bool)
        begins = np.cumsum([0, *map(len, parts)])[:-1]
        first[begins] = True
        starts = np.flatnonzero(self._starts(codes, first))
        # Offsets count bytes of UTF-8.
        wide = np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), dtype=np.int32)
        offsets = np.append(np.append(0, wide)[starts], wide[-1]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text.encode())])
        distinct = words.dictionary_encode()
        tokens = self._lengths(distinct.dictionary)[np.asarray(distinct.indices)]
        return np.add.reduceat(tokens, np.searchsorted(starts, begins))

    def _parts(self, text: str) -> Iterator[str]:
        begin = 0
        while len(text) - begin > CHARS:
            cut = CUT.search(text, begin + CHARS)
            if not cut:
                break
            yield text[begin : cut.end()]
            begin = cut.end()
        yield text[begin:]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text, 0 for null and empty ones."""
        out = np.zeros(len(texts), dtype=np.int64)
        held: list[str] = []
        of: list[int] = []
        size = 0
        for number, text in enumerate(texts):
            if not text:
                continue
            pieces = [text]
            if self.special and self.special.search(text):
                pieces = self.special.split(text)
                out[number] += len(pieces) - 1
            for piece in filter(None, pieces):
                for part in self._parts(piece):
                    held.append(part)
                    of.append(number)
                    size += len(part)
                    if size >= CHARS:
                        np.add.at(out, of, self._count_parts(held))
                        held, of, size = [], [], 0
        if held:
            np.add.at(out, of, self._count_parts(held))
        return out


def count_tokens(df: DataFrame, tokenizer_json: str, limit: int = 1024) -> DataFrame:
    """``df`` with n_bytes (UTF-8), n_tokens and over_limit, whether n_tokens is over ``limit``.

    Counts are those of the tokenizers library without begin, end or padding: a special string in
    a text is one token. Null and empty texts have none. Every row is counted by itself, repeated
    ones too; other columns pass unchanged, of whatever name, but columns with the names of the
    three results are replaced. An empty table gives no rows. A file of another kind than
    byte-level BPE raises ValueError.
    """
    context = df.sparkSession.sparkContext
    Merges(json.loads(tokenizer_json))
    model = context.broadcast(tokenizer_json)
    table = context.broadcast(character_classes())

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(model.value, table.value)
        for texts in batches:
            # As few texts as Python strings at a time as make up a part.
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.unique(np.append(np.flatnonzero(np.diff(sizes // CHARS, prepend=0)), [0, len(texts)]))
            counts = [counter.count(texts.slice(a, b - a).to_pylist()) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())

    n_tokens = tokens(F.col("text"))
    counted = df.withColumn("n_tokens", n_tokens)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.withColumns({"n_bytes": n_bytes, "over_limit": F.col("n_tokens") > limit})
