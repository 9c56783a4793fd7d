"""Word shingles of texts as sets of 64-bit hashes, computed on whole buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

WORDS = 5
# Texts are hashed together up to about so many bytes; a longer text goes alone.
CHUNK_BYTES = 1 << 20

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of the 64-bit values over all others, one to one."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def _folded() -> np.ndarray:
    """Every byte, A-Z as a-z."""
    codes = np.arange(256, dtype=np.uint8)
    codes[65:91] += 32
    return codes


_FOLDED = _folded()
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
# Words up to so many bytes are hashed eight bytes at a time, all words together; longer ones apart.
_TOGETHER = 64


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    chunk: list[bytes] = []
    size = 0
    for text in texts:
        if chunk and size + len(text) > CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text) + 1
    if chunk:
        yield chunk


def _word_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The start of each word in the buffer and its hash.

    Each step takes eight bytes of a word into its hash and spreads them over all bits, so that
    words collide by chance only, whatever their pattern. ``buffer`` ends in white space.
    """
    inside = np.zeros(len(buffer) + 2, dtype=np.int8)
    inside[1:-1] = ~_WHITE[buffer]
    steps = np.diff(inside)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    folded = np.append(_FOLDED[buffer], np.zeros(8, dtype=np.uint8))
    lanes = np.ndarray(len(buffer) + 1, dtype="<u8", buffer=folded, strides=(1,))
    lengths = ends - starts
    hashes = mixed(lengths.astype(np.uint64) * _FACTOR)
    for at in range(0, _TOGETHER, 8):
        more = np.flatnonzero((lengths > at) & (lengths <= _TOGETHER))
        if not len(more):
            break
        rest = np.minimum(lengths[more] - at, 8).astype(np.uint64)
        lane = lanes[starts[more] + at] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * rest))
        hashes[more] = mixed((hashes[more] ^ lane) * _FACTOR)
    for k in np.flatnonzero(lengths > _TOGETHER).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(folded[starts[k] : ends[k]].tobytes())
    return starts, hashes


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each UTF-8 text the sorted different hashes of its runs of five words.

    Words are split at ASCII white space and A-Z is folded. A text with one to four words has
    the whole sequence as its only shingle, a text without words none.
    """
    for chunk in _chunks(texts):
        # Texts are joined by white space, so no word spans two of them.
        buffer = np.frombuffer(b" ".join(chunk) + b" ", dtype=np.uint8)
        starts, words = _word_hashes(buffer)
        lengths = np.fromiter((len(t) + 1 for t in chunk), dtype=np.int64, count=len(chunk))
        bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
        runs = np.zeros(max(0, len(words) - WORDS + 1), dtype=np.uint64)
        for k in range(WORDS):
            runs = mixed(runs * _FACTOR + words[k : k + len(runs)])
        for first, last in zip(bounds[:-1], bounds[1:]):
            n = last - first
            if n >= WORDS:
                yield np.unique(runs[first : last - WORDS + 1])
            elif n:
                whole = np.array([n], dtype=np.uint64)
                for word in words[first:last]:
                    whole = mixed(whole * _FACTOR + word)
                yield whole
            else:
                yield np.empty(0, dtype=np.uint64)
