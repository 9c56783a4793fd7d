"""Links between documents whose sets of word shingles overlap, by a blocked sparse product.

The incidence matrix has a row per document and a column per shingle; links are the entries of
its product with its transpose that reach the similarity. Only as many columns of a row are
multiplied as the sizes demand: shingles are put in one order for all documents, frequent ones
last, and two sets that overlap enough share one of their first few. Columns are blocks of a
shuffle, partial overlap counts are added per pair, and a pair goes on only while the bounds that
follow from the two sizes, the places of the shared shingle and folded parity bits of the sets
allow the overlap that a link needs. In the product itself each row carries 512 of those bits, so
that of a group of documents that are alike, but not alike enough, few pairs come out of it. What
is left is counted in full.

Copies are merged first. Then rounds link each document with the partner it shares most with and
merge components, and at last the product is taken between different components only. So a group
of copies costs links in proportion to its documents and not to its pairs, and still no link that
joins two components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from paceframe.llm.graph import components
from paceframe.llm.shingles import shingle_sets
from paceframe.session import materialise

# Similarity 0.8: intersection / union >= 4 / 5, so the overlap is at least 4 / 9 of both sizes.
# Parity bits that the rows of the product carry, as 64-bit words.
WORD_BITS = 512
WORDS = [f"w{i}" for i in range(WORD_BITS // 64)]
PROFILE = "doc_id long, n_shingles long, k1 long, k2 long, parity binary, " + ", ".join(f"{w} long" for w in WORDS)
POSTING = "gram long, doc_id long, n int, place int"
# A posting; or, with a partner, a pair of documents.
MET = "gram long, doc_id long, n int, place int, partner long"
PAIR = "a long, b long"
# Shingles counted at once when frequent ones are sought, and how many of them are kept.
BLOCK_SHINGLES = 1_500_000
MAX_FREQUENT = 1_000_000
# Rows that are in Python at a time, and digests of sets that a task remembers.
ROWS = 1000
SEEN = 10_000
# Rounds that merge components before all pairs between them are tried, and partners a document
# tries in each.
ROUNDS = 3
PARTNERS = 2
# Ids of documents are broadcast up to so many, 16 MB; more are joined by a shuffle. Of components,
# which take several times as much, half as many are.
MAX_BROADCAST = 2_000_000


def needed_overlap(n: Column, m: Column) -> Column:
    return F.ceil((n + m) * 4 / 9)


def _texts(batch: pd.DataFrame) -> list[bytes]:
    return [(t or "").encode() for t in batch["text"]]


def _small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch[at : at + ROWS]


def frequent_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shingles of three or more documents of a block, with their number."""
    held: list[np.ndarray] = []
    size = 0

    def counted() -> pd.DataFrame:
        grams, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"gram": grams[n > 2].view(np.int64), "n": n[n > 2]})

    for batch in _small(batches):
        for found in shingle_sets(_texts(batch)):
            held.append(found)
            size += len(found)
            if size >= BLOCK_SHINGLES:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def parity_bits(found: np.ndarray) -> bytes:
    """Bit i is the parity of the set's members that are i modulo the number of bits.

    The exclusive or of two such strings, folded to the shorter length, has at most as many ones
    as the sets have members that are not in both.
    """
    return _parities(found, max(64, 1 << (2 * len(found) - 1).bit_length()) if len(found) else 64).tobytes()


def _parities(found: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits((np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, from their parity bits."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    width = min(len(x), len(y))
    x = np.bitwise_xor.reduce(x.reshape(-1, width), axis=0)
    y = np.bitwise_xor.reduce(y.reshape(-1, width), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Size, 128-bit digest and parity bits of each document's set, and as many as ``WORD_BITS``."""
    for batch in _small(batches):
        rows = []
        for doc_id, found in zip(batch["doc_id"], shingle_sets(_texts(batch))):
            digest = xxhash.xxh3_128_digest(found.tobytes())
            k1, k2 = np.frombuffer(digest, dtype=np.int64)
            words = _parities(found, WORD_BITS).view(np.int64).tolist()
            rows.append((doc_id, len(found), int(k1), int(k2), parity_bits(found), *words))
        yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "k1", "k2", "parity", *WORDS])


def prefix(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order, as many as a link must share one of."""
    n = len(found)
    length = n - -(-4 * n // 5) + 1
    if len(frequent) and n:
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        rank = np.where(frequent[at] == found, counts[at], 0)
        if rank.any():
            found = found[np.lexsort((found, rank))]
    return found[:length]


def postings(order: Broadcast):
    """Rows (gram, doc_id, n, place) of the prefixes; of equal sets only the first's, as far as a task
    remembers them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, counts = order.value
        seen: set[bytes] = set()
        for batch in _small(batches):
            if len(seen) > SEEN:
                seen.clear()
            grams, ids, sizes, places = [], [], [], []
            for doc_id, found in zip(batch["doc_id"], shingle_sets(_texts(batch))):
                digest = xxhash.xxh3_128_digest(found.tobytes())
                if digest in seen or not len(found):
                    continue
                seen.add(digest)
                first = prefix(found, frequent, counts)
                grams.append(first)
                ids.append(np.full(len(first), doc_id, dtype=np.int64))
                sizes.append(np.full(len(first), len(found), dtype=np.int32))
                places.append(np.arange(len(first), dtype=np.int32))
            if grams:
                yield pd.DataFrame(
                    {
                        "gram": np.concatenate(grams).view(np.int64),
                        "doc_id": np.concatenate(ids),
                        "n": np.concatenate(sizes),
                        "place": np.concatenate(places),
                    }
                )

    return run


def shared_postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of postings sorted by gram those whose gram another row has too."""
    last: pd.DataFrame | None = None
    met = False  # whether the last row has the gram of the one before it
    for batch in batches:
        rows = batch if last is None else pd.concat([last, batch], ignore_index=True)
        if not len(rows):
            continue
        gram = rows["gram"].to_numpy()
        same = gram[1:] == gram[:-1]
        before = np.append(met, same)
        yield rows[:-1][(before | np.append(same, False))[:-1]]
        last, met = rows[-1:], bool(before[-1])
    if last is not None and met:
        yield last


def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of postings (gram, doc_id, n, place, c) with equal grams together: those of shingles whose
    documents are not all of one component, as far as a batch shows it; and, with a partner, each
    document with the one before it and with the first of its gram, if components differ and sizes
    allow a link. Components only merge, so postings that are left out will not matter again.
    """
    last: pd.DataFrame | None = None
    first: pd.DataFrame | None = None  # the first row of the last row's gram
    for batch in batches:
        if not len(batch):
            continue
        carried = [r for r in (first, last) if r is not None]
        rows = pd.concat([*carried, batch], ignore_index=True)
        old = len(carried)
        gram, ids, n, c = (rows[x].to_numpy() for x in ("gram", "doc_id", "n", "c"))
        place = np.arange(len(rows))
        new = np.append(True, gram[1:] != gram[:-1])
        start = np.maximum.accumulate(np.where(new, place, 0))
        starts = np.flatnonzero(new)
        # A shingle that goes on into another batch is kept whatever the components are.
        mixed = np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts)
        mixed[-1] = True
        if old:
            mixed[np.searchsorted(starts, old - 1, "right") - 1] = True
        kept = rows[(np.repeat(mixed, np.diff(np.append(starts, len(rows))))) & (place >= old)]
        yield kept[["gram", "doc_id", "n", "place"]].assign(partner=pd.array([None] * len(kept), dtype="Int64"))
        for other in (np.maximum(place - 1, start), start):
            fits = (place >= old) & (c != c[other]) & (5 * np.minimum(n, n[other]) >= 4 * np.maximum(n, n[other]))
            yield pd.DataFrame({"gram": 0, "doc_id": ids[fits], "n": 0, "place": 0, "partner": pd.array(ids[other[fits]], dtype="Int64")})
        last, first = rows[-1:], rows[start[-1] : start[-1] + 1]


def overlaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of rows (a, b, text_a, text_b: packed texts) that are links, counted in full."""
    unpack = zstandard.ZstdDecompressor()
    last: tuple[int | None, np.ndarray | None] = (None, None)
    for batch in _small(batches):
        rows = []
        for a, b, packed_a, packed_b in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"]):
            if last[0] != a:
                last = (a, next(shingle_sets([unpack.decompress(packed_a)])))
            x, y = last[1], next(shingle_sets([unpack.decompress(packed_b)]))
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                rows.append((a, b))
        yield pd.DataFrame(rows, columns=["a", "b"]).astype("int64")


def packed_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in _small(batches):
        yield pd.DataFrame({"doc_id": batch["doc_id"], "packed": [pack.compress(t) for t in _texts(batch)]})


@F.pandas_udf(LongType())
def _least_differences(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([least_difference(x, y) for x, y in zip(a, b)], dtype="int64")


class _Join:
    """The steps of one join; ``docs`` has non-null, different ids."""

    def __init__(self, docs: DataFrame, parts: int):
        self.docs, self.parts, self.spark = docs, parts, docs.sparkSession
        self.profiles = materialise(docs.mapInPandas(profiles, PROFILE), "profiles")
        self.texts: DataFrame | None = None

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent shingles, MAX_FREQUENT at most. They only set the order."""
        rows = (
            self.docs.mapInPandas(frequent_shingles, "gram long, n long")
            .groupBy("gram")
            .agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "gram")
            .limit(MAX_FREQUENT)
            .toPandas()
        )
        grams = rows["gram"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(grams)
        return grams[order], rows["n"].to_numpy(dtype=np.int64)[order]

    def shared(self) -> DataFrame:
        order = self.spark.sparkContext.broadcast(self.frequent())
        found = self.docs.mapInPandas(postings(order), POSTING)
        dealt = found.repartition(self.parts, "gram").sortWithinPartitions("gram")
        return materialise(dealt.mapInPandas(shared_postings, POSTING), "shared")

    def worded(self, rows: DataFrame) -> DataFrame:
        """The postings with the words of their sets; rows that repeat an id may get those of another
        set of its too, which only adds pairs."""
        words = self.profiles.select("doc_id", F.col("n_shingles").cast("int").alias("n"), *WORDS).distinct()
        return rows.join(words, ["doc_id", "n"])

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b, ..) that the parity bits of their sets don't rule out."""
        p = self.profiles.select("doc_id", "n_shingles", "parity")
        x = p.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("parity").alias("parity_a"))
        y = p.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("parity").alias("parity_b"))
        joined = pairs.join(x, "a").join(y, "b")
        spare = F.col("n_a") + F.col("n_b") - 2 * needed_overlap(F.col("n_a"), F.col("n_b"))
        return joined.where(_least_differences("parity_a", "parity_b") <= spare).select(*pairs.columns)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are links."""
        pairs = materialise(pairs.select("a", "b"), "possible")
        ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        ids = materialise(ids, "wanted")
        if ids.count() <= MAX_BROADCAST:
            ids = F.broadcast(ids)  # else all texts are shuffled to find these
        texts = materialise(
            self.docs.mapInPandas(packed_texts, "doc_id long, packed binary").join(ids, "doc_id", "left_semi"), "texts", compression="none"
        )
        x = texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("text_a"))
        y = texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("text_b"))
        joined = pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b")
        return materialise(joined.mapInPandas(overlaps, PAIR), "found")


def jaccard_components(df: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_copies.

    ``n_copies`` counts the documents with the very same set. Null texts and texts without words
    have no shingles and are linked with nothing. Rows that repeat an id are linked under it and
    each have a row; a row with a null id is linked with nothing and keeps a null component.
    Columns besides doc_id and text are not read.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null")
    join = _Join(known, parts)
    sets = join.profiles.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"))
    copies = join.profiles.join(sets, ["k1", "k2"]).where("n_copies > 1")
    # (node, component) of all documents that have a link so far.
    labels = materialise(copies.select(F.col("doc_id").alias("node"), F.col("first").alias("component")).distinct(), "copies")

    def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
        stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        return materialise(components(stars.unionByName(links)), "components")

    rows = join.shared()
    for round_ in range(ROUNDS):
        # By size at first, then in another order each round, so that others become neighbours.
        order = ["n", "doc_id"] if not round_ else [F.xxhash64("doc_id", F.lit(round_))]
        dealt = _labelled(rows, labels).repartition(parts, "gram").sortWithinPartitions("gram", *order)
        found = materialise(dealt.mapInPandas(met, MET), "met")
        rows = found.where("partner is null").drop("partner")
        pairs = found.where("partner is not null").groupBy(F.col("doc_id").alias("a"), F.col("partner").alias("b")).agg(F.count("*").alias("overlap"))
        # The partners with the highest partial overlaps, two at most, before anything is joined to
        # them: no group is collected or multiplied. What is cut here the last product finds.
        ranked = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("overlap"), "b"))
        pairs = pairs.withColumn("rank", ranked).where(F.col("rank") <= PARTNERS)
        found = join.links(join.possible(pairs))
        if found.isEmpty():
            break
        labels = merged(labels, found)
    labels = merged(labels, join.links(join.possible(_cross_pairs(join.worded(_labelled(rows, labels))))))
    out = join.profiles.join(sets, ["k1", "k2"], "left").join(
        labels.withColumnRenamed("node", "doc_id"), "doc_id", "left"
    ).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
    unknown = docs.where("doc_id is null").mapInPandas(profiles_of_null, "n_shingles long").select(
        F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(1).cast("long").alias("n_copies")
    )
    return out.unionByName(unknown)


def profiles_of_null(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _small(batches):
        yield pd.DataFrame({"n_shingles": [len(s) for s in shingle_sets(_texts(batch))]})


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The postings with the components ``c`` of their documents."""
    found = labels.select(F.col("node").alias("doc_id"), F.col("component").alias("c"))
    if labels.count() <= MAX_BROADCAST // 2:
        found = F.broadcast(found)
    return rows.join(found, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))


def _cross_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of documents of different components that the sizes, the places of a shared shingle and
    the words of parity bits allow."""
    def side(doc: str, place: str) -> DataFrame:
        named = {"doc_id": doc, "n": f"n_{doc}", "place": place, "c": f"c_{doc}"} | {w: f"{w}_{doc}" for w in WORDS}
        return rows.select("gram", *[F.col(x).alias(y) for x, y in named.items()])

    n_a, n_b = F.col("n_a"), F.col("n_b")
    # The smaller set needs a shorter prefix, since its partner is no smaller.
    in_index = F.col("i") <= n_a - F.ceil(n_a * 8 / 9)
    most = F.least("i", "j") + 1 + F.least(n_a - 1 - F.col("i"), n_b - 1 - F.col("j"))
    unlike = reduce(add, [F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in WORDS])
    fits = (F.col("c_a") != F.col("c_b")) & (
        (n_a < n_b) | ((n_a == n_b) & (F.col("a") < F.col("b")))
    ) & (n_a * 5 >= n_b * 4) & in_index & (most >= needed_overlap(n_a, n_b)) & (unlike <= n_a + n_b - 2 * needed_overlap(n_a, n_b))
    return side("a", "i").join(side("b", "j"), "gram").where(fits).groupBy("a", "b").agg(F.count("*").alias("overlap"))
