"""Hard negatives: for anchors and their nearest rows of the same label, the best rows of other labels
whose score lies in a range below that of the positive.

Searches prune by length and by coordinates, as LEMP does for large entries of matrix products.
Rows are dealt into runs by descending length, and anchors into groups; a cell of run and group is
one task's work. In a cell the run is cut into buckets of like length. A score that an anchor still
needs, divided by both lengths, bounds the cosine from below, and the cosine bounds each coordinate
of a unit vector: for the anchor's largest coordinates, the focus, the rows in the feasible range
are a slice of the bucket's sorted list of that coordinate. Only rows in all slices are verified, by
exact integer products. Where a slice would hold most of the bucket, all of it is verified at once,
as a block. What is needed rises from bucket to bucket as better rows are found.

Scores are exact: they are computed in floating point only where the product of the lengths shows
that every partial sum is an integer it holds, and else with Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceframe.session import materialise

SCALE = 256
# Rows of a run, anchors of a group: a task holds one of each. More make less to shuffle.
RUN = 8192
GROUP = 8192
# Rows of a bucket, anchors that are searched together in it, and coordinates of the focus.
BUCKET = 1024
CHUNK = 512
FOCUS = 3
# Buckets are verified whole where the shortest slice holds more than this share of their rows.
DENSE = 0.5
# Bounds are widened by so much, far more than rounding can amount to.
SLACK = 1e-9

LARGEST = 1e300
LIMITS = (-(1 << 63), (1 << 63) - 1)
VECTORS = "vec_id long, label int, length double, q binary"
FOUND = "anchor long, want int, score long, vec_id long"


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels, lengths, found = [], [], [], []
        columns = [batch.column(k) for k in ("vec_id", "label", "embedding")]
        for vec_id, label, vector in zip(*columns):
            with np.errstate(over="ignore"):
                q = np.floor(SCALE * np.array(vector.as_py(), dtype=np.float64)) + 0.0
            if not np.isfinite(q).all():
                continue
            ids.append(vec_id.as_py())
            labels.append(label.as_py())
            largest = np.abs(q).max(initial=0.0)
            lengths.append(float(largest * np.sqrt(np.square(q / largest).sum())) if largest else 0.0)
            found.append(q.astype("<f4" if largest <= 1 << 24 else "<f8").tobytes() + bytes([4 if largest <= 1 << 24 else 8]))
        made = [pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(lengths, pa.float64()), pa.array(found, pa.binary())]
        yield pa.RecordBatch.from_arrays(made, names=["vec_id", "label", "length", "q"])


def quantised(df: DataFrame) -> DataFrame:
    """(vec_id, label, length, q) of the rows that take part: each component becomes floor(256 * x).

    Rows with a null id, label or vector take no part, nor do those with a component that is null
    or not finite, or isn't finite times 256. Rows that are equal in all three count once. The last
    byte of ``q`` is the size of its numbers: four bytes hold integers up to 2 ** 24.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(_quantise, VECTORS).distinct()


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows; shorter ones end in zeros."""
    found = [np.frombuffer(v[:-1], f"<f{v[-1]}") for v in column.to_pylist()]
    out = np.zeros((len(found), max(map(len, found), default=0)))
    for row, vector in zip(out, found):
        row[: len(vector)] = vector
    return out


def _exact(vectors: np.ndarray, bound: float) -> np.ndarray:
    """Vectors in a type in which all sums up to ``bound`` are exact."""
    if bound < 1 << 24:
        return vectors.astype(np.float32)
    if bound < 1 << 53:
        return vectors
    whole = np.empty(vectors.shape, dtype=object)
    whole.ravel()[:] = [int(x) for x in vectors.ravel()]
    return whole


class Bucket:
    """Rows of like length, with lists of their unit coordinates in ascending order."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, lengths: np.ndarray, vectors: np.ndarray, exact: np.ndarray):
        self.ids, self.labels, self.lengths, self.vectors, self.exact = ids, labels, lengths, vectors, exact
        self.longest = float(lengths.max())

    @cached_property
    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and values of every coordinate, in the order of the values."""
        unit = (self.vectors / np.where(self.lengths > 0, self.lengths, 1.0)[:, None]).T
        order = np.argsort(unit, axis=1)
        return order, np.take_along_axis(unit, order, axis=1)

    def slices(self, focus: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the slice of each focus coordinate with values from low to high."""
        begin, end = np.empty_like(focus), np.empty_like(focus)
        values = self.lists[1]
        for f in np.unique(focus):
            at = focus == f
            begin[at] = np.searchsorted(values[f], low[at], "left")
            end[at] = np.searchsorted(values[f], high[at], "right")
        return begin, end


class Anchors(NamedTuple):
    """Anchors with what they want: a row a want, of scores from ``low`` to ``high``."""

    ids: np.ndarray
    labels: np.ndarray
    lengths: np.ndarray
    vectors: np.ndarray
    exact: np.ndarray
    low: np.ndarray
    high: np.ndarray


def candidates(anchors: Anchors, bucket: Bucket, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score) of all pairs with a score of ``need`` or more, by chunks of anchors."""
    floats = need if need.dtype != object else np.array([float(min(max(x, -LARGEST), LARGEST)) for x in need])
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        cosine = floats / (anchors.lengths * bucket.longest)
    cosine = np.where(np.isnan(cosine), -np.inf, cosine) - SLACK
    width = anchors.vectors.shape[1]
    bounded = (cosine > 0) & (width > 0)
    whole = ~bounded
    slices = {}
    live = np.flatnonzero(bounded & (cosine <= 1))
    if len(live):
        unit = anchors.vectors[live] / anchors.lengths[live, None]
        focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
        x, t = np.take_along_axis(unit, focus, axis=1), cosine[live, None]
        # The ends of a coordinate on the cap of unit vectors around the anchor.
        spread = np.sqrt(np.maximum((1 - t * t) * (1 - x * x), 0))
        low = np.where(-x >= t, -1.0, x * t - spread) - SLACK
        high = np.where(x >= t, 1.0, x * t + spread) + SLACK
        begin, end = bucket.slices(focus, low, high)
        shortest = (end - begin).min(axis=1)
        whole[live] = shortest > DENSE * len(bucket.ids)
        for k in np.flatnonzero((shortest > 0) & ~whole[live]):
            slices[int(live[k])] = (focus[k], begin[k], end[k])
    dense = np.flatnonzero(whole)
    for at in range(0, len(dense), CHUNK):
        chosen = dense[at : at + CHUNK]
        scores = anchors.exact[chosen] @ bucket.exact.T
        a, r = np.nonzero(scores >= need[chosen, None])
        yield chosen[a], r, scores[a, r]
    order = bucket.lists[0] if slices else None
    for a, (focus, begin, end) in slices.items():
        met = np.zeros(len(bucket.ids), dtype=np.int8)
        for f, b, e in zip(focus, begin, end):
            met[order[f, b:e]] += 1
        r = np.flatnonzero(met == len(focus))
        scores = bucket.exact[r] @ anchors.exact[a]
        good = scores >= need[a]
        yield np.full(good.sum(), a), r[good], scores[good]


def _numbers(values: np.ndarray) -> np.ndarray:
    """Scores, or their ranks if they are Python's integers, which can't be sorted by several keys."""
    return np.unique(values, return_inverse=True)[1] if values.dtype == object else values


def search(anchors: Anchors, buckets: list[Bucket], same: bool, keep: int) -> tuple[np.ndarray, ...]:
    """(anchor, want, score, id) of the best ``keep`` rows of every want; ties by the smaller id.

    ``same`` looks for rows of the anchor's label, else for those of other labels; rows with the
    anchor's own id are left out.
    """
    count, wants = anchors.low.shape
    kind = anchors.low.dtype
    key, score, ident = np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64)
    need = anchors.low.copy()
    open_wants = anchors.low <= anchors.high
    for bucket in buckets:
        least = np.where(open_wants, need, np.array(np.inf, dtype=kind)).min(axis=1) if wants else need
        keys, scores, ids = [key], [score], [ident]
        for a, r, s in candidates(anchors, bucket, least):
            fits = ((bucket.labels[r] == anchors.labels[a]) == same) & (bucket.ids[r] != anchors.ids[a])
            a, r, s = a[fits], r[fits], s[fits].astype(kind)
            for w in range(wants):
                good = open_wants[a, w] & (s >= need[a, w]) & (s <= anchors.high[a, w])
                keys.append(a[good] * wants + w)
                scores.append(s[good])
                ids.append(bucket.ids[r[good]])
        if len(keys) == 1:
            continue
        key, score, ident = map(np.concatenate, (keys, scores, ids))
        order = np.lexsort((ident, -_numbers(score), key))
        key, score, ident = key[order], score[order], ident[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        place = np.arange(len(key)) - np.repeat(heads, np.diff(heads, append=len(key)))
        key, score, ident, place = (x[place < keep] for x in (key, score, ident, place))
        full = np.flatnonzero(place == keep - 1)
        need[key[full] // wants, key[full] % wants] = score[full]
    return key // max(wants, 1), key % max(wants, 1), score, ident


def _buckets(rows: pa.Table, vectors: np.ndarray, exact: np.ndarray, lengths: np.ndarray) -> list[Bucket]:
    ids, labels = (rows.column(k).to_numpy() for k in ("vec_id", "label"))
    order = np.argsort(-lengths, kind="stable")
    parts = [order[at : at + BUCKET] for at in range(0, len(order), BUCKET)]
    return [Bucket(ids[p], labels[p], lengths[p], vectors[p], exact[p]) for p in parts]


def _cell(same: bool, keep: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        schema = pa.schema([("anchor", pa.int64()), ("want", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])
        if not len(anchors) or not len(rows):
            return schema.empty_table()
        a, r = _vectors(anchors.column("q")), _vectors(rows.column("q"))
        width = max(a.shape[1], r.shape[1])
        a, r = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (a, r))
        a_lengths, r_lengths = (t.column("length").to_numpy() for t in (anchors, rows))
        with np.errstate(over="ignore"):
            bound = a_lengths.max() * r_lengths.max() * (1 + SLACK)
        bound = bound if np.isfinite(bound) else np.inf
        kind = object if bound >= 1 << 53 else np.float64
        wants = anchors.column("wants").to_pylist()
        # Ends of the ranges as integers; a want without an end takes any score.
        low, high = np.empty((len(wants), len(wants[0])), dtype=kind), np.empty((len(wants), len(wants[0])), dtype=kind)
        for k, ranges in enumerate(wants):
            low[k], high[k] = zip(*[(-np.inf, np.inf) if w is None else (w["low"], w["high"]) for w in ranges])
        found = Anchors(anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), a_lengths, a, _exact(a, bound), low, high)
        at, want, score, ident = search(found, _buckets(rows, r, _exact(r, bound), r_lengths), same, keep)
        scores = [min(max(int(s), LIMITS[0]), LIMITS[1]) for s in score]
        numbers = anchors.column("anchor").to_numpy()[at]
        return pa.Table.from_arrays([pa.array(numbers), pa.array(want, pa.int32()), pa.array(scores, pa.int64()), pa.array(ident)], schema=schema)

    return run


def _best(cells: DataFrame, keep: int) -> DataFrame:
    """The best of what the cells found; ``place`` counts from 1."""
    order = Window.partitionBy("anchor", "want").orderBy(F.desc("score"), "vec_id")
    return cells.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def _searched(anchors: DataFrame, rows: DataFrame, runs: int, groups: int, same: bool, keep: int) -> DataFrame:
    """Every group of anchors meets every run of rows in a cell of its own."""
    each_run = F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")
    each_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp")
    left = anchors.select("*", each_run).groupBy("grp", "run")
    right = rows.select("vec_id", "label", "length", "q", "run", each_group).groupBy("grp", "run")
    return _best(left.cogroup(right).applyInArrow(_cell(same, keep), FOUND), keep)


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    run_rows: int = RUN,
    group_rows: int = GROUP,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``df`` has vec_id, label and embedding; ``is_anchor`` is a condition on vec_id and label. An
    anchor's positives are its first rows of the same label, by descending score and then by id;
    negatives are the first rows of other labels with ``low`` to ``high`` percent of the positive's
    score. :func:`quantised` says which rows take part. Vectors of different length are compared as
    if the shorter one ended in zeros. Rows that share an id but not all else are rows of their own;
    none is a positive or negative of an anchor with its id. A negative positive score leaves no
    range, so nothing is returned for it. Scores beyond 64 bits are returned as the nearest bound.
    Extra columns are ignored, and an empty table gives no rows.

    Every anchor meets every row: the work grows with their product, less what the bounds prune.
    Memory of a task is that of ``run_rows`` rows and ``group_rows`` anchors.
    """
    prepared = materialise(quantised(df), "vectors")
    total, n_anchors = prepared.agg(F.count("*"), F.coalesce(F.count_if(is_anchor), F.lit(0))).first()
    runs, groups = max(1, -(-total // run_rows)), max(1, -(-n_anchors // group_rows))
    # Equal lengths are split by id, so that no run is larger than the others.
    dealt = prepared.repartitionByRange(runs, F.desc("length"), "vec_id")
    rows = materialise(dealt.withColumn("run", F.spark_partition_id()), "runs")
    numbered = rows.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id())
    anchors = materialise(numbered.withColumn("grp", F.pmod(F.xxhash64("vec_id", "q"), F.lit(groups)).cast("int")).drop("run"), "anchors")

    kind = "array<struct<low: long, high: long>>"
    first = anchors.withColumn("wants", F.array(F.lit(None).cast("struct<low: long, high: long>")).cast(kind))
    near = materialise(_searched(first, rows, runs, groups, True, positives), "positives")
    near = near.select("anchor", (F.col("place") - 1).alias("want"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    # Percentages of a score in integers: the quotient down or up, without the product in 64 bits.
    def percent(share: int, up: bool) -> Column:
        exact = F.col("positive_score").cast("decimal(19,0)") * share / 100
        return (F.ceil(exact) if up else F.floor(exact)).cast("long")

    ranges = near.withColumns({"low": percent(low, True), "high": percent(high, False)})
    listed = F.sort_array(F.collect_list(F.struct("want", "low", "high")))
    wanted = ranges.groupBy("anchor").agg(F.transform(listed, lambda w: F.struct(w["low"], w["high"])).cast(kind).alias("wants"))
    # An anchor with fewer positives gets ranges without any integer in them.
    empty = F.array_repeat(F.struct(F.lit(1).cast("long").alias("low"), F.lit(0).cast("long").alias("high")), positives)
    wanted = wanted.withColumn("wants", F.slice(F.concat("wants", empty), 1, positives))
    found = _searched(anchors.join(wanted, "anchor"), rows, runs, groups, False, negatives)
    names = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    result = found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score", "place": "rank"})
    return result.join(near, ["anchor", "want"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
