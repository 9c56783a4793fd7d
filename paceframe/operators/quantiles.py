"""Exact quantiles (linear interpolation) in two scans, without gathering a group in one task.

Spark's ``percentile`` keeps a map of all distinct values of a group in one reducer. Here the first
scan makes mergeable sketches of bounded rank error, whose values bracket every wanted rank. The
second scan counts the rows between the brackets and keeps the distinct values in them, with their
numbers of rows, merged map-side. That small share of the table is put in order by ranges, a running
count over the ranges gives the rank of every kept value, and the wanted ones are picked. Values are
only compared, so infinite ones are like others. The counts show whether a bracket missed its rank;
then, and only then, the second scan is repeated with wider ones, so the result is exact anyway.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceframe.session import materialise
from paceframe.sources.readers import rows

# Size of a sketch, from 8 on. Its rank error, as a share of the rows, falls with the size by a law
# whose two constants are those published with the sketch; a bracket is some errors wide on each side.
ACCURACY = 4096
ERROR_SCALE, ERROR_POWER = 2.296, 0.9021
ERRORS = 2.0
WIDER = 16

def quantile_column(metric: str) -> str:
    """Name of the array column that holds the quantiles of ``metric``."""
    return f"{metric}__q"


def aggregate_with_quantiles(
    df: DataFrame,
    metrics: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    aggs: Sequence[Column] = (),
    accuracy: int = ACCURACY,
) -> DataFrame:
    """``aggs`` per group of ``by``, plus one array of quantiles per metric.

    The two kinds of figures come from separate aggregations: beside sketches the plain ones
    would lose their generated code.
    """
    wide = _by_group(df, metrics, probs, by, accuracy) if by else _whole_table(df, metrics, probs, accuracy)
    if not aggs:
        return wide
    base = df.groupBy(*by).agg(*aggs)
    if by:
        return _join_on(base, wide, by, "left")
    one_row = wide.select(F.struct(*wide.columns).alias("q")).scalar()
    return base.withColumn("_q", one_row).select(
        *base.columns, *[F.col("_q")[quantile_column(m)].alias(quantile_column(m)) for m in metrics]
    )


def quantile_rows(
    df: DataFrame,
    metrics: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group, metric and probability."""
    wide = aggregate_with_quantiles(df, metrics, probs, by, accuracy=accuracy)
    cells = [
        F.struct(
            F.lit(m).alias("metric"),
            F.lit(float(p)).alias("prob"),
            F.col(quantile_column(m))[i].alias("value"),
        )
        for m in metrics
        for i, p in enumerate(probs)
    ]
    return wide.select(*by, F.explode(F.array(*cells)).alias("cell")).select(*by, "cell.*")


def _join_on(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``by`` with null keys matching each other."""
    renamed = right.withColumnsRenamed({b: f"_r_{b}" for b in by})
    condition = F.lit(True)
    for b in by:
        condition = condition & left[b].eqNullSafe(renamed[f"_r_{b}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{b}" for b in by])


def _metric_column(number: int) -> str:
    return f"_m{number}"


def _values(df: DataFrame, metrics: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The metrics as doubles, NaN as null."""
    doubles = [F.col(m).cast("double") for m in metrics]
    named = [F.when(~F.isnan(v), v).alias(_metric_column(i)) for i, v in enumerate(doubles)]
    return df.select(*by, *named)


def _sketches(values: DataFrame, count: int, by: Sequence[str], ends: Sequence[float], accuracy: int) -> DataFrame:
    """Per group and metric the number of values, and those near the shares ``ends`` of the ranks."""
    figures, found = [], []
    wanted = F.array(*[F.lit(e) for e in ends])
    for i in range(count):
        v = _metric_column(i)
        figures += [F.count(v).alias(f"{v}_n"), F.kll_sketch_agg_double(v, accuracy).alias(f"{v}_s")]
        # An empty sketch has no quantiles.
        found += [F.col(f"{v}_n"), F.when(F.col(f"{v}_n") > 0, F.kll_sketch_get_quantile_double(f"{v}_s", wanted)).alias(f"{v}_e")]
    return values.groupBy(*by).agg(*figures).select(*by, *found)


def _cells(bracketed: DataFrame, count: int, by: Sequence[str], low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Rows per group, metric, place and, inside a bracket, value.

    Every row has the sketched ends of its group as ``_ends``. ``low`` and ``high`` are the shares of the ends;
    a bracket is open where its share is beyond 0 or 1. ``place`` is the number of ends below a
    value, so it rises with the values; inside a bracket more begin than end.
    """
    # One short piece of code for all metrics: the compiler leaves long methods interpreted.
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("metric_no"), F.col(_metric_column(i)).alias("v")) for i in range(count)]))
    long = bracketed.select(*by, "_ends", each.alias("cell")).select(*by, "_ends", "cell.*").where(F.col("v").isNotNull())
    v, ends = F.col("v"), F.col("_ends")[F.col("metric_no")]
    begun = [F.lit(1) if low[k] <= 0 else (v >= ends[k]).cast("int") for k in range(len(low))]
    over = [F.lit(0) if high[k] >= 1 else (v > ends[len(low) + k]).cast("int") for k in range(len(high))]
    placed = long.withColumns({"begun": reduce(add, begun), "over": reduce(add, over)})
    kept = F.when(F.col("begun") > F.col("over"), v)
    cells = placed.select(*by, "metric_no", (F.col("begun") + F.col("over")).alias("place"), kept.alias("v"))
    return cells.groupBy(*by, "metric_no", "place", "v").agg(F.count("*").alias("n"))


def _ranked(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """The kept values with the ranks they hold: from ``upto - n`` to before ``upto``.

    Ranges are counted apart, so no task has all values of a group.
    """
    ordered = cells.repartitionByRange("metric_no", *by, "place", "v").withColumn("part", F.spark_partition_id())
    ordered = materialise(ordered, "quantile_order")
    group = [*by, "metric_no"]
    parts = ordered.groupBy(*group, "part").agg(F.sum("n").alias("part_n"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("before", F.coalesce(F.sum("part_n").over(earlier), F.lit(0))).drop("part_n")
    here = Window.partitionBy(*group, "part").orderBy("place", "v").rowsBetween(Window.unboundedPreceding, 0)
    running = ordered.withColumn("here", F.sum("n").over(here))
    counted = _join_on(running, before, [*group, "part"]).withColumn("upto", F.col("before") + F.col("here"))
    return counted.where(F.col("v").isNotNull()).select(*group, "v", "n", "upto")


def _ends(accuracy: int, probs: Sequence[float], widened: int) -> tuple[list[float], list[float]]:
    """Shares of the ranks where the brackets of ``probs`` begin and end."""
    margin = ERRORS * ERROR_SCALE / accuracy**ERROR_POWER * WIDER**widened
    return [p - margin for p in probs], [p + margin for p in probs]


def _within(shares: Sequence[float]) -> list[float]:
    return [min(1.0, max(0.0, s)) for s in shares]


def _whole_table(df: DataFrame, metrics: Sequence[str], probs: Sequence[float], accuracy: int) -> DataFrame:
    """One row with an array of quantiles per metric. What the scans leave, a few figures a metric and
    probability, passes through the driver."""
    spark, values, found, widened = df.sparkSession, _values(df, metrics, ()), None, 0
    while found is None:
        low, high = _ends(accuracy, probs, widened)
        sketch = _sketches(values, len(metrics), (), _within([*low, *high]), accuracy).first()
        counts = [sketch[f"{_metric_column(i)}_n"] for i in range(len(metrics))]
        positions = {(i, k): p * (n - 1) for i, n in enumerate(counts) if n for k, p in enumerate(probs)}
        wanted = {(i, rank) for (i, _), pos in positions.items() for rank in (math.floor(pos), math.ceil(pos))}
        ends = rows(spark, [([sketch[f"{_metric_column(i)}_e"] for i in range(len(metrics))],)], "e array<array<double>>")
        cells = _cells(values.withColumn("_ends", ends.scalar()), len(metrics), (), low, high)
        ranks = rows(spark, sorted(wanted), "metric_no int, rank bigint")
        held = _picked(_ranked(materialise(cells, "quantile_cells"), ()), ranks, ()).collect()
        found = {(r["metric_no"], r["rank"]): r["v"] for r in held} if len(held) == len(wanted) else None
        widened += 1

    def at(i: int, pos: float) -> float:
        below, above = math.floor(pos), math.ceil(pos)
        low_value, high_value = found[i, below], found[i, above]
        return low_value if below == above else (above - pos) * low_value + (pos - below) * high_value

    wide = [[at(i, positions[i, k]) for k in range(len(probs))] if counts[i] else None for i in range(len(metrics))]
    return rows(spark, [tuple(wide)], ", ".join(f"`{quantile_column(m)}` array<double>" for m in metrics))


def _picked(ranked: DataFrame, ranks: DataFrame, by: Sequence[str]) -> DataFrame:
    """The values that hold the wanted ranks."""
    held = _join_on(ranked, ranks, [*by, "metric_no"])
    return held.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))).select(
        *by, "metric_no", "rank", "v"
    )


def _by_group(
    df: DataFrame, metrics: Sequence[str], probs: Sequence[float], by: Sequence[str], accuracy: int
) -> DataFrame:
    """The same for every group. Their number is open, so the figures stay in tables."""
    values, found, widened = _values(df, metrics, by), None, 0
    while found is None:
        low, high = _ends(accuracy, probs, widened)
        sketches = _sketches(values, len(metrics), by, _within([*low, *high]), accuracy)
        sketches = materialise(sketches, "quantile_sketches")
        wanted = _wanted(sketches, metrics, probs, by)
        ends_of = sketches.select(*by, F.array(*[f"{_metric_column(i)}_e" for i in range(len(metrics))]).alias("_ends"))
        cells = _cells(_join_on(values, ends_of, by), len(metrics), by, low, high)
        ranks = wanted.select(*by, "metric_no", F.explode(F.array("below_pos", "above_pos")).alias("rank")).distinct()
        exact = materialise(_picked(_ranked(materialise(cells, "quantile_cells"), by), ranks, by), "quantile_values")
        found = exact if exact.count() == ranks.count() else None
        widened += 1

    low_values = found.withColumnsRenamed({"rank": "below_pos", "v": "low_value"})
    high_values = found.withColumnsRenamed({"rank": "above_pos", "v": "high_value"})
    paired = _join_on(wanted, low_values, [*by, "metric_no", "below_pos"])
    paired = _join_on(paired, high_values, [*by, "metric_no", "above_pos"])
    value = F.when(F.col("below_pos") == F.col("above_pos"), F.col("low_value")).otherwise(
        (F.col("above_pos") - F.col("pos")) * F.col("low_value")
        + (F.col("pos") - F.col("below_pos")) * F.col("high_value")
    )
    pair = F.struct("prob_no", value.alias("value"))
    each = paired.groupBy(*by, "metric_no").agg(
        F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["value"]).alias("values")
    )
    return each.groupBy(*by).agg(
        *[F.max(F.when(F.col("metric_no") == i, F.col("values"))).alias(quantile_column(m)) for i, m in enumerate(metrics)]
    )


def _wanted(sketches: DataFrame, metrics: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """The position of every quantile among the ordered values, and the ranks beside it."""
    cells = [
        F.struct(
            F.lit(i).alias("metric_no"),
            F.lit(k).alias("prob_no"),
            (F.lit(float(p)) * (F.col(f"{_metric_column(i)}_n") - 1)).alias("pos"),
            F.col(f"{_metric_column(i)}_n").alias("rows"),
        )
        for i in range(len(metrics))
        for k, p in enumerate(probs)
    ]
    wanted = sketches.select(*by, F.explode(F.array(*cells)).alias("w")).select(*by, "w.*").where(F.col("rows") > 0)
    return wanted.drop("rows").withColumns({"below_pos": F.floor("pos"), "above_pos": F.ceil("pos")})
