"""Histograms, box summaries and density curves."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.operators.quantiles import (
    ACCURACY,
    _join_on,
    aggregate_with_quantiles,
    quantile_column,
)
from paceframe.session import materialise
from paceframe.sources.readers import rows

# Fixed values of the density curve: Silverman's rule, and evaluation points per bandwidth.
SILVERMAN = 1.059
NORMAL_IQR = 1.349
STEPS_PER_BANDWIDTH = 3
# Points of a drawn density curve at most, parts of the values that a long-tailed grid is dealt out to, cells
# of a bandwidth, power sums of a cell, and bandwidths beyond which a value adds nothing.
GRID = 512
SEGMENTS = 32
CELLS_PER_BANDWIDTH = 4
POWERS = 9
REACH = 10


def _range(df: DataFrame, metric: str) -> Column:
    return df.agg(
        F.struct(F.min(metric).cast("double").alias("lo"), F.max(metric).cast("double").alias("hi")).alias("r")
    ).scalar()


def _bin_of(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin from 0; the last one is closed, a constant column has bin 0 only."""
    raw = F.floor((value - lo) / (hi - lo) * bins)
    return F.when(hi > lo, F.least(raw, F.lit(bins - 1).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


def _binned(df: DataFrame, metric: str, bins: int) -> DataFrame:
    value = F.col(metric).cast("double")
    return (
        df.where(F.col(metric).isNotNull())
        .withColumn("_r", _range(df, metric))
        .groupBy(_bin_of(value, F.col("_r.lo"), F.col("_r.hi"), bins).alias("bin"))
        .agg(F.count("*").alias("num_records"))
    )


def histogram(df: DataFrame, metric: str, bins: int) -> DataFrame:
    """Rows per equal-width bin over [min, max], empty bins included."""
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin").withColumn("_r", _range(df, metric))
    # A constant column has a single bin.
    every = every.where((F.col("_r.hi") > F.col("_r.lo")) | (F.col("bin") == 0))
    width = (F.col("_r.hi") - F.col("_r.lo")) / bins
    return every.join(_binned(df, metric, bins), "bin", "left").select(
        "bin",
        (F.col("_r.lo") + width * F.col("bin")).alias("bin_low"),
        F.when(F.col("bin") == bins - 1, F.col("_r.hi"))
        .otherwise(F.col("_r.lo") + width * (F.col("bin") + 1))
        .alias("bin_high"),
        F.coalesce("num_records", F.lit(0)).cast("bigint").alias("num_records"),
    )


def box_summary(
    df: DataFrame, metric: str, by: Sequence[str] = (), accuracy: int = ACCURACY
) -> DataFrame:
    """Extremes, quartiles and whisker ends (last values inside 1.5 IQR of the box)."""
    value = F.col(metric).cast("double")
    aggs = [F.min(metric).cast("double").alias("low"), F.max(metric).cast("double").alias("high")]
    q = F.col(quantile_column(metric))
    figures = (
        aggregate_with_quantiles(df, (metric,), (0.25, 0.5, 0.75), by, aggs, accuracy)
        .select(*by, "low", "high", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"))
        .withColumns(
            {
                "fence_low": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
                "fence_high": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")),
            }
        )
    )
    names = ("low", "q1", "median", "q3", "high", "fence_low", "fence_high")
    if by:
        # Written out first: the join below then knows how small (or big) the table is.
        bounded = _join_on(df.select(*by, metric), materialise(figures, "box"), by)
    else:
        bounded = df.select(metric).withColumn("_f", figures.select(F.struct(*names).alias("f")).scalar())
        bounded = bounded.select(metric, "_f.*")
    inside = F.when(value.between(F.col("fence_low"), F.col("fence_high")), value)
    return bounded.groupBy(*by, *names).agg(
        F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high")
    ).drop("fence_low", "fence_high")


def density_curve(df: DataFrame, metric: str, accuracy: int = ACCURACY, even: bool = False) -> DataFrame:
    """Gaussian kernel density on a grid of at most GRID points, as drawn by a violin plot.

    The bandwidth follows Silverman's rule with the smaller of standard deviation and scaled IQR.
    The grid spans two bandwidths beyond the extremes in steps of a third of a bandwidth. Where
    that takes too many points, as on a long tail, as many points lie between each two of 33
    quantiles, so that they are dense where the values are. With ``even`` the steps stay a third of
    a bandwidth however many points that takes.

    Values enter through cells of a quarter of a bandwidth. A cell has the power sums of its values'
    distances from its middle, and the kernel's expansion in Hermite polynomials gives their sum at
    any point. With nine sums and distances up to an eighth of a bandwidth the error is below 1e-10
    of the kernel's height; cells more than ten bandwidths away add less than that and are left out.
    No rows without at least two different values, or with infinite ones.
    """
    shares = [i / SEGMENTS for i in range(SEGMENTS + 1)]
    aggs = [
        F.count(metric).alias("n"),
        F.stddev_samp(metric).alias("sd"),
        F.min(metric).cast("double").alias("lo"),
        F.max(metric).cast("double").alias("hi"),
    ]
    found = aggregate_with_quantiles(df, (metric,), shares, (), aggs, accuracy).first()
    n, lo, hi, knots = found["n"], found["lo"], found["hi"], found[quantile_column(metric)]
    schema = "point bigint, x double, density double"
    if n < 2 or not math.isfinite(hi - lo):
        return rows(df.sparkSession, [], schema)
    spread = min(found["sd"], (knots[SEGMENTS * 3 // 4] - knots[SEGMENTS // 4]) / NORMAL_IQR)
    bw = SILVERMAN * spread * n**-0.2
    if not bw > 0:
        return rows(df.sparkSession, [], schema)
    points = _grid(df.sparkSession, lo, hi, bw, knots, even)
    width = bw / CELLS_PER_BANDWIDTH
    reach = REACH * CELLS_PER_BANDWIDTH

    def whole(c: Column) -> Column:
        """Rounded down, as a double: a tail may be more cells long than an integer holds."""
        return c - F.pmod(c, F.lit(1.0))

    value = F.col(metric).cast("double")
    placed = df.where(value.isNotNull() & ~F.isnan(value)).select(value.alias("v"))
    placed = placed.withColumn("cell", whole((F.col("v") - lo) / width))
    placed = placed.select("cell", ((F.col("v") - (lo + (F.col("cell") + 0.5) * width)) / bw).alias("d"))
    sums = [F.sum(F.pow("d", F.lit(float(m)))).alias(f"s{m}") if m else F.count("*").cast("double").alias("s0") for m in range(POWERS)]
    cells = placed.groupBy("cell").agg(*sums).withColumn("block", whole(F.col("cell") / reach))

    # A point meets the cells of its own block and of the two beside it.
    block = whole((F.col("x") - lo) / (width * reach))
    near = points.withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    u = (F.col("x") - (lo + (F.col("cell") + 0.5) * width)) / bw
    series = F.lit(0.0)
    for m, polynomial in enumerate(_hermite(POWERS)):
        term = F.lit(0.0)
        for c in reversed(polynomial):
            term = term * F.col("u") + c
        series = series + term / math.factorial(m) * F.col(f"s{m}")
    met = cells.join(near, "block").withColumn("u", u).withColumn("share", F.exp(-0.5 * F.col("u") * F.col("u")) * series)
    total = met.groupBy("point").agg(F.sum("share").alias("total"))
    norm = n * bw * math.sqrt(2 * math.pi)
    return points.join(total, "point", "left").select(
        "point", "x", (F.coalesce("total", F.lit(0.0)) / norm).alias("density")
    )


def _grid(spark: SparkSession, lo: float, hi: float, bw: float, knots: Sequence[float], even: bool) -> DataFrame:
    start, span = lo - 2 * bw, hi - lo + 4 * bw
    steps = span / (bw / STEPS_PER_BANDWIDTH)
    if even or steps <= GRID - 1:
        count = math.ceil(steps)
        numbers = spark.range(count + 1).withColumnRenamed("id", "point")
        return numbers.withColumn("x", F.lit(start) + F.col("point") * F.lit(span / count))
    ends = [start, *knots[1:-1], start + span]
    each = (GRID - 1) // SEGMENTS
    inner = [a + (b - a) * k / each for a, b in zip(ends, ends[1:]) if b > a for k in range(each)]
    return rows(spark, list(enumerate([*inner, ends[-1]])), "point bigint, x double")


def _hermite(count: int) -> list[list[float]]:
    """Coefficients of the first polynomials for the weight exp(-u**2 / 2), lowest power first."""
    found = [[1.0], [0.0, 1.0]]
    while len(found) < count:
        m = len(found) - 1
        raised = [0.0, *found[m]]
        for k, c in enumerate(found[m - 1]):
            raised[k] -= m * c
        found.append(raised)
    return found[:count]
