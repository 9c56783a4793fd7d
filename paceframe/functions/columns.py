"""Column expressions: dates, ratios, labels, formats. All of them stay inside codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe.schemas import GOOD_SLEEP_HOURS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c: Column | str, strict: bool = True) -> Column:
    """Text to date. Malformed text raises, or gives null when not ``strict``."""
    return F.to_date(_col(c), "yyyy-MM-dd") if strict else F.try_to_date(_col(c), "yyyy-MM-dd")


def parse_timestamp(c: Column | str, strict: bool = True) -> Column:
    """Text to timestamp in the session zone. Malformed text raises, or gives null."""
    return F.to_timestamp(_col(c)) if strict else F.try_to_timestamp(_col(c))


def day_of_week(c: Column | str) -> Column:
    return F.date_format(_col(c), "E")


def month_period(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


def guarded_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient where the denominator is positive, otherwise 0."""
    den = _col(denominator)
    return F.when(den > 0, _col(numerator) / den).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent; null for an empty whole."""
    return F.when(whole > 0, part / whole * 100.0)


def tier(value: Column | str, ladder: Iterable[tuple[float | None, str]]) -> Column:
    """Name of the first rung whose bound lies above ``value``; null stays null."""
    v = _col(value)
    named = F.when(v.isNull(), F.lit(None).cast("string"))
    for bound, name in ladder:
        named = named.otherwise(name) if bound is None else named.when(v < bound, name)
    return named


def sleep_quality(mean_hours: Column | str) -> Column:
    return F.when(_col(mean_hours) >= GOOD_SLEEP_HOURS, "Good").otherwise("Needs Improvement")


def label_text(c: Column | str) -> Column:
    """``heart_rate_avg`` to ``Heart Rate Avg``."""
    return F.initcap(F.replace(_col(c), F.lit("_"), F.lit(" ")))


def preview_text(c: Column | str, width: int = 50) -> Column:
    return F.substring(_col(c).cast("string"), 1, width)


def thousands(c: Column | str, digits: int = 0) -> Column:
    return F.format_number(_col(c), digits)


def percent_text(c: Column | str, digits: int = 2) -> Column:
    return F.concat(F.format_number(_col(c), digits), F.lit("%"))


def missing(c: str, data_type: T.DataType) -> Column:
    """Null test that also counts NaN of floating-point columns."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.col(c).isNull() | F.isnan(c)
    return F.col(c).isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating-point NaN becomes null, so that aggregates skip it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def hash_unit(keys: Iterable[Column | str], seed: int) -> Column:
    """A number in [0, 1) from 53 bits of a fast hash of the key values and the seed."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[_col(k) for k in keys]), 11)
    return bits / F.lit(float(1 << 53))


def digest_unit(keys: Iterable[Column | str], seed: int) -> Column:
    """The same from the key digest, which any engine can reproduce."""
    return F.conv(F.substring(hash_digest(keys, seed), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def hash_digest(keys: Iterable[Column | str], seed: int) -> Column:
    """MD5 of seed and key values as text."""
    text = [F.coalesce(_col(k).cast("string"), F.lit("\\N")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *text))
