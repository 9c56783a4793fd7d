"""Quality rules whose thresholds carry a guarantee.

Every text gets a handful of counts. A document is rejected by the base rule, or by a rule whose
cutoff was selected on labelled documents: per stratum and rule the strictest cutoff is taken at
which an exact binomial bound still shows that at most ``false_rejection`` of the good documents
are rejected. The tests of one rule go from lenient to strict and stop at the first failure, so
they share one level; the levels of rules and strata are divided by their number (Bonferroni).
Every stratum is tested on its own labelled rows. Hence, with probability ``1 - error`` no stratum
loses more than ``false_rejection`` of its good documents to the rules, if its labelled documents
are a fair sample of it. A stratum with too few of them to show that for a rule does without the
rule, as does one without labels; with five rules at 2 % and four strata it takes some 1,500 good
ones. A rule counts in a stratum only where most labelled documents it rejects are labelled bad.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceframe.llm.common import words_of
from paceframe.session import materialise

SYMBOLS = "#*$%&|<>"
REPEAT_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Integer scores, high is bad; the grid of cutoffs is 1 .. its largest value.
RULES = {
    "symbols": ("n_symbols", "word_chars", 200),
    "dup_lines": ("n_dup_lines", "n_lines", 200),
    "shouting": ("n_upper", "word_chars", 200),
    "exclaims": ("n_exclaims", "word_chars", 200),
    "repeats": ("n_repeat_words", "n_words", 200),
}
# The stratum of rows without one.
UNNAMED = "*"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _n_repeat_words(places: Column) -> Column:
    """Words covered by windows that occur twice or more; ``places`` are the starts of those windows."""
    walked = F.aggregate(
        places,
        F.struct(F.lit(0).alias("covered"), F.lit(-REPEAT_WORDS).alias("last")),
        lambda acc, p: F.struct(
            (acc["covered"] + F.least(F.lit(REPEAT_WORDS), p - acc["last"])).alias("covered"), p.alias("last")
        ),
    )
    return walked["covered"].cast("long")


def text_counts(df: DataFrame) -> DataFrame:
    """``df`` with one struct column ``counts`` more: the counts that the rules use.

    Null texts have no words. Windows of words are compared by a 64-bit hash of their words; all
    work stays in the row, in time n log n of its words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    packed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        words_of(F.col("text")).alias("w"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_replace(text, f"[^A-Z!{SYMBOLS}]+", "").alias("marks"),
    )

    def joined(h: Column, distance: int) -> Column:
        """Hashes of runs twice as long, from those of runs of ``distance`` words."""
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + distance)))

    # Each array is used more than once by the next step, so it is computed once. A run that
    # starts too late for a whole window meets nulls and is cut off at the end.
    rows = packed.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    for distance in (1, 2, 4):
        rows = rows.withColumn("h", joined(F.col("h"), distance))
    rows = rows.withColumn("h", F.slice("h", 1, F.greatest(F.lit(0), F.size("w") - (REPEAT_WORDS - 1))))
    rows = rows.withColumn(
        "r",
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    twice = F.expr(
        "filter(r, (x, j) -> (j > 0 and get(r, j - 1).h = x.h) or (j + 1 < size(r) and get(r, j + 1).h = x.h))"
    )
    rows = rows.withColumn("places", F.array_sort(F.transform(twice, lambda x: x["i"])))
    counts = F.struct(
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("marks", "[A-Z!]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _n_repeat_words(F.col("places")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("marks", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("marks", "[^!]+", "")).cast("long").alias("n_exclaims"),
    )
    return rows.select("row", counts.alias("counts"))


def base_failed(counts: str = "counts") -> Column:
    n, repeated = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (n < MIN_WORDS) | (repeated * 100 > n * MAX_REPEAT_PERCENT)


def score(rule: str, counts: str = "counts") -> Column:
    """The value of a rule on its grid."""
    part, whole, top = RULES[rule]
    part, whole = F.col(f"{counts}.{part}"), F.col(f"{counts}.{whole}")
    return F.when(whole > 0, F.least(F.lit(top), F.floor(part * top / whole))).otherwise(0).cast("int")


def _allowed(n: Column, rate: float, level: Column) -> Column:
    """The most rejections k of n at which P(X <= k) <= level for X ~ Binomial(n, rate); -1 if none.

    Terms are summed as logarithms, so that large n don't underflow.
    """
    first = n * math.log1p(-rate)
    odds = math.log(rate / (1 - rate))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        total = high + F.log1p(F.exp(low - high))
        return F.struct(
            term.alias("term"), total.alias("total"), F.when(total <= F.log(level), i).otherwise(acc["k"]).cast("long").alias("k")
        )

    start = F.struct(
        first.alias("term"), first.alias("total"), F.when(first <= F.log(level), 0).otherwise(-1).cast("long").alias("k")
    )
    # The sum reaches half long before the mean, and levels are far below half.
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.ceil(n * rate))), start, step)["k"]


def fit_cutoffs(
    labelled: DataFrame,
    false_rejection: float = 0.02,
    error: float = 0.05,
    min_bad_share: float = 0.9,
) -> DataFrame:
    """(stratum, rule, cutoff) from rows (stratum, good boolean, counts struct), all of them used.

    Every stratum with labelled rows has a row for each rule; the cutoff is null where none passed.
    Rows that fail the base rule are not the rules' to judge and are left out; those with a null
    stratum are the stratum UNNAMED. The budget ``false_rejection`` is divided among the rules, the
    level ``error`` among rules and strata. Without labels there are no cutoffs.
    """
    rows = labelled.where(~base_failed()).select(
        F.coalesce("stratum", F.lit(UNNAMED)).alias("stratum"),
        "good",
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), score(r).alias("value")) for r in RULES])).alias("s"),
    )
    # At most one row for each stratum, rule, grid value.
    by_value = rows.groupBy("stratum", F.col("s.rule").alias("rule"), F.col("s.value").alias("value")).agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    )
    each = Window.partitionBy("stratum", "rule")
    from_top = each.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    tests = F.col("n_strata") * len(RULES)
    cumulated = by_value.withColumns(
        {"rejected_good": F.sum("good").over(from_top), "rejected_bad": F.sum("bad").over(from_top)}
    )
    groups = (
        by_value.groupBy("stratum", "rule")
        .agg(F.sum("good").alias("n_good"))
        .withColumn("n_strata", by_value.agg(F.count_distinct("stratum")).scalar())
        .withColumn("allowed", _allowed(F.col("n_good"), false_rejection / len(RULES), F.lit(error) / tests))
    )
    rejected = F.col("rejected_good") + F.col("rejected_bad")
    passes = (
        (F.col("value") >= 1)
        & (F.col("rejected_good") <= F.col("allowed"))
        & (F.col("rejected_bad") > 0)
        & (F.col("rejected_bad") >= F.lit(min_bad_share) * rejected)
    )
    return (
        cumulated.join(groups.select("stratum", "rule", "allowed"), ["stratum", "rule"])
        .groupBy("stratum", "rule")
        .agg(F.min(F.when(passes, F.col("value"))).alias("cutoff"))
    )


def judged(counted: DataFrame, stratum: Column, cutoffs: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``rejected_by`` (rules whose cutoff is reached) to rows with ``counts``.

    The cutoffs that exist travel as one map in a scalar subquery: strata with hundreds of labelled
    rows, times rules.
    """
    key = F.concat_ws("\x1f", "stratum", "rule")
    pairs = F.collect_list(F.struct(key, "cutoff"))
    rows = counted.withColumn("cutoffs_", cutoffs.where("cutoff is not null").agg(F.map_from_entries(pairs)).scalar())

    named = F.coalesce(stratum, F.lit(UNNAMED))
    fails = [F.when(score(r) >= F.try_element_at("cutoffs_", F.concat_ws("\x1f", named, F.lit(r))), F.lit(r)) for r in RULES]
    return rows.withColumns({"base_failed": base_failed(), "rejected_by": F.array_compact(F.array(*fails))}).drop("cutoffs_")


def labelled_counts(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled of the rows (doc_id, stratum, counts), as :func:`fit_cutoffs` takes them.

    Several labels of a document count as bad if one is; labels that are null or have no
    document are left out.
    """
    verdicts = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    return counted.join(verdicts, "doc_id").select("stratum", "good", "counts")


def quality_rules(df: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts of its text, base_failed, rejected_by, kept.

    Null texts have no words and fail the base rule. Rows that repeat an id are judged alike and
    each have a row. Columns besides doc_id, text and lang are not read.
    """
    counted = materialise(
        text_counts(df.select("doc_id", "lang", "text")).select("row.doc_id", F.col("row.lang").alias("stratum"), "counts"),
        "counts",
    )
    rows = judged(counted, F.col("stratum"), fit_cutoffs(labelled_counts(counted, labels)))
    return rows.select(
        "doc_id",
        *[f"counts.{c}" for c in COUNTS],
        "base_failed",
        "rejected_by",
        (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"),
    )


def keep_good(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``df`` that no rule rejects, all columns unchanged.

    The texts are counted once and written with their counts, which costs less than counting
    them again or shuffling them to their verdicts.
    """
    counted = materialise(text_counts(df), "counted", compression="zstd")
    labelled = labelled_counts(counted.select("row.doc_id", F.col("row.lang").alias("stratum"), "counts"), labels)
    rows = judged(counted, F.col("row.lang"), fit_cutoffs(labelled))
    return rows.where(~F.col("base_failed") & (F.size("rejected_by") == 0)).select("row.*")
