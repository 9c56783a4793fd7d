"""Mixing sources to target weights.

A source with the share p of all tokens gets a weight in proportion to p to the power of an
exponent between 0 (all sources alike) and 1 (as they are). The exponent is found by bisection:
the largest at which the entropy of the weights reaches its target, raised where a small source
would otherwise be repeated more often than allowed. The weights are then realised as budgets of
tokens. Documents of a source lie in blocks; every epoch is a permutation of the blocks and of
the documents in each, and the last epoch ends where the budget does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceframe.llm.common import words_of
from paceframe.session import materialise

STEPS = 50
# A block has about so many documents; blocks grow where a source would have more than MAX_BLOCKS.
BLOCK_DOCS = 1024
MAX_BLOCKS = 65_536


def digest(*parts: Column | str) -> Column:
    """60 bits of a digest of the parts."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _power_sum(shares: Column, exponent: Column) -> Column:
    return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + F.pow(p, exponent))


def entropy(shares: Column, exponent: Column) -> Column:
    """Entropy in nats of the weights p ** exponent / sum."""
    total = _power_sum(shares, exponent)
    logs = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + F.pow(p, exponent) * F.ln(p))
    return F.ln(total) - exponent * logs / total


def repetition(shares: Column, exponent: Column, budget_share: float) -> Column:
    """How often the smallest source is used when the budget is ``budget_share`` of all tokens."""
    return F.lit(budget_share) * F.pow(F.array_min(shares), exponent - 1) / _power_sum(shares, exponent)


def exponent(shares: Column, entropy_share: float, max_epochs: float, budget_share: float) -> Column:
    """The exponent for shares in ascending order; see the module."""
    target = F.lit(entropy_share) * F.ln(F.size(shares))
    start = F.struct(*[F.lit(x).alias(n) for n, x in (("h_low", 0.0), ("h_high", 1.0), ("r_low", 0.0), ("r_high", 1.0))])

    def step(acc: Column, _: Column) -> Column:
        h, r = (acc["h_low"] + acc["h_high"]) / 2, (acc["r_low"] + acc["r_high"]) / 2
        flat = entropy(shares, h) >= target
        seldom = repetition(shares, r, budget_share) <= max_epochs
        return F.struct(
            F.when(flat, h).otherwise(acc["h_low"]).alias("h_low"),
            F.when(flat, acc["h_high"]).otherwise(h).alias("h_high"),
            F.when(seldom, acc["r_low"]).otherwise(r).alias("r_low"),
            F.when(seldom, r).otherwise(acc["r_high"]).alias("r_high"),
        )

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
    by_entropy = F.when(entropy(shares, F.lit(1.0)) >= target, 1.0).otherwise(found["h_low"])
    by_repetition = F.when(repetition(shares, F.lit(0.0), budget_share) <= max_epochs, 0.0).otherwise(found["r_high"])
    return F.greatest(by_entropy, by_repetition)


def source_budgets(sizes: DataFrame, entropy_share: float, max_epochs: float, budget_share: float) -> DataFrame:
    """(source, n_docs, n_tokens, weight, budget) from (source, n_docs, n_tokens).

    Shares of all sources are held in one row, so their number should stay below some 100,000.
    """
    ordered = F.array_sort(F.collect_list("n_tokens"))
    row = sizes.agg(ordered.alias("tokens"), F.sum("n_tokens").alias("total"))
    row = row.select("total", F.transform("tokens", lambda t: t / F.col("total")).alias("shares"))
    row = row.select("total", "shares", exponent(F.col("shares"), entropy_share, max_epochs, budget_share).alias("alpha"))
    row = row.select(F.struct("total", "alpha", _power_sum(F.col("shares"), F.col("alpha")).alias("z")).alias("mix"))
    rows = sizes.withColumn("mix", row.scalar())
    weight = F.pow(F.col("n_tokens") / F.col("mix.total"), F.col("mix.alpha")) / F.col("mix.z")
    rows = rows.withColumn("weight", weight)
    budget = F.floor(F.col("weight") * F.floor(F.col("mix.total") * budget_share)).cast("long")
    return rows.select("source", "n_docs", "n_tokens", "weight", budget.alias("budget"))


def _placed(df: DataFrame, seed: str, sources: DataFrame) -> DataFrame:
    blocks = F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("n_docs") / BLOCK_DOCS))
    return df.join(sources.select("mix_source", "n_docs"), "mix_source").withColumn(
        "mix_block", F.pmod(digest(seed, F.col("doc_id")), blocks).cast("int")
    ).drop("n_docs")


def mix(
    df: DataFrame,
    entropy_share: float = 0.95,
    max_epochs: float = 4.0,
    budget_share: float = 1.0,
    seed: str = "mix",
    report: str = "mix",
) -> DataFrame:
    """A row for every use of a row of ``df``: its columns, and a struct ``report``, which
    replaces one of that name, of (n_tokens, epoch, block_place, key).

    Training reads the uses of a source by (epoch, block_place, key). A token is a word; the
    budget is ``budget_share`` of all tokens, at most ``max_epochs``. Null and empty sources are
    one source. Sources without tokens are not used, other documents without tokens are used
    like their neighbours. Of the last epoch the block that reaches the budget is cut at the
    last document that still fits. Rows that repeat an id are used alike.
    """
    if not 0 < budget_share <= max_epochs:
        raise ValueError("the budget must be positive and within the repetition limit")
    source = F.coalesce(F.col("source"), F.lit(""))
    packed = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.select(packed, F.col("doc_id").alias("doc_id"), source.alias("mix_source"), F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"))
    counted = materialise(rows.select("doc_id", "mix_source", "n_tokens"), "tokens")
    sizes = counted.groupBy(F.col("mix_source").alias("source")).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_tokens > 0")
    sources = materialise(
        source_budgets(sizes, entropy_share, max_epochs, budget_share)
        .withColumnRenamed("source", "mix_source")
        .withColumns({"epochs": F.expr("budget div n_tokens"), "rest": F.col("budget") % F.col("n_tokens")})
        .drop("n_tokens", "weight"),
        "sources",
    )
    placed = _placed(counted, seed, sources)
    blocks = placed.groupBy("mix_source", "mix_block").agg(F.sum("n_tokens").alias("n_tokens"))
    uses = blocks.join(sources.select("mix_source", "epochs", "rest"), "mix_source").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))))
    order = Window.partitionBy("mix_source", "epoch").orderBy("block_key", "mix_block")
    uses = uses.withColumn("block_key", digest(seed, F.col("mix_source"), F.col("epoch"), F.col("mix_block"))).withColumns(
        {
            "block_place": F.row_number().over(order).cast("long"),
            "upto": F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    before = F.col("upto") - F.col("n_tokens")
    # In the last epoch: blocks that fit are whole, the next is cut, the others are left out.
    whole = (F.col("epoch") < F.col("epochs")) | (F.col("upto") <= F.col("rest"))
    uses = uses.where(whole | (before < F.col("rest"))).select(
        "mix_source", "mix_block", "epoch", "block_place", whole.alias("whole"), (F.col("rest") - before).alias("room")
    )
    uses = materialise(uses, "blocks")
    key = digest(seed, F.col("epoch"), F.col("doc_id"))
    partial = placed.join(uses.where("not whole"), ["mix_source", "mix_block"]).withColumn("key", key)
    fits = F.sum("n_tokens").over(Window.partitionBy("mix_source").orderBy("key"))  # one block a source; equal keys together
    cuts = partial.withColumn("fits", fits).where("fits <= room").groupBy("mix_source", "mix_block", "epoch").agg(F.max("key").alias("last_key"))
    uses = uses.join(cuts, ["mix_source", "mix_block", "epoch"], "left").where("whole or last_key is not null")
    used = _placed(rows, seed, sources).join(uses.select("mix_source", "mix_block", "epoch", "block_place", "last_key"), ["mix_source", "mix_block"])
    used = used.withColumn("key", key).where(F.col("last_key").isNull() | (F.col("key") <= F.col("last_key")))
    columns = [F.col("row").getField(c).alias(c) for c in df.columns if c != report]
    return used.select(*columns, F.struct("n_tokens", "epoch", "block_place", "key").alias(report))
