"""Exact duplicates through an extendible-hash index.

A document enters the index under 64 bits of its normalised text. The directory starts with one
bucket and doubles until no bucket holds more than ``bucket_keys`` different keys. Each bucket is
a key range with one owner task, which walks its entries in key order, compares bytes within a
key and chains texts that collide. A key with very many copies is cut into pieces with an owner
each; the first copy of every chain of a piece is then compared in a second, small round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceframe.llm.common import WHITE, without
from paceframe.session import materialise

# Slots of the largest directory: 2 ** MAX_DEPTH.
MAX_DEPTH = 16
# At most so many keys are cut into pieces, which bounds the table of those keys.
MAX_CUT_KEYS = 10_000

CHAINED = (
    "slot int, key long, piece int, chain int, head boolean, doc_id long, sha string, body string, "
    "members long, best_chars long, best_id long"
)


def split_directory(key_counts: dict[int, int], bucket_keys: int, max_depth: int = MAX_DEPTH) -> list[int]:
    """The directory: for each slot the first slot of its bucket; its length is the power of two needed.

    ``key_counts`` has the number of different keys for each of ``2 ** max_depth`` prefixes. A
    bucket above ``bucket_keys`` is split at the next bit; when it is as deep as the directory,
    that doubles first.
    """
    total = [0]
    for prefix in range(1 << max_depth):
        total.append(total[-1] + key_counts.get(prefix, 0))
    depth = 0
    leaves = []
    overfull = [(0, 0)]
    while overfull:
        first, local = overfull.pop()
        width = 1 << (max_depth - local)
        if local < max_depth and total[first + width] - total[first] > bucket_keys:
            depth = max(depth, local + 1)
            overfull += [(first, local + 1), (first + width // 2, local + 1)]
        else:
            leaves.append((first, width))
    scale = max_depth - depth
    owner = [0] * (1 << depth)
    for first, width in leaves:
        owner[first >> scale : (first + width) >> scale] = [first >> scale] * (width >> scale)
    return owner


def _slot(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def chain_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks entries sorted by (key, piece) and numbers the different texts of each.

    Rows carry what they stand for (``members``, ``best_chars``, ``best_id``); the first row of a
    chain is its head and gets the totals of the chain when the group ends. Only the different
    texts of one group are held, besides the rows of the batch.
    """
    group: tuple[int, int] | None = None
    chains: dict[str, dict] = {}

    def heads() -> list[dict]:
        return list(chains.values())

    for batch in batches:
        rows: list[dict] = []
        for row in batch.to_dict("records"):
            if (row["key"], row["piece"]) != group:
                rows += heads()
                group, chains = (row["key"], row["piece"]), {}
            # A dict of texts compares hash and then all characters: equal texts are one chain.
            head = chains.get(row["body"])
            if head is None:
                chains[row["body"]] = row | {"chain": len(chains), "head": True}
                continue
            rows.append(row | {"chain": head["chain"], "head": False, "body": None})
            head["members"] += row["members"]
            better = (row["best_chars"], -row["best_id"]) > (head["best_chars"], -head["best_id"])
            if better:
                head["best_chars"], head["best_id"] = row["best_chars"], row["best_id"]
        if rows:
            yield pd.DataFrame(rows)[[c.split()[0] for c in CHAINED.split(", ")]]
    if chains:
        yield pd.DataFrame(heads())[[c.split()[0] for c in CHAINED.split(", ")]]


def exact_dedup(df: DataFrame, bucket_keys: int = 1024, piece_rows: int = 4096, owners: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after deleting ASCII white space; null counts as empty, and all
    empty texts form a group. The row with the most code points in the original text stays, of
    several the one with the smallest doc_id. Rows that repeat an id are rows of their own: they
    count in ``group_size`` and share ``kept`` with the row whose id they bear. A null id is
    never the one that stays unless all ids of the group are null (keep_id is null, kept true).
    Other columns are not read, whatever their names. No rows give no rows.
    """
    spark = df.sparkSession
    text = F.coalesce("text", F.lit(""))
    # The entries are written once: their keys are counted, then their bytes compared.
    entries = materialise(
        df.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("chars"), without(text, WHITE).alias("body"))
        .withColumns({"key": F.xxhash64("body"), "sha": F.sha2("body", 256)}),
        "entries",
        compression="zstd",
    )
    counts = materialise(entries.groupBy("key").agg(F.count("*").alias("n")), "key-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    piece_rows = max(piece_rows, -(-total // MAX_CUT_KEYS))
    # 2 ** MAX_DEPTH rows at most.
    by_prefix = counts.groupBy(_slot(F.col("key"), MAX_DEPTH).alias("prefix")).count().collect()
    directory = split_directory({r["prefix"]: r["count"] for r in by_prefix}, bucket_keys)
    depth = len(directory).bit_length() - 1
    buckets = spark.createDataFrame(pd.DataFrame({"slot": range(len(directory)), "bucket": directory}, dtype="int32"), "slot int, bucket int")
    cut = counts.where(F.col("n") > piece_rows).select("key", F.ceil(F.col("n") / piece_rows).cast("int").alias("pieces"))

    # Both tables are bounded: 2 ** MAX_DEPTH slots, MAX_CUT_KEYS keys.
    placed = (
        entries.withColumn("slot", _slot(F.col("key"), depth))
        .join(F.broadcast(buckets), "slot")
        .join(F.broadcast(cut), "key", "left")
        .withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.expr("pmod(xxhash64(doc_id, chars), pieces)")).cast("int"))
        .select(
            F.col("bucket").alias("slot"),
            "key",
            "piece",
            F.lit(0).alias("chain"),
            F.lit(False).alias("head"),
            # No null numbers reach pandas: a missing id sorts behind all others.
            F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"),
            "sha",
            "body",
            F.lit(1).cast("long").alias("members"),
            F.col("chars").alias("best_chars"),
            F.coalesce("doc_id", F.lit(2**63 - 1)).alias("best_id"),
            F.col("pieces").isNotNull().alias("is_cut"),
        )
    )
    order = ["slot", "key", "piece"]
    width = owners or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    owned = placed.drop("is_cut").repartition(width, *order[:1], "piece").sortWithinPartitions(*order)
    chained = owned.mapInPandas(chain_entries, CHAINED)
    # Only heads of keys cut into pieces meet again, so only those keep their text.
    cut_keys = cut.select("key", F.lit(True).alias("is_cut"))
    chained = materialise(
        chained.join(F.broadcast(cut_keys), "key", "left")
        .withColumn("body", F.when(F.col("is_cut") & F.col("head"), F.col("body")))
        .withColumn("is_cut", F.coalesce("is_cut", F.lit(False))),
        "chains",
    )
    heads = chained.where("head")
    own = ["key", "piece", "chain"]
    whole = heads.where("not is_cut").select(*own, "best_id", "members")
    again = (
        heads.where("is_cut")
        .select(
            "slot",
            "key",
            F.lit(0).alias("piece"),
            "chain",
            "head",
            # The head of a piece travels as (piece, chain) in the place of its id.
            (F.col("piece").cast("long") * 2**31 + F.col("chain")).alias("doc_id"),
            "sha",
            "body",
            "members",
            "best_chars",
            "best_id",
        )
        .repartition(width, "key")
        .sortWithinPartitions("key")
        .mapInPandas(chain_entries, CHAINED)
    )
    again = materialise(again.drop("body"), "heads")
    joined = (
        again.alias("h")
        .join(again.where("head").alias("t"), F.expr("h.key = t.key and h.chain = t.chain"))
        .select(
            "h.key",
            F.expr("cast(h.doc_id div 2147483648 as int)").alias("piece"),
            F.expr("cast(h.doc_id % 2147483648 as int)").alias("chain"),
            "t.best_id",
            "t.members",
        )
    )
    none = F.lit(2**63 - 1)
    return (
        chained.select(*own, "doc_id", "sha")
        .join(whole.unionByName(joined), own)
        .select(
            F.nullif("doc_id", none).alias("doc_id"),
            F.nullif("best_id", none).alias("keep_id"),
            F.col("members").alias("group_size"),
            (F.col("doc_id") == F.col("best_id")).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )
