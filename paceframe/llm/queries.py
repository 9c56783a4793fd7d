"""The registered queries of this package."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from paceframe.llm import (
    conversations,
    exact_dedup,
    hard_negatives,
    jaccard_join,
    language_id,
    licenses,
    line_dedup,
    mixing,
    pieces,
    quality_rules,
    suffix_dedup,
    token_counts,
    token_files,
)
from paceframe.llm.common import documents
from paceframe.plans.registry import Registry
from paceframe.session import materialise, scratch_path

QUERIES = Registry()


@QUERIES.add
def op3_exact_dedup(spark, sf):
    """Groups of documents that are equal but for white space."""
    return exact_dedup.exact_dedup(documents(spark, sf))


@QUERIES.add
def op7_quality_rules(spark, sf):
    """Counts of every text and the verdict of rules with risk-controlled cutoffs."""
    rows = quality_rules.quality_rules(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))
    return rows.select(
        "doc_id", *quality_rules.COUNTS, "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by")
    )


@QUERIES.add
def op10_jaccard_join(spark, sf):
    """Components of documents linked by the overlap of their word shingles."""
    return jaccard_join.jaccard_components(documents(spark, sf))


@QUERIES.add
def op9_language_id(spark, sf):
    """Language of every text by the code lengths of frozen context trees."""
    return language_id.identify(documents(spark, sf))


@QUERIES.add
def op2_temperature_mixing(spark, sf):
    """Every use of a document in a mix of sources with raised entropy, in the order of training."""
    rows = mixing.mix(documents(spark, sf).select("doc_id", "source", "text"))
    return rows.select("doc_id", "source", "mix.*")


@QUERIES.add
def op1_line_dedup(spark, sf):
    """Every document without the lines that stand, but for two edits, earlier in the corpus."""
    rows = line_dedup.dedup_lines(documents(spark, sf).select("doc_id", "text"))
    return rows.withColumn("n_removed", F.size("removed_lines").cast("long"))


@QUERIES.add
def op4_token_ids(spark, sf):
    """Token ids of every text, written to files and read back."""
    path = scratch_path(spark, "token-files")
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as model:
        token_files.write_token_files(documents(spark, sf), path, model.read())
    rows = token_files.read_token_files(spark, path)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@QUERIES.add
def op5_sentencepiece(spark, sf):
    """Piece ids of every text, and whether the text made from them again is the same."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    docs = documents(spark, sf).select("doc_id", "text", F.sha2("text", 256).alias("sha"))
    encoded = pieces.encode_pieces(docs, model).withColumn("piece_ids", F.col("ids"))
    decoded = pieces.decode_pieces(encoded, model)
    return decoded.select(
        "doc_id",
        F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_ids"),
        F.col("piece_ids").alias("ids"),
        F.col("sha").eqNullSafe(F.sha2("text", 256)).alias("exact"),
    )


@QUERIES.add
def op6_license_scan(spark, sf):
    """License notices in every text, short ones too."""
    return licenses.scan(documents(spark, sf))


@QUERIES.add
def op8_suffix_dedup(spark, sf):
    """What stays of every text without strings of 200 bytes that occur elsewhere."""
    return suffix_dedup.remove_repeats(documents(spark, sf)).drop("rest")


@QUERIES.add
def op11_token_counts(spark, sf):
    """Tokens of every text, as the tokenizer of the file cuts it."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as model:
        counted = token_counts.count_tokens(documents(spark, sf).select("doc_id", "text"), model.read())
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@QUERIES.add
def op12_hard_negatives(spark, sf):
    """Rows of other labels that score just below the nearest rows of an anchor's label."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


@QUERIES.add
def op13_conversation_repair(spark, sf):
    """Faults of damaged conversations and their cheapest repair."""
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = conversations.damaged(given)
    found = materialise(conversations.audits(rows), "audits")
    digests = conversations.repaired_digests(rows, found)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = given.select(F.col("conv_id").cast("long").alias("id")).distinct()
    # A null id is an id like any other; a conversation without rows has no audit.
    whole = ids.join(found, F.col("id").eqNullSafe(found["conv_id"]), "left").drop("conv_id")
    whole = whole.join(digests, F.col("id").eqNullSafe(digests["conv_id"]), "left").drop("conv_id")
    return whole.select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
