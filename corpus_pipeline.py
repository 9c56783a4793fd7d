"""From raw documents to token ids, one operator of ``paceframe.llm`` a stage.

Every stage works on all rows that its predecessor kept. All but the last return the columns of
``documents``: the first and third drop rows, the second shortens texts, the fourth repeats rows
or leaves some out, as its weights ask. The last returns the ids of every text that is left, and
whether they give it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.llm import jaccard_join, line_dedup, mixing, pieces, quality_rules
from paceframe.llm.common import free_name
from paceframe.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a risk-controlled rule rejects."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand, but for two edits, earlier in the corpus."""
    report = free_name(docs, "removed_lines")
    return line_dedup.dedup_lines(docs, report=report).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest id.

    Documents whose text has no words left are linked with nothing and stay, as do rows with a
    null id; of rows that share an id none is dropped unless all are.
    """
    found = jaccard_join.jaccard_components(docs.select("doc_id", "text"))
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every use of a document in a mix of sources with raised entropy."""
    report = free_name(docs, "mix")
    return mixing.mix(docs, report=report).select(*[F.col(f"`{c}`") for c in docs.columns])


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the piece ids of every text, and whether the text made from them again is
    the same; null texts have none."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    encoded = pieces.encode_pieces(docs.select("doc_id", "source", "text", F.sha2("text", 256).alias("sha")), model)
    # Written first: else each task runs two Python workers at a time, each with a vocabulary.
    encoded = materialise(encoded, "encoded")
    decoded = pieces.decode_pieces(encoded.withColumn("piece_ids", F.col("ids")), model)
    return decoded.select(
        "doc_id",
        "source",
        F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_ids"),
        F.col("piece_ids").alias("ids"),
        F.col("sha").eqNullSafe(F.sha2("text", 256)).alias("exact"),
    )


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", piece_ids),
]

# Near-duplicate lines, shingle joins and piece ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
