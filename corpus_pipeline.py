"""Corpus pipeline: quality rules, exact deduplication, near-deduplication, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs. All but
the last return the columns of ``documents``. The mixing stage keeps every row: its decision is the order of the rows in
the files it writes, which the last stage returns as mix_part and mix_row.

Defined results. A null text is an empty one: the quality rules reject it, as they do all short texts, so no later stage meets it.
Null sources are a source of their own, null languages and lengths are carried. Very long texts go through whole. Of equal
or similar texts the row that stays is the operators' (see there), of fully repeated rows one. An empty table gives an empty result.
Further columns of ``documents`` are carried by all stages but the last, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, mixing, nbest, quality_rules, simhash
from ledgerloom.llm.common import Workspace, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.stage(spark, docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.order(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best segmentations, with each document's place in the mix: the part and the row of the file that the stage before wrote."""
    meta = docs.metadataColumn("_metadata")
    part = F.regexp_extract(meta["file_name"], r"part-(\d+)", 1).cast("int")
    placed = docs.select("doc_id", "source", "text", part.alias("mix_part"), meta["row_index"].alias("mix_row"))
    return nbest.encode(placed, "text", ["doc_id", "source", "mix_part", "mix_row"])


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: Components of fingerprints and lattice segmentations have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    space = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = space.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
