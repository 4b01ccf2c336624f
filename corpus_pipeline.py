"""A corpus in five steps, from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and works on all rows that the
stage before it kept; all but the last return those columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, lang_crf, line_dedup, minhash, packing
from tidemark.llm.shared import free_name, stored

#: A text whose words' largest marginals have a smaller mean is no text in known languages, be they one or several.
LEAST_CONFIDENCE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the texts in languages that the labels know, mixed ones too; lang stays as it was. Where nothing is labelled no
    language can be judged, and all texts stay."""
    names = tuple(free_name(docs, n) for n in lang_crf.NAMES)
    found = lang_crf.identify(docs, docs, names=names)
    kept = (F.col(names[0]) != lang_crf.UNKNOWN) & (F.col(names[3]) >= LEAST_CONFIDENCE)
    return found.where(F.col(names[3]).isNull() | kept).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop recurring lines, and the documents that had nothing else; n_chars follows the text."""
    lines, dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    found = line_dedup.drop_recurring_lines(docs, n_lines=lines, n_dropped=dropped)
    empty = (F.col(dropped) > 0) & (F.trim("text") == "")
    n_chars = F.when(F.col(dropped) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return found.where(~F.coalesce(empty, F.lit(False))).select(*(n_chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class."""
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more lies in windows of the benchmark."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens."""
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("input_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

#: SQL can express neither the trained language model nor the template tree.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
