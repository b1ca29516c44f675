"""From raw documents to packed training sequences, in stages that each write a table.

quality rules -> line dedup -> near dedup -> mixing -> packing. All but the last return the columns of
documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import line_dedup, mixing, near_dup, packing
from siltstone.llm import quality_rules as rules
from siltstone.sources.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the isolation forest rejects go.

    Null and empty texts are judged as texts of no words, very long ones whole; rows of a null doc_id and repeated rows are each judged; an
    anomaly equal to the threshold stays; no documents, or no good label, reject nothing. All columns stay, whatever they are called.
    """
    return rules.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur before, in an earlier document or place, go; a document that has none left goes.

    Null and empty texts and rows of a null doc_id stay as they are, blank lines too; rows of one doc_id don't repeat each other
    at the same position; no documents give none. All columns stay, n_chars is the new length.
    """
    return line_dedup.drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id.

    Rows of a null doc_id, and texts that are null or without a word, are no copies; rows of one doc_id are one document, of its equal rows one stays; a similarity
    equal to the threshold is near; very long texts are compared whole; no documents give none. All columns stay.
    """
    return near_dup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gets its share of the tokens: whole epochs, then a sample weighted by quality. Repeated epochs repeat rows.

    Rows of a null doc_id go; a null source is a source; null and empty texts have no tokens; rows of one doc_id in a source are
    taken together; ties in the key go by doc_id; a long document may pass its source's budget; no documents give none. All columns stay.
    """
    # Of the labelled documents the rules have left hardly a bad one, so the quality field learns from the table that they come from.
    examples, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return mixing.mix_sources(docs, labels, examples=examples)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, chunk, n_tokens, sequence, offset): documents as pieces of sequences of at most 2,048 tokens of the tokenizer.

    Long documents are cut into several pieces; texts of no tokens go; repeated rows, and rows of a null doc_id, are each packed; ties in
    length go by order of reading; no documents give none. Only doc_id and text are read.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: The quality rules are an isolation forest, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.release(f"stage-{i - 1}")
    return docs
