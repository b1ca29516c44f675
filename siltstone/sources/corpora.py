"""The test tables as search corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import FieldSpec, IndexConfig

DOCUMENTS = IndexConfig((FieldSpec("title", 5), FieldSpec("body", 1), FieldSpec("source", 1, "keyword")), id_column="doc_id", store_fields=("title", "source"), tags_field="lang")
PAGES = IndexConfig((FieldSpec("title", 5), FieldSpec("body", 1), FieldSpec("url", 1, "url")), id_column="page_id", store_fields=("title", "url"))
CONVERSATIONS = IndexConfig((FieldSpec("text", 1),), id_column="turn_id", order_by=("conv_id", "turn"), store_fields=("text",), tags_field="role")
PARTS = IndexConfig((FieldSpec("p_name", 5), FieldSpec("p_brand", 3, "keyword"), FieldSpec("p_type", 1, "keyword")), id_column="p_partkey")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), "source", "lang")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    body = F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), body.alias("body"), "url")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "conv_id", "turn", "text", "role")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type")
