"""Small corpora for the tests."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, bin string, _id string, hash string"
SENTENCE = "The quiet river carries small boats past the old stone bridge every morning before the market opens."


def documents(spark: SparkSession, rows: list[tuple], slices: int = 3) -> DataFrame:
    """Rows (doc_id, text[, lang[, source]]) with extra columns whose names operators might use themselves."""
    full = []
    for doc_id, text, *rest in rows:
        lang, source = (*rest, *["en", "src"][len(rest) :])
        full.append((doc_id, text, lang, source, None if text is None else len(text), "k", 7, "b", "i", None))
    return spark.createDataFrame(spark.sparkContext.parallelize(full, slices), SCHEMA)


def edges(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty and blank texts, a very long one, a repeated row, a repeated doc_id, equal texts."""
    long = " ".join(f"word{i % 5000} runs on" for i in range(60_000))
    return documents(
        spark,
        [(1, SENTENCE), (1, SENTENCE), (2, SENTENCE), (3, ""), (4, None), (None, SENTENCE), (None, None, None, None), (5, " \n\t\n "), (6, long), (7, SENTENCE, None, "other"), (8, "one"), (8, "one two\nthree", "fr", None), (9, "\n".join(["same line"] * 50)), (10, "!!! ??? ###"), (11, "日本語のテキスト 二维码"), (12, "a" * 100_000)],
    )


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark, [(1, "x")]).where("doc_id < 0")


def prose(rng: random.Random, words: int, vocabulary: int = 2000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))
