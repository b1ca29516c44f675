"""What all corpus operators share: written tables, size-checked broadcasts, doc_ids, and column names of their own."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.sources.scratch import Scratch, shared_dir

__all__ = ["BROADCAST_KEYS", "Scratch", "doc_id", "partitions", "shared_dir", "sized", "unused"]

#: Key rows up to which a key table is broadcast (16 bytes a row in the hash table); above it, a shuffle join.
BROADCAST_KEYS = 1_000_000


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(keys: DataFrame, rows: int) -> DataFrame:
    """keys with a broadcast hint if they are few by count; otherwise left to a shuffled join."""
    return F.broadcast(keys) if rows <= BROADCAST_KEYS else keys


def doc_id(documents: DataFrame, name: str = "doc_id") -> Column:
    """The id column as a long; a TypeError unless it is of a whole-number type."""
    kind = documents.schema[name].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{name} must be of a whole-number type, not {kind.simpleString()}")
    return F.col(f"`{name}`").cast("long")


def unused(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores before it until no column is called so (letter case aside)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
