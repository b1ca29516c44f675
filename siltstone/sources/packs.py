"""Sets of saved indexes, one of each corpus, with a manifest of them all."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import IndexConfig
from siltstone.sources import store
from siltstone.sources.scratch import Scratch

MANIFEST = "name string, docs long, features long, postings long, correction_deletes long, bytes long"


@dataclass(frozen=True)
class PackSpec:
    """A corpus and how to index it. limit: the first so many rows in the config's order (None: all). trim: column -> characters that are kept of its text."""

    name: str
    documents: DataFrame
    config: IndexConfig
    limit: int | None = None
    trim: Mapping[str, int] = field(default_factory=dict)


def trimmed(spec: PackSpec) -> DataFrame:
    """The corpus as it is indexed: limited, and its columns trimmed. Null texts stay null."""
    d = spec.documents
    if spec.limit is not None:
        d = d.orderBy(*spec.config.resolved().order_by).limit(spec.limit)
    return d.select(*(F.substring(f"`{c}`", 1, spec.trim[c]).alias(c) if c in spec.trim else F.col(f"`{c}`") for c in d.columns))


def build_packs(spark: SparkSession, specs: Sequence[PackSpec], root: str) -> DataFrame:
    """Build each corpus's index in root/name; (name, docs, features, postings, correction_deletes, bytes) of all, also written to root/manifest."""
    rows = []
    for spec in specs:
        path = f"{root}/{spec.name}"
        made = store.save_documents_index(trimmed(spec), spec.config, path).first()
        rows.append((spec.name, made.docs, made.features, made.postings, made.correction_deletes, store.index_bytes(spark, path)))
    return Scratch(spark, "packs", root).write(spark.createDataFrame(rows, MANIFEST), "manifest")
