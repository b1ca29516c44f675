"""Indexing a stream of documents: each micro-batch becomes a segment, and a search runs over all segments.

A segment is a saved index. Its ordinals begin where the segments before it end, and document frequencies add up over segments;
pruning is by segment. A micro-batch that is run again after a failure rewrites its own segment, so a document is indexed once.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.config import IndexConfig
from siltstone.operators.build import Index, build_index
from siltstone.operators.search import SearchEngine
from siltstone.sources import store


def segments(spark: SparkSession, path: str) -> list[str]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(n for n in names if n.startswith("segment-"))


def append_batch(batch: DataFrame, batch_id: int, config: IndexConfig, path: str) -> None:
    """Index one micro-batch as its segment; an empty one makes none."""
    if batch.isEmpty():
        return
    spark = batch.sparkSession
    name = f"segment-{batch_id:012d}"
    before = sum(spark.read.parquet(f"{path}/{s}/manifest").first().docs for s in segments(spark, path) if s < name)
    index = build_index(batch, config)
    shift = (F.col("doc_ord") + F.lit(before)).alias("doc_ord")
    moved = replace(index, docs=index.docs.select(shift, *index.docs.columns[1:]), postings=index.postings.select("ftype", "term", shift, "score"))
    store.save(moved, f"{path}/{name}")


def index_stream(documents: DataFrame, config: IndexConfig, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start indexing a streaming DataFrame into path; trigger as of DataStreamWriter.trigger."""
    writer = documents.writeStream.foreachBatch(lambda batch, i: append_batch(batch, i, config, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def load_segments(spark: SparkSession, path: str) -> SearchEngine:
    """One engine over all segments of a path."""
    names = segments(spark, path)
    if not names:
        raise ValueError(f"no segments at {path}")
    engines = [store.load_index(spark, f"{path}/{n}") for n in names]
    first, *rest = (e.index for e in engines)
    tables = {}
    for t in store.TABLES:
        table = getattr(first, t)
        for i in rest:
            table = table.unionByName(getattr(i, t))
        tables[t] = table
    tables["features"] = tables["features"].groupBy("ftype", "term").agg(F.sum("df").cast("int").alias("df"))
    tables["deletes"] = tables["deletes"].drop("df").distinct().join(tables["features"], ["ftype", "term"]).select("deletion", "ftype", "term", "df")
    return SearchEngine(Index(first.config, **tables, n_docs=sum(i.n_docs for i in [first, *rest])))

