"""Line dedup: range-partitioned hashes sorted by document and position; keep bitmaps come back, not text.

Each line travels as a 128-bit hash of its trimmed text, its doc_id and its position. A range partitioning
over all four columns also splits a line that is repeated without end over many tasks. A sorted sweep marks
all but the first row of each hash; the one row per partition whose hash began in an earlier partition is
settled from the partitions' first and last hashes (as many rows as there are partitions).

A document's bitmap is run-length encoded: "3,2,5" keeps 3 lines, drops 2, keeps 5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._scratch import Scratch, doc_id, partitions, unused

SWEPT = "doc_id long, pos int, pid int, first_hi long, first_lo long, last_hi long, last_lo long"
SALT = 7368787


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, pos) that repeat an earlier row's hash, and at last one row on the partition itself."""
    pid, last, first = TaskContext.get().partitionId(), None, None
    names = [x.split()[0] for x in SWEPT.split(", ")]
    schema = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("pid", pa.int32()), *((n, pa.int64()) for n in names[3:])])

    def rows(doc, pos, ends=(None,) * 4) -> pa.RecordBatch:
        n = len(doc)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(pos, pa.int32()), pa.array(np.full(n, pid), pa.int32()), *(pa.array([e] * n, pa.int64()) for e in ends)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, doc, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        # A row equal in all four columns to the one before it (a repeated row of documents) says nothing new.
        new = np.ones(len(hi), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
        new[0] = (int(hi[0]), int(lo[0]), int(doc[0]), int(pos[0])) != last
        if not new.any():
            continue
        hi, lo, doc, pos = hi[new], lo[new], doc[new], pos[new]
        again = np.zeros(len(hi), bool)
        again[1:] = (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1])
        if last is None:
            first = (int(hi[0]), int(lo[0]), int(doc[0]), int(pos[0]))
        else:
            again[0] = (int(hi[0]), int(lo[0])) == last[:2]
        last = (int(hi[-1]), int(lo[-1]), int(doc[-1]), int(pos[-1]))
        yield rows(doc[again], pos[again])
    if last is not None:
        yield rows([first[2]], [first[3]], (*first[:2], *last[:2]))


def _runs(drops: Column) -> Column:
    """Run lengths, keep first, from the sorted positions of the dropped lines, up to the last one."""
    after = F.transform(drops, lambda x: x + 1)
    starts, ends = F.array_except(drops, after), F.array_except(after, drops)
    turns = F.flatten(F.zip_with(starts, ends, lambda a, b: F.array(a, b)))
    lengths = F.zip_with(turns, F.concat(F.array(F.lit(0)), turns), lambda x, y: x - y)
    return F.filter(lengths, lambda x, i: x.isNotNull() & ((i == 0) | (x > 0)))


def _kept_flags(drops: Column) -> Column:
    """Whether each line stays, up to the last dropped one."""
    return F.flatten(F.transform(_runs(drops), lambda n, i: F.array_repeat(i % 2 == 0, n)))


def repeated_lines(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, drops): the sorted positions of each document's lines that occur earlier in doc_id, position order."""
    spark = documents.sparkSession
    lines = documents.where("doc_id is not null").select(doc_id(documents).alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    trimmed = F.trim(F.translate("line", "\r\t", "  "))
    hashed = lines.where(trimmed != "").select(F.xxhash64(trimmed).alias("hi"), F.xxhash64(F.lit(SALT), trimmed).alias("lo"), "doc_id", "pos")
    keyed = scratch.write(hashed, "hashes")
    order = ["hi", "lo", "doc_id", "pos"]
    swept = scratch.write(keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_sweep, SWEPT), "swept")
    scratch.release("hashes")
    carried, before = [], None
    for e in swept.where("first_hi is not null").orderBy("pid").collect():  # one row a partition
        if before == (e.first_hi, e.first_lo):
            carried.append((e.doc_id, e.pos))
        before = (e.last_hi, e.last_lo)
    repeats = swept.where("first_hi is null").select("doc_id", "pos").union(spark.createDataFrame(carried, "doc_id long, pos int"))
    return repeats.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def line_bitmaps(documents: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, keep_runs) for each document.

    A line is a repeat if an equal line, tabs and spaces at its ends aside, comes before it in order of doc_id and position;
    blank lines are always kept. A null text has 0 lines and the runs "0"; an empty text has one blank
    line. Rows with a null doc_id are left out. Rows that repeat a doc_id count as one document: each
    has its own row here with the positions of both, and of equal lines at one position none repeats the other. A very long text
    is taken line by line, each as long as it is; an empty table gives no rows. Only doc_id (of a whole-number type, else a
    TypeError) and text are read, so other columns may have any name.
    """
    scratch = Scratch(documents.sparkSession, "linededup")
    drops = repeated_lines(documents, scratch)
    n = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("int")
    counts = documents.where("doc_id is not null").select(doc_id(documents).alias("doc_id"), n.alias("n_lines"))
    own = F.filter(F.coalesce("drops", F.expr("array()").cast("array<int>")), lambda x: x < F.col("n_lines"))
    found = counts.join(drops, "doc_id", "left").withColumn("drops", own)
    past = F.coalesce(F.array_max("drops") + 1, F.lit(0))
    runs = F.concat(F.transform(_runs(F.col("drops")), lambda n: n.cast("string")), F.when((past < F.col("n_lines")) | (past == 0), F.array((F.col("n_lines") - past).cast("string"))).otherwise(F.array().cast("array<string>")))
    return found.select("doc_id", "n_lines", F.size("drops").alias("n_dropped"), F.array_join(runs, ",").alias("keep_runs"))


def drop_repeated_lines(documents: DataFrame) -> DataFrame:
    """documents with repeated lines taken out of text; all other columns as they are but n_chars, the new length.

    A document all of whose lines are repeats is dropped. Null and empty texts, and rows with a null
    doc_id, stay as they are. Extra columns of any name are kept; an empty table stays one. What repeats what, and what rows of one doc_id
    do to each other, is as in line_bitmaps().
    """
    scratch = Scratch(documents.sparkSession, "linededup")
    own, gone, made = unused(documents.columns, "dedup_doc", "dedup_drops", "dedup_text")
    drops = repeated_lines(documents, scratch).select(F.col("doc_id").alias(own), F.col("drops").alias(gone))
    joined = documents.join(drops, doc_id(documents) == F.col(own), "left")
    # No lambda here refers to a computed column: Catalyst would inline it and evaluate it for each element.
    pairs = F.filter(F.arrays_zip(F.split("text", "\n").alias("line"), _kept_flags(F.col(gone)).alias("keep")), lambda z: z["line"].isNotNull() & F.coalesce(z["keep"], F.lit(True)))
    left = F.when(F.col(gone).isNotNull(), F.array_join(F.transform(pairs, lambda z: z["line"]), "\n")).otherwise(F.col("text"))
    # The generator keeps the new text from being computed once for the filter and again for each column.
    out = joined.withColumn(made, F.explode(F.array(left))).where(F.col(gone).isNull() | (F.trim(F.translate(made, "\r\t\n", "   ")) != ""))
    new = {"text": F.col(made)} | ({"n_chars": F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(made)).cast(documents.schema["n_chars"].dataType)} if "n_chars" in documents.columns else {})
    return out.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in documents.columns))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_bitmaps(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = """
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM docs),
trimmed AS (SELECT doc_id, pos, trim(translate(line, chr(13) || chr(9), '  '), ' ') AS line FROM lines),
marked AS (
  SELECT doc_id, pos, CASE WHEN line = '' THEN 1
    WHEN row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) = 1 THEN 1 ELSE 0 END AS keep
  FROM trimmed),
stepped AS (
  SELECT *, CASE WHEN keep <> coalesce(lag(keep) OVER (PARTITION BY doc_id ORDER BY pos), 1) THEN 1 ELSE 0 END AS turn
  FROM marked),
numbered AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM stepped),
runs AS (SELECT doc_id, run, min(keep) AS keep, count(*) AS n FROM numbered GROUP BY doc_id, run),
whole AS (
  SELECT doc_id, CAST(sum(n) AS INTEGER) AS n_lines, CAST(sum(CASE WHEN keep = 0 THEN n ELSE 0 END) AS INTEGER) AS n_dropped,
    CASE WHEN min(CASE WHEN run = 0 THEN 0 ELSE 1 END) = 1 THEN '0,' ELSE '' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY run) AS keep_runs
  FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(w.n_lines, 0) AS n_lines, coalesce(w.n_dropped, 0) AS n_dropped, coalesce(w.keep_runs, '0') AS keep_runs
FROM (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN whole w USING (doc_id)
"""
