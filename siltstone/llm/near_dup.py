"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is the set of hashed runs of SHINGLE words of its lower-cased text. Its sketch has COORDINATES
bins. In round i every element throws one ball of value i + fraction into one bin and a bin keeps its
least value; the first COORDINATES rounds pick the bin by hash, the following ones aim at one bin each,
so every bin is filled after at most twice as many rounds, mostly after two or three. Two sketches agree
in a coordinate with a probability equal to the Jaccard similarity, with Chernoff-like concentration.

Bands of ROWS coordinates are bucketed by a range sort over (key, doc_id) and a sweep, so that a bucket of any size is
split over tasks. In each bucket every member is verified against the least member by exact Jaccard over the full sets.
Buckets that then still hold several components go through further rounds of leaders, each of GROWTH times as many:
leaders meet the members after them that aren't in their component yet. Pairs inside one component can't change the components, and
pairs of sets of too unequal size can't be near, so this gives exactly the components of all candidate pairs without a cap on the bucket. Only where no member of a bucket is near another are
all its pairs verified. A leader of many members is salted: its set goes to as many tasks as its members fill.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import _kernels as K
from siltstone.llm._graph import components
from siltstone.llm._scratch import Scratch, doc_id, partitions, sized

SHINGLE, COORDINATES, ROWS, THRESHOLD = 3, 160, 4, 0.5

#: Members of a leader that one task verifies; growth of the number of leaders by round.
SALT_ROWS, GROWTH = 20_000, 16

SKETCH = "doc_id long, hi long, lo long, size int, bands array<long>"
SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])


def fast_sketch(elements: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """Sketches, one row of t values for each row's elements[bounds[i]:bounds[i + 1]]; no elements leave the row at the maximum."""
    n = len(bounds) - 1
    empty = np.uint64(K.MASK)
    out = np.full(n * t, empty)
    rows = np.repeat(np.arange(n), np.diff(bounds))
    active = elements
    for i in range(2 * t):
        if not len(active):
            break
        x = K.mix(active ^ K.seed(i))
        bins = (((x >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        value = (np.uint64(i) << np.uint64(52)) | (K.mix(x) >> np.uint64(12))
        np.minimum.at(out, rows * t + bins, value)
        open_ = (out.reshape(n, t) == empty).any(axis=1)
        left = open_[rows]
        if not left.all():
            active, rows = active[left], rows[left]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, r: int) -> np.ndarray:
    n, t = sketch.shape
    bands = sketch.reshape(n, t // r, r)
    out = np.broadcast_to(K.mix(np.arange(1, t // r + 1, dtype=np.uint64) * np.uint64(K.GOLDEN)), (n, t // r)).copy()
    for i in range(r):
        out = K.mix(out * np.uint64(K.BASE) + bands[:, :, i])
    return out


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _set_sizes(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distinct elements of each row."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((elements, rows))
    e, r = elements[order], rows[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=len(bounds) - 1).astype(np.int32)


def _sketches(k: int, t: int, r: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column(1))
            for a, b in K.passes(offsets):
                own = offsets[a : b + 1] - offsets[a]
                elements, first = K.shingles(*K.words(data[offsets[a] : offsets[b]], own), k)
                some = np.flatnonzero(np.diff(first))
                if not len(some):
                    continue
                bounds = np.concatenate([first[some], first[-1:]])
                place = (np.arange(first[-1]) - np.repeat(bounds[:-1], np.diff(bounds))).astype(np.uint64)
                digest = [np.add.reduceat(K.mix(elements * np.uint64(K.BASE) + (place + np.uint64(1)) * K.seed(s)), bounds[:-1]) for s in (1, 2)]
                keys = band_keys(fast_sketch(elements, bounds, t), r)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(some)), *(pa.array(d.view(np.int64)) for d in digest), pa.array(_set_sizes(elements, bounds)), list_array(keys.reshape(-1), np.arange(len(some) + 1) * keys.shape[1])],
                    names=["doc_id", "hi", "lo", "size", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column(1))
            for a, b in K.passes(offsets):
                own = offsets[a : b + 1] - offsets[a]
                elements, first = K.shingles(*K.words(data[offsets[a] : offsets[b]], own), k)
                rows = np.repeat(np.arange(b - a), np.diff(first))
                order = np.lexsort((elements, rows))
                elements, rows = elements[order], rows[order]
                new = np.ones(len(rows), bool)
                new[1:] = (elements[1:] != elements[:-1]) | (rows[1:] != rows[:-1])
                elements, rows = elements[new], rows[new]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), list_array(elements, np.searchsorted(rows, np.arange(b - a + 1)))], names=["doc_id", "shingles"])

    return run


MEMBERS = "key long, doc_id long, size int, at long, least long, least_size int, pid int, last long, last_at long, last_least long, last_least_size int"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc_id, size) in order -> each with its place in its bucket and the bucket's least member, without the buckets of one row; and at last a row of the partition's ends.

    Places and least members are those within the partition; what began in an earlier one is settled afterwards.
    """
    pid, first, held = TaskContext.get().partitionId(), None, None
    key0, run = None, (0, 0, 0)  # the open bucket: its least member, that one's size, and its rows so far
    last_row = None
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    names = [x.split()[0] for x in MEMBERS.split(", ")]

    def rows(columns: list, ends: tuple = (None,) * 4) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*columns, [pid] * n, *([e] * n for e in ends)], kinds)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new = np.ones(len(key), bool)  # not a repetition of the row before
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (size[1:] != size[:-1])
        new[0] = (int(key[0]), int(doc[0]), int(size[0])) != last_row
        last_row = (int(key[-1]), int(doc[-1]), int(size[-1]))
        if not new.any():
            continue
        key, doc, size = key[new], doc[new], size[new]
        if first is None:
            first = (int(key[0]), int(doc[0]), int(size[0]))
        starts = np.flatnonzero(np.concatenate([[int(key[0]) != key0], key[1:] != key[:-1]]))
        goes_on = not len(starts) or starts[0] > 0
        begin = np.concatenate([[0], starts]) if goes_on else starts
        lengths = np.diff(np.append(begin, len(key)))
        least, least_size, before = doc[begin].copy(), size[begin].copy(), np.zeros(len(begin), np.int64)
        if goes_on:
            least[0], least_size[0], before[0] = run
        at = np.arange(len(key)) - np.repeat(begin, lengths) + np.repeat(before, lengths)
        whole = lengths + before
        many = np.repeat(whole > 1, lengths)
        if goes_on and before[0] == 1 and held is not None:  # the open bucket's first row, now that there is a second
            yield rows([[x] for x in held])
        columns = [key, doc, size, at, np.repeat(least, lengths), np.repeat(least_size, lengths)]
        yield rows([c[many] for c in columns])
        key0, run = int(key[-1]), (int(least[-1]), int(least_size[-1]), int(whole[-1]))
        held = tuple(int(c[-1]) for c in columns) if whole[-1] == 1 else None
    if first is not None:
        yield rows([[first[0]], [first[1]], [first[2]], [0], [first[1]], [first[2]]], (key0, run[2], run[0], run[1]))


def buckets(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, doc_id, size, at, least, least_size) of each row of keyed(key, doc_id, size) in a bucket of several rows; at: its place there, from 0."""
    spark, order = keyed.sparkSession, ["key", "doc_id", "size"]
    swept = scratch.write(keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_sweep, MEMBERS), "swept")
    fixes, more, open_ = [], [], None  # open_: key, rows, least, its size of the bucket that the partition before ends with
    for e in swept.where("last is not null").orderBy("pid").collect():  # one row a partition
        key, rows, least, size = e["last"], e.last_at, e.last_least, e.last_least_size
        if open_ and open_[0] == e.key:
            fixes.append((e.key, e.pid, *open_[1:]))
            # A row that is alone in its partition, on either side of the edge, hasn't come out of the sweep; one that has comes twice, which is told apart.
            more += [(e.key, e.doc_id, e["size"], open_[1], open_[2], open_[3]), (e.key, open_[2], open_[3], 0, open_[2], open_[3])]
            if key == e.key:
                rows, least, size = open_[1] + rows, open_[2], open_[3]
        open_ = (key, rows, least, size)
    found = swept.where("last is null")
    if not fixes:
        return found.select("key", "doc_id", "size", "at", "least", "least_size")
    table = spark.createDataFrame(fixes, "key long, pid int, shift long, true_least long, true_size int")
    shifted = found.join(F.broadcast(table), ["key", "pid"], "left").select(
        "key", "doc_id", "size", (F.col("at") + F.coalesce("shift", F.lit(0))).alias("at"), F.coalesce("true_least", "least").alias("least"), F.coalesce("true_size", "least_size").alias("least_size")
    )
    return shifted.union(spark.createDataFrame(more, "key long, doc_id long, size int, at long, least long, least_size int"))


def _like_sizes(a: str, b: str, threshold: float):
    """Whether sets of these sizes can have a similarity of the threshold."""
    return F.least(a, b) >= F.lit(threshold) * F.greatest(a, b)


def _verified(pairs: DataFrame, rows: int, lowered: DataFrame, k: int, threshold: float, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (u, v) whose sets have at least the threshold as their exact Jaccard similarity."""
    ids = pairs.select(F.col("u").alias("doc_id")).union(pairs.select(F.col("v").alias("doc_id"))).distinct()
    sets = lowered.join(sized(ids, 2 * rows), "doc_id", "left_semi").mapInArrow(_sets(k), SETS)
    u, v = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "uv")
    heavy = scratch.write(pairs.groupBy("v").count().where(F.col("count") > SALT_ROWS).select("v", F.ceil(F.col("count") / SALT_ROWS).cast("int").alias("salts")), f"{name}-heavy")
    on = ["v"]
    if n := heavy.count():
        parts = F.coalesce("salts", F.lit(1))
        pairs = pairs.join(sized(heavy, n), "v", "left").select("u", "v", F.pmod(F.xxhash64("u"), parts).cast("int").alias("salt"))
        v = v.join(sized(heavy, n), "v", "left").select("v", "sv", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
        on = ["v", "salt"]
    both = F.size(F.array_intersect("su", "sv"))
    near = pairs.join(u, "u").join(v, on).where(both >= F.lit(threshold) * (F.size("su") + F.size("sv") - both))
    return scratch.write(near.select("u", "v"), name)


def near_duplicates(documents: DataFrame, k: int = SHINGLE, t: int = COORDINATES, r: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, duplicate_of) for each document that is not the least doc_id of its group of near copies.

    Only the columns doc_id (of a whole-number type, else a TypeError) and text are read, so others may have any name. Rows without a doc_id, and texts that are null or hold no
    word, are in no group. Rows that repeat a doc_id stand for one document that has all their texts: it is near whatever one of them is near. A text of fewer
    than k words is a single shingle; a very long one is taken whole. A similarity equal to the threshold is near. Ties in doc_id order can't occur; an empty table gives no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "neardup")
    lowered = documents.where("doc_id is not null and text is not null").select(doc_id(documents).alias("doc_id"), F.lower("text").alias("text"))
    sketches = scratch.write(lowered.mapInArrow(_sketches(k, t, r), SKETCH), "sketches")

    # Of equal texts only the least doc_id's row goes on; a doc_id's other texts stay.
    same = scratch.write(sketches.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), "same")
    met = sketches.select("doc_id", "hi", "lo").join(sized(same, same.count()), ["hi", "lo"]).where("doc_id <> rep")
    copies = scratch.write(met.select("doc_id", "hi", "lo", "rep").distinct(), "copies")
    exact = copies.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    reps = sketches.join(sized(copies.select("doc_id", "hi", "lo"), copies.count()), ["doc_id", "hi", "lo"], "left_anti")

    members = scratch.write(buckets(reps.select(F.explode("bands").alias("key"), "doc_id", "size"), scratch), "members")
    scratch.release("sketches", "same", "swept")
    pairs = members.where((F.col("doc_id") != F.col("least")) & _like_sizes("size", "least_size", threshold)).select(F.col("doc_id").alias("u"), F.col("least").alias("v"))
    pairs = scratch.write(pairs.distinct(), "led")
    near = [_verified(pairs, pairs.count(), lowered, k, threshold, scratch, "near-0")]

    # Buckets that still hold several components: as many leaders more in each round, against the members after them. Only these
    # buckets go on, and only the roots that a round's links merge change.
    roots = components(near[0], scratch, "roots").withColumnsRenamed({"u": "doc_id"})
    placed = members.join(roots, "doc_id", "left").select("key", "doc_id", "size", "at", F.coalesce("root", "doc_id").alias("root"))
    done, rounds = 1, 0
    while True:
        rounds += 1
        mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("at").alias("top")).where((F.col("low") < F.col("high")) & (F.col("top") > done)).select("key")
        split = scratch.write(placed.join(mixed, "key"), f"split-{rounds}")
        if split.isEmpty():
            break
        a = split.where(F.col("at").between(done, done * GROWTH - 1)).select("key", F.col("doc_id").alias("v"), F.col("root").alias("rv"), F.col("size").alias("nv"), F.col("at").alias("av"))
        b = split.select("key", F.col("doc_id").alias("u"), F.col("root").alias("ru"), F.col("size").alias("nu"), F.col("at").alias("au"))
        across = a.join(b, "key").where((F.col("au") > F.col("av")) & (F.col("ru") != F.col("rv")) & (F.col("u") != F.col("v")) & _like_sizes("nu", "nv", threshold))
        across = scratch.write(across.select("u", "v", "ru", "rv").distinct(), f"across-{rounds}")
        placed = split
        if n := across.count():
            found = _verified(across.select("u", "v"), n, lowered, k, threshold, scratch, f"near-{rounds}")
            near.append(found)
            merged = components(found.join(across, ["u", "v"]).select(F.col("ru").alias("u"), F.col("rv").alias("v")), scratch, f"merged-{rounds}").withColumnsRenamed({"u": "old", "root": "new"})
            placed = split.join(merged, F.col("root") == F.col("old"), "left").select("key", "doc_id", "size", "at", F.coalesce("new", "root").alias("root"))
        done *= GROWTH
    scratch.release("members")
    edges = exact
    for found in near:
        edges = edges.union(found)
    groups = components(edges, scratch, "groups")
    return groups.where("u <> root").select(F.col("u").alias("doc_id"), F.col("root").alias("duplicate_of"))


def drop_near_duplicates(documents: DataFrame, **parameters) -> DataFrame:
    """The rows of documents with one document of each group left; of rows with equal doc_id and text, one stays.

    Rows with a null doc_id all stay. All columns are kept as they are, whatever they are called.
    """
    gone = Scratch(documents.sparkSession, "neardup-gone").write(near_duplicates(documents, **parameters).select("doc_id"), "ids")
    left = documents.join(sized(gone, gone.count()), "doc_id", "left_anti").select(*documents.columns)
    ids = documents.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = Scratch(documents.sparkSession, "neardup-repeated").write(ids, "ids")
    if not (n := repeated.count()):
        return left
    once = left.join(sized(repeated, n), "doc_id", "left_anti").select(*documents.columns)
    return once.union(left.join(sized(repeated, n), "doc_id", "left_semi").select(*documents.columns).dropDuplicates(["doc_id", "text"]))


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
