"""Best-fit packing of documents into sequences of CAPACITY tokens, bulk-synchronous.

Size classes (octaves) are packed from the largest down, each by supersteps. A superstep range-sorts the class's
documents and the gaps together by falling size and sweeps every partition: a document takes the smallest gap of the
partition that holds it (its successor), and what is left of the gap can be taken again. Documents that find no gap in
their partition, and gaps left in it, keep their ranks, a gap of many times the class's size with several slots at once;
from the partitions' counts alone it then follows which rank of which partition takes which, as
brackets match, and one join carries it out. Gaps are updated and the step is repeated until it places nothing.
Only then new sequences are opened, no more than what is left needs at least, and the steps go on with these.
What fits one partition is packed one by one, and opens sequences, in one sweep.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm._scratch import Scratch, doc_id
from siltstone.llm.token_counts import TOKENIZER, Tokenizer

CAPACITY = 2048
#: Rows of documents and gaps that a partition of a sweep gets.
SWEEP_ROWS = 100_000

SWEPT = pa.schema([("kind", pa.int32()), ("pid", pa.int32()), ("rank", pa.int64()), ("id", pa.int64()), ("size", pa.int32()), ("bin", pa.int64()), ("slots", pa.int32())])
SWEPT_DDL = "kind int, pid int, rank long, id long, size int, bin long, slots int"
MATCHED, OPEN_DOC, OPEN_GAP = 0, 1, 2


def _sweep(hi: int, opens: tuple[int, int] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (is_doc, id, size) by falling size, gaps first -> matches, and what is open at the end with its rank.

    hi: the largest size of the class. opens: capacity and number of the next sequence, where documents without a gap open one.
    """

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, SWEPT.types)], schema=SWEPT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, alone, opened = TaskContext.get().partitionId(), 0, 0
        # (-gap, sequence, whether a document of this sweep is in it), so the smallest gaps are at the end.
        gaps: list[tuple[int, int, bool]] = []
        for batch in batches:
            out = []
            for is_doc, id_, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not is_doc:
                    insort(gaps, (-size, id_, False))
                    continue
                at = bisect_left(gaps, (1 - size,)) - 1
                if at >= 0:
                    gap, sequence, _ = gaps.pop(at)
                elif opens:
                    gap, sequence = -opens[0], opens[1] + opened
                    opened += 1
                else:
                    out.append((OPEN_DOC, pid, alone, id_, size, None, 0))
                    alone += 1
                    continue
                out.append((MATCHED, pid, 0, id_, size, sequence, 0))
                if gap + size:
                    insort(gaps, (gap + size, sequence, True))
            yield rows(out)
        out, rank = [], 0
        while gaps and not opens:
            gap, sequence, used = gaps.pop()
            # An unused gap holds one document of any later partition, whatever its size.
            slots = max(-gap // hi, int(not used))
            if slots:
                out.append((OPEN_GAP, pid, rank, None, 0, sequence, slots))
                rank += slots
            if len(out) == 10_000:
                yield rows(out)
                out = []
        yield rows(out)

    return run


def _brackets(docs: dict[int, int], slots: dict[int, int]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """Which open documents take which open slots, from their counts by partition.

    (doc pid, first doc rank, past it, gap pid, first slot rank) for each stretch, and the open documents' taken by partition.
    """
    plan, taken, stack = [], {}, []
    for pid in sorted({*docs, *slots}):
        at, left = 0, docs.get(pid, 0)
        while left and stack:
            gap_pid, used, n = stack[-1]
            take = min(left, n)
            plan.append((pid, at, at + take, gap_pid, used))
            at, left = at + take, left - take
            if take == n:
                stack.pop()
            else:
                stack[-1] = (gap_pid, used + take, n - take)
        taken[pid] = at
        if slots.get(pid):
            stack.append((pid, 0, slots[pid]))
    return plan, taken


def _numbered(df: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """df with a dense column n from 0, and its rows; one small row a partition goes to the driver."""
    at = scratch.write(df.withColumn("_m", F.monotonically_increasing_id()), name)
    pid, counts, total = F.shiftright("_m", 33), [], 0
    for row in at.groupBy(pid.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        counts.append((row.p, total))
        total += row.n
    offsets = df.sparkSession.createDataFrame(counts, "_p long, _o long")
    return at.join(F.broadcast(offsets), pid == F.col("_p")).withColumn("n", F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_o"), total


def _taken(swept: DataFrame, plan: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """(id, size, bin) of a sweep: its own matches and those of the plan over its partitions' open rows."""
    here = swept.where(F.col("kind") == MATCHED).select("id", "size", "bin")
    if not plan:
        return here
    spark = swept.sparkSession
    stretch = F.broadcast(spark.createDataFrame(plan, "p int, a long, b long, gap_pid int, first long"))
    docs = swept.where(F.col("kind") == OPEN_DOC).join(stretch, (F.col("pid") == F.col("p")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b"))).select("id", "size", "gap_pid", (F.col("first") + F.col("rank") - F.col("a")).alias("slot"))
    most: dict[int, int] = {}
    for _, a, b, p, first in plan:
        most[p] = max(most.get(p, 0), first + b - a)
    used = F.broadcast(spark.createDataFrame(list(most.items()), "p int, most long"))
    cells = swept.where(F.col("kind") == OPEN_GAP).join(used, F.col("pid") == F.col("p")).where("rank < most").select(F.col("pid").alias("gap_pid"), "bin", F.explode(F.sequence(F.col("rank"), F.least(F.col("rank") + F.col("slots"), F.col("most")) - 1)).alias("slot"))
    return here.union(docs.join(cells, ["gap_pid", "slot"]).select("id", "size", "bin"))


def token_lengths(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n): each row's tokens, encoded where the row is read."""
    shared = documents.sparkSession.sparkContext.broadcast(Tokenizer.read(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.counts(batch.column(1).to_pylist()), pa.int64())], names=["doc_id", "n"])

    return documents.select(doc_id(documents).alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long")


def pack(documents: DataFrame, capacity: int = CAPACITY, tokens: str | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, chunk, n_tokens, sequence, offset) for each piece of each document.

    A document of more than capacity tokens, however long, is cut into full chunks, each a sequence of its own, and a rest; chunk counts the pieces
    from 0. Pieces of a sequence don't overlap and end at or below capacity; offset is where a piece begins. tokens:
    a column of lengths; without it, texts are encoded whole by the tokenizer. Documents of no tokens (null and empty texts, null or negative lengths)
    are left out. Repeated rows, and rows with a null doc_id, are each packed. Ties in size go by order of reading. An empty table
    gives no rows. Only doc_id (of a whole-number type, else a TypeError) and text or tokens are read, so other columns may have any name.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    counted = documents.select(doc_id(documents).alias("doc_id"), F.col(f"`{tokens}`").cast("long").alias("n")) if tokens else token_lengths(documents, tokenizer)
    lengths = scratch.write(counted.where("n > 0").withColumn("id", F.monotonically_increasing_id()), "lengths")
    full = lengths.where(F.col("n") >= capacity).select("doc_id", F.explode(F.sequence(F.lit(0), (F.floor(F.col("n") / capacity) - 1).cast("int"))).alias("chunk"))
    full, sequences = _numbered(full, scratch, "full")
    out = [full.select("doc_id", "chunk", F.lit(capacity).alias("n_tokens"), F.col("n").alias("sequence"), F.lit(0).alias("offset"))]
    rests = scratch.write(lengths.where(F.col("n") % capacity > 0).select("id", "doc_id", F.floor(F.col("n") / capacity).cast("int").alias("chunk"), (F.col("n") % capacity).cast("int").alias("size")), "rests")

    # floor(log2(capacity / size)), in whole numbers.
    octave = F.length(F.bin(F.floor(F.lit(capacity) / F.col("size")).cast("long"))) - 1
    classes = {r.c: r.k for r in rests.groupBy(octave.alias("c")).agg(F.count("*").alias("k")).collect()}
    placed: list[DataFrame] = []
    gaps, n_gaps, step = spark.createDataFrame([], "bin long, gap int"), 0, 0

    def fresh(n: int) -> DataFrame:
        return spark.range(sequences, sequences + n).select(F.col("id").alias("bin"), F.lit(capacity).cast("int").alias("gap"))

    for c in sorted(classes):
        # Sizes of class c are above low and at most hi.
        hi, low = max(1, capacity >> c), capacity >> (c + 1)
        left, n_left = rests.where(octave == c).select("id", "size"), classes[c]
        n_smaller = sum(k for x, k in classes.items() if x > c)
        last = n_left + n_smaller + n_gaps <= SWEEP_ROWS
        if last:
            left, n_left, low = rests.where(octave >= c).select("id", "size"), n_left + n_smaller, 0
        # Whether no gap holds any of the documents left.
        tried = not n_gaps
        while n_left:
            step += 1
            alone = n_left + (0 if tried else n_gaps) <= SWEEP_ROWS
            offered = gaps.where(F.lit(not tried) & (F.col("gap") > low))
            if tried and not alone:
                # At least as many as hold all the tokens, or all the documents by number: each of them is used.
                opening = max(-(-left.agg(F.sum("size")).first()[0] // capacity), -(-n_left // (capacity // (low + 1))))
                offered = fresh(opening)
                gaps, n_gaps, sequences = gaps.union(offered), n_gaps + opening, sequences + opening
                n_offered = opening
            else:
                n_offered = 0 if tried else n_gaps
            both = offered.select(F.lit(False).alias("is_doc"), F.col("bin").alias("id"), F.col("gap").alias("size")).union(left.select(F.lit(True), "id", "size"))
            width = 1 if alone else max(1, -(-(n_left + n_offered) // SWEEP_ROWS))
            order = [F.desc("size"), F.asc("is_doc"), F.asc("id")]
            sweep = _sweep(hi, (capacity, sequences) if alone else None)
            swept = scratch.write(both.repartitionByRange(width, *order).sortWithinPartitions(*order).mapInArrow(sweep, SWEPT_DDL), f"swept-{step}")
            counts = swept.groupBy("kind", "pid").agg(F.count("*").alias("k"), F.sum("slots").alias("s"), F.max("bin").alias("b")).collect()
            plan, taken = _brackets({r.pid: r.k for r in counts if r.kind == OPEN_DOC}, {r.pid: r.s for r in counts if r.kind == OPEN_GAP})
            matched = sum(r.k for r in counts if r.kind == MATCHED) + sum(taken.values())
            tried = not matched
            if tried:
                continue
            if alone:
                opened = max(0, max(r.b for r in counts if r.kind == MATCHED) + 1 - sequences)
                gaps, sequences = gaps.union(fresh(opened)), sequences + opened
            here = _taken(swept, plan)
            if plan:
                here = scratch.write(here, f"taken-{step}")
            placed.append(here)
            n_left -= matched
            if last:
                break
            filled = here.groupBy("bin").agg(F.sum("size").alias("used"))
            gaps = scratch.write(gaps.join(filled, "bin", "left").select("bin", (F.col("gap") - F.coalesce("used", F.lit(0))).cast("int").alias("gap")).where("gap > 0"), f"gaps-{step}")
            n_gaps = gaps.count()
            open_docs = swept.where(F.col("kind") == OPEN_DOC)
            done = F.broadcast(spark.createDataFrame(list(taken.items()), "p int, t long")) if taken else None
            left = (open_docs.join(done, F.col("pid") == F.col("p")).where("rank >= t") if taken else open_docs).select("id", "size")
        if last:
            break

    if placed:
        every = placed[0]
        for more in placed[1:]:
            every = every.union(more)
        before = Window.partitionBy("bin").orderBy(F.desc("size"), "id").rowsBetween(Window.unboundedPreceding, -1)
        pieces = every.join(rests.select("id", "doc_id", "chunk"), "id").withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int"))
        out.append(pieces.select("doc_id", "chunk", F.col("size").alias("n_tokens"), F.col("bin").alias("sequence"), "offset"))
    return out[0] if len(out) == 1 else out[0].union(out[1])


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
