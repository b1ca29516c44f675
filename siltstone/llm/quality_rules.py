"""Quality rules by isolation forest over rule statistics.

Each document has the usual rule statistics: words, word length, shares of capitals, digits, symbols and repeats,
sentence ends, lines. A forest of random axis-parallel splits is grown on labelled rows, all of them: half of the good ones are dealt out
to the trees, each to at least one, and the other half and its bad rows give the threshold; a document's anomaly is 2 ** (-mean path length / c). Statistics count as deviations from the mean of good rows, shrunk
towards it where a document has few words to show for them. Trees are grown on rows that are labelled good, over
ranges widened by MARGIN, so that what lies outside of what good documents do is cut off early. The
threshold is the one that tells labelled rows apart best while it rejects at most MAX_GOOD_LOST of the good ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import _features
from siltstone.llm import _kernels as K
from siltstone.llm._scratch import Scratch, doc_id, sized
from siltstone.llm.packing import _numbered

#: SAMPLE: rows of a tree, or more where TREES times as many would leave rows out.
TREES, SAMPLE, DEPTH, MARGIN, SEED = 200, 256, 10, 1.0, 11
#: Words and characters at which the deviations of shares of them count half.
SHRINK, SHRINK_CHARS = 30, 180
#: Statistics that the rules judge: not the length, nor the digits and signs of personal data and prices, which other operators look after.
JUDGED = [i for i, name in enumerate(_features.DOC_FEATURES) if name not in ("log_words", "log_chars", "log_lines", "log_line_words", "short_lines", "digit", "inner")]
MAX_GOOD_LOST = 0.003


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, quality) of at most rows labelled documents, those of the least hash of doc_id; null labels are left out."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(doc_id(labels).alias("_id")).agg(F.max("quality").alias("quality"))
    ids = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = documents.where("text is not null").select(doc_id(documents).alias("_id"), "text")
    # Of rows that repeat a doc_id the least text counts, so that the sample is bounded whatever the table holds.
    return texts.join(sized(ids, rows), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))


def first_half(ids: np.ndarray, good: np.ndarray) -> np.ndarray:
    """True for every second row of each label in the order of the hash of its id, so that both halves have both labels."""
    order = np.lexsort((K.mix(ids.astype(np.uint64)), good))
    out = np.zeros(len(ids), bool)
    out[order[0::2]] = True
    return out


def measured(documents: DataFrame) -> DataFrame:
    """(id, mixed, known, features) of each row: its doc_id, a hash in the order of first_half(), whether it has a text, its statistics."""
    width = len(_features.DOC_FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, (_, _, _, doc) in _features.measured(batch.column(1), "documents"):
                ids, texts = (batch.column(i).slice(a, b - a) for i in range(2))
                mixed = K.mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)) ^ np.uint64(1 << 63)
                features = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * width), pa.array(doc.reshape(-1)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(mixed.view(np.int64)), texts.is_valid(), features], names=["id", "mixed", "known", "features"])

    return documents.select(doc_id(documents).alias("id"), "text").mapInArrow(run, "id long, mixed long, known boolean, features array<double>")


def labelled(rows: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, good, half, features) of every labelled row of measured(); half is first_half(). Of rows that repeat a doc_id the least statistics count."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(doc_id(labels).alias("id")).agg(F.max("quality").cast("long").alias("quality"))
    once = rows.where("id is not null and known").join(known, "id").groupBy("id", "mixed").agg(F.min("features").alias("features"), F.first("quality").alias("quality"))
    ranked, _ = _numbered(once.select("id", "mixed", (F.col("quality") > 0).alias("good"), "features").orderBy("good", "mixed"), scratch, "labelled")
    return ranked.select("id", "good", (F.col("n") % 2 == 0).alias("half"), "features")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(rows: DataFrame, function: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of function's rows over the features of all rows; one row a task goes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [function(_matrix(batch.column(0))).sum(axis=0) for batch in batches if batch.num_rows]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(found, axis=0).tolist()], pa.list_(pa.float64()))], names=["sums"])

    return np.sum([r.sums for r in rows.select("features").mapInArrow(run, "sums array<double>").collect()], axis=0)


#: Statistics that are shares of a document's characters: these, not the words, are what they rest on.
OF_CHARS = np.array([name in ("upper", "digit", "symbol", "inner", "stops", "letters") for name in _features.DOC_FEATURES])


def deviations(features: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """How far each judged statistic is from the mean of good rows, in their deviations, shrunk where there is little to rest it on."""
    words, chars = (np.expm1(features[:, _features.DOC_FEATURES.index(n)])[:, None] for n in ("log_words", "log_chars"))
    evidence = np.where(OF_CHARS, chars / (chars + SHRINK_CHARS), words / (words + SHRINK))
    return ((features - mean) / spread * evidence)[:, JUDGED]


def grow(good: np.ndarray, trees: int = TREES, sample: int = SAMPLE, depth: int = DEPTH, seed: int = SEED) -> dict[str, np.ndarray]:
    """Trees as arrays of 2 ** (depth + 1) - 1 nodes: the feature of a split (-1: a leaf), its value, a leaf's path length."""
    rng = np.random.default_rng(seed)
    nodes = (1 << (depth + 1)) - 1
    feature, value, length = np.full((trees, nodes), -1, np.int16), np.zeros((trees, nodes)), np.zeros((trees, nodes), np.float32)
    spread = good.std(axis=0) if len(good) else np.zeros(1)
    for t in range(trees):
        grow_tree(good[rng.permutation(len(good))[:sample]], spread, rng, depth, feature[t], value[t], length[t])
    return {"feature": feature, "value": value, "length": length}


def grow_tree(rows: np.ndarray, spread: np.ndarray, rng: np.random.Generator, depth: int, feature: np.ndarray, value: np.ndarray, length: np.ndarray) -> None:
    """Fills in the nodes of one tree, grown on all the rows; spread: the margins' unit."""
    stack = [(0, rows, 0)]
    while stack:
        at, own, d = stack.pop()
        open_ = np.flatnonzero((np.ptp(own, axis=0) > 0) if len(own) > 1 else np.zeros(rows.shape[1], bool))
        if d == depth or not len(open_):
            length[at] = d + average_path(len(own))
            continue
        f = open_[rng.integers(len(open_))]
        lo, hi = own[:, f].min() - MARGIN * spread[f], own[:, f].max() + MARGIN * spread[f]
        cut = rng.uniform(lo, hi)
        feature[at], value[at] = f, cut
        below = own[:, f] < cut
        stack += [(2 * at + 1, own[below], d + 1), (2 * at + 2, own[~below], d + 1)]


def trees_of(ids: np.ndarray, share: int, trees: int = TREES) -> np.ndarray:
    """For each id, share different trees, from a hash: every row is in some, and with a share of trees in all."""
    steps = np.array([s for s in range(1, trees) if np.gcd(s, trees) == 1], np.uint64)
    hash_ = K.mix(ids.astype(np.uint64) ^ K.seed(SEED))
    step = steps[(hash_ >> np.uint64(32)) % np.uint64(len(steps))]
    return ((hash_ % np.uint64(trees))[:, None] + step[:, None] * np.arange(share, dtype=np.uint64)) % np.uint64(trees)


def grow_all(rows: DataFrame, n: int, mean: np.ndarray, spread: np.ndarray) -> dict:
    """The forest of all n rows (id, features): each is dealt to so many trees that a tree has SAMPLE rows or more, and each tree is a task's."""
    share = min(TREES, max(1, -(-TREES * SAMPLE // n)))
    both = _sums(rows, lambda x: np.hstack([d := deviations(x, mean, spread), d**2])).reshape(2, -1) / n
    margin = np.sqrt(np.maximum(both[1] - both[0] ** 2, 0))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = deviations(_matrix(batch.column(1)), mean, spread)
            trees = trees_of(batch.column(0).to_numpy(), share).astype(np.int32)
            for j in range(share):
                own = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(trees[:, j]), own], names=["tree", "row"])

    def one(table: pa.Table) -> pa.Table:
        tree, own = table["tree"][0].as_py(), _matrix(table["row"].combine_chunks())
        nodes = (1 << (DEPTH + 1)) - 1
        parts = np.full(nodes, -1, np.int16), np.zeros(nodes), np.zeros(nodes, np.float32)
        grow_tree(own, margin, np.random.default_rng([SEED, tree]), DEPTH, *parts)
        return pa.table({"tree": pa.array([tree], pa.int32()), **{k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(("feature", "value", "length"), parts)}})

    dealt = rows.select("id", "features").mapInArrow(deal, "tree int, row array<double>")
    found = dealt.groupBy("tree").applyInArrow(one, "tree int, feature binary, value binary, length binary").collect()
    found.sort(key=lambda r: r.tree)
    kinds = {"feature": np.int16, "value": np.float64, "length": np.float32}
    return {k: np.array([np.frombuffer(r[k], kind) for r in found]) for k, kind in kinds.items()} | {"mean": mean, "spread": spread, "sample": max(SAMPLE, -(-n * share // TREES))}


def average_path(n: int) -> float:
    """The mean path length of an unsuccessful search in a binary search tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def anomaly(rows: np.ndarray, forest: dict[str, np.ndarray], sample: int = SAMPLE) -> np.ndarray:
    """0 to 1: 2 ** (-mean path length / that of a random sample)."""
    total = np.zeros(len(rows))
    index = np.arange(len(rows))
    for feature, value, length in zip(forest["feature"], forest["value"], forest["length"]):
        at = np.zeros(len(rows), np.int64)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            right = rows[index, np.maximum(f, 0)] >= value[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        total += length[at]
    return 2.0 ** (-total / max(len(forest["feature"]), 1) / average_path(sample))


def judged(features: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    return anomaly(deviations(features, model["mean"], model["spread"]), model, model["sample"])


def calibrated(scores: np.ndarray, good: np.ndarray, most_lost: float = MAX_GOOD_LOST) -> float:
    """The threshold of the best balanced accuracy among those that lose at most most_lost of the good rows; scores above it are rejected."""
    if not good.any():
        return np.inf
    least = np.quantile(scores[good], 1 - most_lost, method="higher")
    if good.all():
        return float(least)
    cuts = np.unique(np.concatenate([[least], scores[scores >= least]]))
    kept = np.array([(scores[good] <= c).mean() + (scores[~good] > c).mean() for c in cuts])
    best = cuts[kept >= kept.max() - 1e-12]
    higher = scores[scores > best[0]]
    # Half way to the next score, so that a row like the last kept one is kept.
    return float((best[0] + higher.min()) / 2) if len(higher) else float(best[0])


def threshold(scored: DataFrame, n_good: int, n_bad: int, most_lost: float = MAX_GOOD_LOST) -> float:
    """calibrated() over a table (anomaly, good) of n_good good and n_bad bad rows.

    The driver sees the most_lost highest scores of good rows, which are the thresholds to choose from, and between each two the number and least score of bad rows.
    """
    if not n_good:
        return float("inf")
    lost = n_good - int(np.ceil((n_good - 1) * (1 - most_lost)))
    top = np.array([r.anomaly for r in scored.where("good").orderBy(F.desc("anomaly")).limit(lost).select("anomaly").collect()])
    cuts = np.unique(top)
    if not n_bad:
        return float(cuts[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = batch.column(0).to_numpy(zero_copy_only=False)
            at, first, k = np.unique(np.searchsorted(cuts, np.sort(scores)), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(k), pa.array(np.sort(scores)[first])], names=["at", "k", "least"])

    between = scored.where("not good").select("anomaly").mapInArrow(run, "at long, k long, least double").groupBy("at").agg(F.sum("k").alias("k"), F.min("least").alias("least")).collect()
    bad, least = np.zeros(len(cuts) + 1), np.full(len(cuts) + 1, np.inf)
    for r in between:
        bad[r["at"]], least[r["at"]] = r.k, r.least
    above = bad[::-1].cumsum()[::-1][1:]
    kept = np.array([(n_good - (top > c).sum()) / n_good for c in cuts]) + above / n_bad
    best = int(np.flatnonzero(kept >= kept.max() - 1e-12)[0])
    higher = min([*cuts[best + 1 : best + 2], least[best + 1 :].min()])
    # Half way to the next score, so that a row like the last kept one is kept.
    return float((cuts[best] + higher) / 2) if np.isfinite(higher) else float(cuts[best])


def fit(rows: DataFrame, labels: DataFrame, scratch: Scratch) -> dict:
    """Forest and threshold from every labelled row of measured(): grown on one half's good rows, calibrated on the whole of the other half."""
    known = labelled(rows, labels, scratch)
    counts = {(r.half, r.good): r["count"] for r in known.groupBy("half", "good").count().collect()}
    n = lambda half, good: sum(k for (h, g), k in counts.items() if h in half and g is good)
    own = (True,) if n((True,), True) else (True, False)
    held = (False,) if n((False,), True) else (True, False)
    grown, many = known.where(F.col("good") & F.col("half").isin(*own)), n(own, True)
    if many < 2:
        return {"forest": None, "threshold": float("inf")}
    mean = _sums(grown, lambda x: x) / many
    spread = np.sqrt(_sums(grown, lambda x: (x - mean) ** 2) / many) + 1e-3
    forest = grow_all(grown, many, mean, spread)
    scored = scratch.write(score(known.where(F.col("half").isin(*held)).select(F.col("good").alias("key"), "features"), forest).withColumnRenamed("key", "good"), "scored")
    return {"forest": forest, "threshold": threshold(scored, n(held, True), n(held, False))}


def score(rows: DataFrame, forest: dict | None) -> DataFrame:
    """(key, anomaly) for each of the rows (key, features)."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = judged(_matrix(batch.column(1)), shared.value) if shared.value is not None and batch.num_rows else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["key", "anomaly"])

    return rows.mapInArrow(run, f"key {rows.dtypes[0][1]}, anomaly double")


def judge_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, anomaly, rejected) for each row of documents.

    A null text is measured as an empty one: no words, no lines. Without any good labelled row nothing is rejected.
    Repeated rows and null doc_ids each have a row. Labels are joined by doc_id, of repeated ones the greatest
    counts; of a labelled doc_id's rows, the least statistics. An anomaly equal to the threshold is kept. Very long texts are measured whole. Only doc_id (of a whole-number type, else a TypeError) and
    text, and doc_id and quality of labels, are read, so other columns may have any name; an empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "rules")
    rows = scratch.write(measured(documents), "measured")
    model = fit(rows, labels, scratch)
    found = score(rows.select(F.col("id").alias("key"), "features"), model["forest"])
    return found.select(F.col("key").alias("doc_id"), "anomaly", (F.col("anomaly") > F.lit(model["threshold"])).alias("rejected"))


def drop_rejected(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that judge_documents() doesn't reject, all columns as they are, whatever they are called; no rows give none."""
    scratch = Scratch(documents.sparkSession, "rules")
    model = fit(scratch.write(measured(documents), "measured"), labels, scratch)
    forest = documents.sparkSession.sparkContext.broadcast(model["forest"])
    threshold, at = model["threshold"], documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, (_, _, _, doc) in _features.measured(batch.column(at), "documents"):
                keep = judged(doc, forest.value) <= threshold if forest.value is not None else np.ones(b - a, bool)
                yield batch.slice(a, b - a).filter(pa.array(keep))

    return documents.mapInArrow(run, documents.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
