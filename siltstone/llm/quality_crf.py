"""Quality classifier: a linear-chain conditional random field over lines.

Each line of a document is good or bad. Its features are its own statistics and those of the lines before and
after it, standardised; two transition weights couple neighbours. The field is trained on a bounded sample of labelled
documents, whose lines take their document's label, by gradient ascent on the conditional likelihood (exact
forward-backward). A document's quality is the mean of its lines' marginal probabilities of being good, weighted by line length.
The threshold is calibrated on the half of the sample that the field isn't trained on. Each line's own label (good where its
marginal is at least a half) comes back as run lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import _features
from siltstone.llm._scratch import Scratch, doc_id
from siltstone.llm.quality_rules import calibrated, first_half, labelled_sample

#: The bound of the fit: labelled documents of each label that are trained and calibrated on, by least hash of doc_id.
LABELLED_ROWS = 3_000
#: Lines of that sample which the driver trains on by itself; more stay on the executors, since documents may be of any length.
LOCAL_LINES = 200_000
#: Lines, or one document's, that training has before it at once.
CHUNK_LINES = 100_000
EPOCHS, RATE, L2, MAX_GOOD_LOST = 150, 0.5, 1e-4, 0.003
BASE = len(_features.LINE_FEATURES)


def neighbours(line: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zeros at the ends), and marks of the ends."""
    n = len(line)
    before, after = np.zeros_like(line), np.zeros_like(line)
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    head[first[:-1]] = True
    tail[first[1:] - 1] = True
    before[1:] = line[:-1]
    before[head] = 0
    after[:-1] = line[1:]
    after[tail] = 0
    return np.hstack([line, before, after, head[:, None], tail[:, None]])


def marginals(score: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(probability of good for each line, expected same-label transitions good-good and bad-bad, log partition).

    score: the log odds of good for each line; transition: log weights of staying good and of staying bad. The chains of all rows are run
    side by side, longest first, so that each step is one vector operation over the rows that still have lines.
    """
    rows = len(first) - 1
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, length = first[:-1][order], lengths[order]
    steps = int(length[0]) if rows else 0
    alive = [int(np.searchsorted(-length, -t, "left")) for t in range(steps)]  # rows with more than t lines
    gg, bb = transition
    forward = np.zeros((len(score), 2))  # log messages of (good, bad)
    for t in range(steps):
        k = alive[t]
        at = begin[:k] + t
        if t == 0:
            forward[at, 0], forward[at, 1] = score[at], 0.0
        else:
            g, b = forward[at - 1, 0], forward[at - 1, 1]
            forward[at, 0] = score[at] + np.logaddexp(g + gg, b)
            forward[at, 1] = np.logaddexp(g, b + bb)
    ends = first[1:] - 1
    log_z = np.logaddexp(forward[ends, 0], forward[ends, 1])
    backward = np.zeros((len(score), 2))
    expect = np.zeros(2)
    zrow = log_z[order]
    for t in range(steps - 2, -1, -1):
        k = alive[t + 1]
        at = begin[:k] + t
        g, b = backward[at + 1, 0] + score[at + 1], backward[at + 1, 1]
        backward[at, 0] = np.logaddexp(g + gg, b)
        backward[at, 1] = np.logaddexp(g, b + bb)
        expect[0] += np.exp(forward[at, 0] + gg + g - zrow[:k]).sum()
        expect[1] += np.exp(forward[at, 1] + bb + b - zrow[:k]).sum()
    both = forward + backward
    return 1.0 / (1.0 + np.exp(np.clip(both[:, 1] - both[:, 0], -500, 500))), expect, float(log_z.sum())


def document_quality(good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of the lines' probabilities weighted by their length; 0 where all lines are empty."""
    if len(first) < 2:
        return np.zeros(0)
    weight = np.add.reduceat(length, first[:-1])
    return np.add.reduceat(good * length, first[:-1]) / np.maximum(weight, 1) * (weight > 0)


def inputs(line: np.ndarray, first: np.ndarray, standard: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Standardised features of lines and their neighbours, and a constant."""
    x = neighbours((line - standard[0]) / standard[1], first)
    return np.hstack([x, np.ones((len(x), 1))])


def slope(x: np.ndarray, first: np.ndarray, label: np.ndarray, weights: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The gradient of the log likelihood of documents, by the weights and by the transitions. label: each document's."""
    good, expect, _ = marginals(x @ weights, first, transition)
    return np.concatenate([x.T @ (np.repeat(label, np.diff(first)) - good), stays(first, label) - expect])


def stays(first: np.ndarray, label: np.ndarray) -> np.ndarray:
    """How many pairs of neighbouring lines are both good, and both bad, where lines take their document's label."""
    pairs = np.diff(first) - 1
    return np.array([pairs[label].sum(), pairs[~label].sum()], float)


def ascend(gradient: Callable[[np.ndarray, np.ndarray], np.ndarray], lines: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions after epochs steps up the gradient (of the sum over lines)."""
    weights, transition = np.zeros(3 * BASE + 3), np.zeros(2)
    m, v = np.zeros(len(weights) + 2), np.zeros(len(weights) + 2)
    for step in range(1, epochs + 1):
        slope = gradient(weights, transition) / lines - L2 * np.append(weights, [0.0, 0.0])
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = RATE * (1 - step / (epochs + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights, transition = weights + 0.2 * move[:-2], transition + 0.2 * move[-2:]
    return weights, transition


def train(total: Callable[..., np.ndarray], epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Weights of the standardised features and of the transitions.

    total: sums a function of (line features, first lines, labels) over all documents; given a mean and spread, a function of inputs() in place of features.
    """
    sums = total(lambda line, first, label: np.append(line.sum(axis=0), len(line)))
    n = sums[-1]
    mean = sums[:-1] / n
    spread = np.sqrt(total(lambda line, first, label: ((line - mean) ** 2).sum(axis=0)) / n) + 1e-3
    weights, transition = ascend(lambda w, t: total(lambda x, first, label: slope(x, first, label, w, t), (mean, spread)), n, epochs)
    return {"mean": mean, "spread": spread, "weights": weights, "transition": transition}


def quality(line: np.ndarray, length: np.ndarray, first: np.ndarray, model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(each document's quality, each line's probability of being good)."""
    x = neighbours((line - model["mean"]) / model["spread"], first)
    good, _, _ = marginals(x @ model["weights"][:-1] + model["weights"][-1], first, model["transition"])
    return document_quality(good, length, first), good


def qualities(column, model: dict[str, np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, past the last, their qualities) of an Arrow string column, pass by pass."""
    for a, b, (line, length, first, _) in _features.measured(column, "lines"):
        yield a, b, quality(line, length, first, model)[0]


def label_runs(good: np.ndarray, first: np.ndarray) -> list[str]:
    """Per document, how many lines are good, then bad, then good, and so on: "3,2" is three good lines and two bad ones, "0,2" two bad ones."""
    at = np.unique(np.concatenate([first[:-1], np.flatnonzero(good[1:] != good[:-1]) + 1]))
    lengths = np.diff(np.append(at, len(good)))
    starts = np.append(np.searchsorted(at, first[:-1]), len(at))
    told = lengths.astype(str).tolist()
    return [("" if g else "0,") + ",".join(told[a:b]) for a, b, g in zip(starts[:-1], starts[1:], good[first[:-1]])]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, text, quality) -> (id, good, n, lines): the lines' features and lengths as the bytes of a table of n rows."""
    for batch in batches:
        for a, b, (line, length, first, _) in _features.measured(batch.column(1), "lines"):
            table = np.column_stack([line, length])
            lines = pa.array([table[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())
            good = pa.array(np.asarray(batch.column(2).slice(a, b - a)) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), good, pa.array(np.diff(first), pa.int64()), lines], names=["id", "good", "n", "lines"])


def _chunks(rows: Iterable[tuple[int, bool, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, line features, line lengths, first lines) of rows (id, good, lines), CHUNK_LINES or a document at a time."""

    def joined(some: list) -> tuple:
        tables = [np.frombuffer(r[2], float).reshape(-1, BASE + 1) for r in some]
        table = np.vstack(tables)
        first = np.cumsum([0, *map(len, tables)])
        return np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some], bool), table[:, :-1], table[:, -1], first

    some, n = [], 0
    for row in rows:
        own = len(row[2]) // (8 * (BASE + 1))
        if some and n + own > CHUNK_LINES:
            yield joined(some)
            some, n = [], 0
        some.append(row)
        n += own
    if some:
        yield joined(some)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, bytes]]:
    for batch in batches:
        for i, (id_, good) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            yield id_, good, batch.column(2)[i].as_py()


def _here(rows: list[tuple[int, bool, bytes]]) -> Callable[..., np.ndarray]:
    """Sums over the rows, for train()."""
    own = [(line, first, good) for _, good, line, _, first in _chunks(rows)]
    ready: list[tuple] = []

    def total(function: Callable, standard: tuple | None = None) -> np.ndarray:
        if standard and not ready:
            ready.extend((inputs(line, first, standard), first, good) for line, first, good in own)
        return np.sum([function(*chunk) for chunk in (ready if standard else own)], axis=0)

    return total


def _there(lines: DataFrame) -> Callable[..., np.ndarray]:
    """Sums over the documents of the table, for train(), each chunk where it lies: one row a task goes to the driver."""

    def total(function: Callable, standard: tuple | None = None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [function(inputs(line, first, standard) if standard else line, first, good) for _, good, line, _, first in _chunks(_rows(batches))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([np.sum(found, axis=0).tolist()], pa.list_(pa.float64()))], names=["sums"])

        return np.sum([r.sums for r in lines.mapInArrow(run, "sums array<double>").collect()], axis=0)

    return total


def fit(documents: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, epochs: int = EPOCHS) -> dict | None:
    """A trained field and its threshold; None unless there are labelled rows of both kinds in both halves of the sample.

    Texts stay where they are read. Of the sample the driver sees ids, labels and numbers of lines, then qualities; the lines' features
    only if they are at most LOCAL_LINES lines, otherwise each epoch is a job over them.
    """
    spark = documents.sparkSession
    bad, good = (labelled_sample(documents, labels.where(own), rows).select("_id", "text", F.col("quality").cast("long")) for own in (F.col("quality") <= 0, F.col("quality") > 0))
    scratch = Scratch(spark, "field")
    lines = scratch.write(bad.union(good).mapInArrow(_measured, "id long, good boolean, n long, lines binary"), "lines")
    heads = sorted(tuple(r) for r in lines.select("id", "good", "n").collect())
    ids, label = np.array([r[0] for r in heads], np.int64), np.array([r[1] for r in heads], bool)
    half = first_half(ids, label)
    if any(len(set(label[own])) < 2 for own in (half, ~half)):
        return None
    trained = {(r[0], r[1]): bool(h) for r, h in zip(heads, half)}
    lines, n = lines.select("id", "good", "lines"), sum(r[2] for r in heads)
    if n <= LOCAL_LINES:
        found = sorted(tuple(r) for r in lines.collect())
        model = train(_here([r for r in found if trained[r[:2]]]), epochs)
        held = [(q, g) for _, good, line, length, first in _chunks(r for r in found if not trained[r[:2]]) for q, g in zip(quality(line, length, first, model)[0], good)]
    else:
        halves = F.broadcast(spark.createDataFrame([(*key, h) for key, h in trained.items()], "id long, good boolean, half boolean"))
        own = lines.join(halves, ["id", "good"])
        # Few tasks an epoch, each of about one chunk.
        model = train(_there(scratch.write(own.where("half").drop("half").repartition(-(-n // CHUNK_LINES), "id"), "trained")), epochs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, good, line, length, first in _chunks(_rows(batches)):
                yield pa.RecordBatch.from_arrays([pa.array(quality(line, length, first, model)[0]), pa.array(good)], names=["quality", "good"])

        held = [tuple(r) for r in own.where("not half").drop("half").mapInArrow(run, "quality double, good boolean").collect()]
    found, label = np.array([q for q, _ in held]), np.array([g for _, g in held], bool)
    return model | {"threshold": 1 - calibrated(1 - found, label, MAX_GOOD_LOST)}


def classify(documents: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, quality, good, line_runs) for each row of documents; line_runs are label_runs() of its lines.

    A null or empty text has quality 0, is not good, and has one empty line, labelled like any other. Where labels don't hold both kinds, quality and line_runs are null and
    every row is good. A quality equal to the threshold is good, as is a line of a probability of a half. Very long texts are measured whole. Repeated rows and null doc_ids each have a row. A document with labels of both kinds
    is trained on as both. Only doc_id (of a whole-number type, else a TypeError) and text, and doc_id and quality of labels, are read, so other columns may have any name; an empty table gives no rows.
    """
    model = fit(documents, labels, rows)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = shared.value
            if model is None:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.nulls(n, pa.float64()), pa.array(np.ones(n, bool)), pa.nulls(n, pa.string())], names=["doc_id", "quality", "good", "line_runs"])
                continue
            for a, b, (line, length, first, _) in _features.measured(batch.column(1), "lines"):
                found, lines = quality(line, length, first, model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found), pa.array(found >= model["threshold"]), pa.array(label_runs(lines >= 0.5, first), pa.string())], names=["doc_id", "quality", "good", "line_runs"])

    return documents.select(doc_id(documents).alias("doc_id"), "text").mapInArrow(run, "doc_id long, quality double, good boolean, line_runs string")


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
