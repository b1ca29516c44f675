"""Language identification by interpolated Kneser-Ney character models.

For each language, an interpolated Kneser-Ney model of ORDER characters is fitted on a bounded sample of labelled
rows. The models' log probabilities are stored together, per order, as one sorted array of n-gram hashes with a
column for each language, and looked up by a directory on the leading bits and a short search. A text's cross-entropy is
the mean over all its characters; the language of the lowest one is chosen. It is rejected ("und") where it is above the
language's threshold, calibrated on held-out rows with room for texts of few characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm import _kernels as K
from siltstone.llm._scratch import doc_id

ORDER = 4
#: The bound of the fit: labelled rows for each language, those of the least hash of doc_id. A fourth of them is held out.
ROWS_PER_LANGUAGE = 400
#: Languages with fewer rows than this aren't modelled, nor any but these many of most rows: what is sampled and broadcast is bounded whatever lang holds.
LEAST_ROWS, MOST_LANGUAGES = 8, 250
REJECT, SLACK = 0.999, 0.35
OTHER, MARK = 1, 2  # symbols for what is no letter, and for the beginning of a text
ALPHABET = 1 << 16


def _symbols() -> np.ndarray:
    """Code point -> symbol: letters and marks as they are, all else as one."""
    import unicodedata

    table = np.full(ALPHABET, OTHER, np.uint16)
    for c in range(128, ALPHABET):
        if unicodedata.category(chr(c))[0] in "LM":
            table[c] = c
    for c in b"abcdefghijklmnopqrstuvwxyz'":
        table[c] = c
    return table


SYMBOLS = _symbols()


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, runs of OTHER folded to one and ORDER times MARK before each text; and where each text's marks begin.

    Han and kana keep their code points; characters beyond the basic plane are OTHER.
    """
    marks = "\x00" * ORDER
    codes = np.frombuffer((marks + marks.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + ORDER)])[: len(texts) + 1]
    out = SYMBOLS[np.where(codes < ALPHABET, codes, 0)].astype(np.uint64)
    for i in range(ORDER):
        out[begins[:-1] + i] = MARK
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != OTHER) | (out[:-1] != OTHER)
    place = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], place[begins]


def grams(s: np.ndarray, n: int, back: int = 0) -> np.ndarray:
    """A hash of the n symbols that end back places before each place; n + back is at most ORDER, the marks before each text."""
    out = np.full(len(s), n, np.uint64)
    for i in range(n - 1 + back, back - 1, -1):
        out *= np.uint64(ALPHABET)
        out[i:] += s[: len(s) - i]
    return K.mix(out)


def kneser_ney(s: np.ndarray, order: int) -> list[dict]:
    """For each n up to order: the seen n-grams' hashes, interpolated probabilities and contexts, and each context's backoff weight.

    Highest-order counts are those of the text, lower ones the number of distinct symbols seen before the n-gram.
    Discounts are n1 / (n1 + 2 n2) of the order. The unigrams are interpolated with the uniform distribution.
    """
    real = s != MARK
    levels: list[dict] = []
    for n in range(order, 0, -1):
        g, c = grams(s, n)[real], grams(s, n - 1, 1)[real]
        lower = grams(s, n - 1)[real]
        if n < order:
            # One occurrence for each distinct n + 1-gram.
            _, once = np.unique(grams(s, n + 1)[real], return_index=True)
            g, c, lower = g[once], c[once], lower[once]
        seen, first, count = np.unique(g, return_index=True, return_counts=True)
        contexts, inverse = np.unique(c[first], return_inverse=True)
        total = np.bincount(inverse, count, len(contexts))
        kinds = np.bincount(inverse, minlength=len(contexts))
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.95)
        levels.append({"gram": seen, "lower": lower[first], "own": np.maximum(count - d, 0) / total[inverse], "inverse": inverse, "contexts": contexts, "backoff": d * kinds / total})
    levels.reverse()
    size = len(levels[0]["gram"]) + 1
    below = None
    for level in levels:
        p = 1.0 / size if below is None else below["p"][np.searchsorted(below["gram"], level["lower"])]
        level["p"] = level["own"] + level["backoff"][level["inverse"]] * p
        below = level
    levels[0]["unseen"] = levels[0]["backoff"][0] / size
    return levels


class Models:
    """All languages' models in sorted hash arrays: per order, the union of their n-grams with each language's log probability."""

    def __init__(self, languages: list[str], fitted: list[list[dict]], order: int = ORDER):
        self.languages, self.order = languages, order
        self.unseen = np.log(np.array([m[0]["unseen"] for m in fitted]))
        self.backoffs, self.tables = [], []
        for n in range(order):
            contexts = np.unique(np.concatenate([m[n]["contexts"] for m in fitted]))
            weight = np.zeros((len(contexts), len(fitted)))
            for j, m in enumerate(fitted):
                weight[np.searchsorted(contexts, m[n]["contexts"]), j] = np.log(m[n]["backoff"])
            self.backoffs.append((contexts, weight))
        # An n-gram that one language has seen and another not is backed off for the latter here, once, not in each lookup.
        grams_of, lower_of, context_of = [], [], []
        for n in range(order):
            every = np.concatenate([m[n]["gram"] for m in fitted])
            keys, first = np.unique(every, return_index=True)
            grams_of.append(keys)
            lower_of.append(np.concatenate([m[n]["lower"] for m in fitted])[first])
            context_of.append(np.concatenate([m[n]["contexts"][m[n]["inverse"]] for m in fitted])[first])
        for n in range(order):
            keys = grams_of[n]
            values = np.empty((len(keys), len(fitted)))
            for j, m in enumerate(fitted):
                if n == 0:
                    values[:, j] = self.unseen[j]
                else:
                    contexts, weight = self.backoffs[n]
                    values[:, j] = weight[np.searchsorted(contexts, context_of[n]), j] + self.tables[n - 1][1][np.searchsorted(self.tables[n - 1][0], lower_of[n]), j]
                values[np.searchsorted(keys, m[n]["gram"]), j] = np.log(m[n]["p"])
            self.tables.append((keys, values))
        self.tables = [(k, v.astype(np.float32)) for k, v in self.tables]
        self.backoffs = [(k, v.astype(np.float32)) for k, v in self.backoffs]
        self.directories = [_directory(k) for k, _ in self.tables], [_directory(k) for k, _ in self.backoffs]

    def log_probabilities(self, s: np.ndarray) -> np.ndarray:
        """Natural log probability of each symbol under each language."""
        out = np.zeros((len(s), len(self.languages)), np.float32)
        left = np.flatnonzero(s != MARK)
        for n in range(self.order, 0, -1):
            keys, values = self.tables[n - 1]
            at, found = _lookup(keys, self.directories[0][n - 1], grams(s, n)[left])
            hit = left[found]
            out[hit] += values[at[found]]
            left = left[~found]
            if not len(left):
                return out
            contexts, weight = self.backoffs[n - 1]
            at, found = _lookup(contexts, self.directories[1][n - 1], grams(s, n - 1, 1)[left])
            if n > 1:
                out[left[found]] += weight[at[found]]
        out[left] += self.unseen.astype(np.float32)
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(nats per symbol for each text and language, symbols); a text without letters has infinite ones."""
        s, begins = symbols(texts)
        log_p = self.log_probabilities(s)
        total = np.add.reduceat(log_p, begins[:-1], axis=0) if len(texts) else np.zeros((0, len(self.languages)))
        letters = np.add.reduceat((s > MARK).astype(np.int64), begins[:-1]) if len(texts) else np.zeros(0, np.int64)
        n = np.diff(begins) - ORDER
        return np.where(letters[:, None] > 0, -total / np.maximum(n, 1)[:, None], np.inf), letters


def _directory(keys: np.ndarray) -> tuple[int, np.ndarray, int]:
    """Shift to the leading bits, where each value of them begins among the sorted keys, and the most keys of one value."""
    bits = max(1, int(np.ceil(np.log2(len(keys) + 1))))
    begins = np.concatenate([[0], np.cumsum(np.bincount((keys >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits))])
    return 64 - bits, begins.astype(np.int32), int(np.diff(begins).max(initial=0))


def _lookup(keys: np.ndarray, directory: tuple[int, np.ndarray, int], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each wanted hash in the sorted keys, and whether it is there."""
    shift, begins, most = directory
    lead = (wanted >> np.uint64(shift)).astype(np.int64)
    at, past = begins[lead], begins[lead + 1]
    found = np.zeros(len(wanted), bool)
    open_ = np.flatnonzero(at < past)
    for _ in range(most):
        if not len(open_):
            break
        same = keys[at[open_]] == wanted[open_]
        found[open_[same]] = True
        open_ = open_[~same]
        at[open_] += 1
        open_ = open_[at[open_] < past[open_]]
    return np.minimum(at, max(len(keys) - 1, 0)), found


def labelled_sample(documents: DataFrame, rows: int = ROWS_PER_LANGUAGE, languages: int = MOST_LANGUAGES) -> list:
    """(lang, hash, text) of at most rows documents of each of the languages of most rows, of the least hash of doc_id; null or blank texts and languages are left out.

    At most rows * languages of them: both bound the fit. Rows are ranked before they are told apart, so rows of one doc_id and language take a place each, and the least of their texts counts.
    """
    named = documents.where("doc_id is not null and trim(lang) <> '' and lang <> 'und' and text is not null").select(doc_id(documents).alias("_id"), "lang")
    common = named.groupBy("lang").count().where(F.col("count") >= LEAST_ROWS).orderBy(F.desc("count"), "lang").limit(languages).select("lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("_id"), "_id")
    ids = named.join(F.broadcast(common), "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows).select("_id", "lang").distinct()
    texts = documents.where("text is not null").select(doc_id(documents).alias("_id"), "lang", F.lower("text").alias("text"))
    found = texts.join(F.broadcast(ids), ["_id", "lang"]).groupBy("_id", "lang").agg(F.min("text").alias("text"))
    return sorted((r.lang, r.n, r.text) for r in found.select("lang", F.xxhash64("_id").alias("n"), "text").collect())


def fit(sample: list, order: int = ORDER) -> tuple[Models, np.ndarray] | None:
    """Models and each language's threshold, from (lang, any order, text) rows; None if no language has enough of them."""
    by: dict[str, list[str]] = {}
    for lang, _, text in sample:
        by.setdefault(lang, []).append(text)
    languages = sorted(k for k, v in by.items() if len(v) >= LEAST_ROWS)
    if not languages:
        return None
    models = Models(languages, [kneser_ney(symbols([t for i, t in enumerate(by[k]) if i % 4])[0], order) for k in languages], order)
    thresholds = []
    for j, k in enumerate(languages):
        xent, letters = models.cross_entropies(by[k][::4])
        own = xent[np.isfinite(xent[:, j]), j]
        thresholds.append(np.quantile(own, REJECT) + SLACK if len(own) else np.inf)
    return models, np.array(thresholds)


def identify(documents: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """(doc_id, language, cross_entropy, margin) for each row of documents.

    language is "und" where the text is rejected, is null, or has no letter (cross_entropy and margin are then
    null), and everywhere if no language has enough labelled rows. A document of a language of fewer than LEAST_ROWS rows can only be "und" or of another language. margin is the distance to the second language, null if there is none.
    Ties go to the language that is first by name. Texts of up to a few words get more room, SLACK * 8 / symbols; very long ones are scored whole. Repeated rows and null doc_ids
    each have a row; an empty table gives no rows. Only doc_id (of a whole-number type, else a TypeError), text and lang are read, so other columns may have any name.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fit(labelled_sample(documents, rows)))
    schema = pa.schema([("doc_id", pa.int64()), ("language", pa.string()), ("cross_entropy", pa.float64()), ("margin", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            _, offsets = K.utf8(column)
            for a, b in K.passes(offsets):
                language, best, margin = ["und"] * (b - a), np.full(b - a, np.nan), np.full(b - a, np.nan)
                if shared.value is not None:
                    models, thresholds = shared.value
                    xent, letters = models.cross_entropies([x or "" for x in column.slice(a, b - a).to_pylist()])
                    j = xent.argmin(axis=1)
                    some = letters > 0
                    best[some] = xent[some, j[some]]
                    if xent.shape[1] > 1:
                        two = np.partition(xent[some], 1, axis=1)
                        margin[some] = two[:, 1] - two[:, 0]
                    taken = some & (np.where(some, best, np.inf) <= thresholds[j] + SLACK * 8 / np.maximum(letters, 1))
                    language = [models.languages[k] if t else "und" for k, t in zip(j, taken)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(language, pa.string()), pa.array(best, from_pandas=True), pa.array(margin, from_pandas=True)], schema=schema)

    return documents.select(doc_id(documents).alias("doc_id"), F.lower("text").alias("text")).mapInArrow(run, "doc_id long, language string, cross_entropy double, margin double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
