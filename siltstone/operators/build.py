"""Building an index: documents -> weighted features -> postings, pruned by document frequency, and typo deletions.

The documents are range-sorted by their ordinal once; features, first-occurrence rules and score sums are all local
to a document, so texts aren't shuffled again, nor any exploded row. Only document-frequency counts, combined before the shuffle, and the
final sort of the postings are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.config import ASCII_GRAM, EXACT, HAN, JOIN, JOIN_DF_FLOOR, JOIN_DF_SHARE, PREFIX, SCORE_CAP, SIGNAL, TAG_WEIGHT, URL, IndexConfig
from siltstone.functions import text as X
from siltstone.sources.scratch import Scratch


#: Pruned features up to this many are broadcast, else joined by shuffle.
BROADCAST_FEATURES = 500_000
#: Features after which a batch of them is handed over.
EMITTED_ROWS = 100_000
#: Documents whose features are handed over together, and tokens that a worker remembers what they are wanted for, where only some features are.
LOOKED_UP_ROWS, KNOWN_TOKENS = 1_000, 500_000
TOKENS = re.compile(X.TOKEN)
#: Terms that have deletions.
CORRECTED = re.compile("[a-z0-9]{3,14}")
ALL_TYPES = frozenset({EXACT, PREFIX, SIGNAL, JOIN, HAN, ASCII_GRAM})


def lookup_options(column: str) -> dict[str, str]:
    """Writer options: a bloom filter on the column that lookups test, and row groups small enough for a lookup to skip most of a file."""
    return {f"parquet.bloom.filter.enabled#{column}": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.block.size": str(16 << 20)}


@dataclass
class Index:
    """docs(doc_ord, id, fields, tags, signal_compact, signal_ascii, gate_compact, gate_ascii), postings(ftype, term, doc_ord, score),
    features(ftype, term, df), deletes(deletion, ftype, term, df), and the number of documents."""

    config: IndexConfig
    docs: DataFrame
    postings: DataFrame
    features: DataFrame
    deletes: DataFrame
    n_docs: int

    def stats(self) -> DataFrame:
        """One row: docs, features, postings (after pruning) and distinct deletions."""
        f = self.features.agg(F.count("*").alias("features"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
        d = self.deletes.agg(F.countDistinct("deletion").alias("correction_deletes"))
        return f.crossJoin(d).select(F.lit(self.n_docs).cast("long").alias("docs"), "features", "postings", "correction_deletes")


def content_hash(documents: DataFrame) -> Column:
    return F.xxhash64(*(c for c, k in documents.dtypes if not k.startswith("map")))


def with_ordinals(documents: DataFrame, order_by: Sequence[str], scratch: Scratch, ties: Column | None = None) -> tuple[DataFrame, int]:
    """documents with a dense doc_ord in the given order, and their number; the order may tie, ties go by row content hash (or the one given).

    A range sort, then offsets from each partition's count: no task sees all rows.
    """
    n = scratch.partitions
    ties = content_hash(documents) if ties is None else ties
    sorted_ = documents.repartitionByRange(n, *order_by, ties).sortWithinPartitions(*order_by, ties)
    placed = scratch.write(sorted_.withColumn("_mid", F.monotonically_increasing_id()), "ordered")
    pid, offsets, total = F.shiftright("_mid", 33), [], 0
    for r in placed.groupBy(pid.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        offsets.append((r.p, total))
        total += r.n
    table = F.broadcast(documents.sparkSession.createDataFrame(offsets, "_p long, _o long"))
    ord_ = (F.col("_o") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).alias("doc_ord")
    return placed.join(table, pid == F.col("_p")).select(ord_, *(F.col(f"`{c}`") for c in documents.columns)), total


def tags_of(documents: DataFrame, config: IndexConfig) -> Column:
    """ARRAY<STRING>: an array as it is, a scalar as one tag unless it is empty, zero or false."""
    empty = F.lit([]).cast("array<string>")
    if not config.tags_field:
        return empty
    kind, tag = documents.schema[config.tags_field].dataType, F.col(f"`{config.tags_field}`")
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.transform(tag, lambda x: X.value_text(x, kind.elementType)), empty)
    text = X.value_text(tag, kind)
    falsy = ["", "0", "false"] if not isinstance(kind, T.StringType) else [""]
    return F.when(text.isin(falsy), empty).otherwise(F.array(text))


def _parts(documents: DataFrame, config: IndexConfig) -> DataFrame:
    """(doc_ord, parts): the normalised texts of each document's fields and tags, with weight, window and whether it is a URL."""
    return documents.select("doc_ord", parts_of(documents, config, [X.normalize_text(X.value_text(f"`{s.name}`", documents.schema[s.name].dataType)) for s in config.fields]).alias("parts"))


def parts_of(documents: DataFrame, config: IndexConfig, norms: list[Column], tags: Column | None = None) -> Column:
    """norms: the normalised texts of config.fields. tags: the documents' tags, where they are a column already."""
    part = lambda text, weight, window, url: F.struct(F.lit(float(weight)).alias("weight"), F.lit(window).alias("window"), F.lit(url).alias("url"), text.alias("text"))
    fields = [part(n, s.weight, s.join_window, s.kind == URL) for s, n in zip(config.fields, norms)]
    return F.concat(F.array(*fields), F.transform(tags_of(documents, config) if tags is None else tags, lambda t: part(X.normalize_text(t), TAG_WEIGHT, 3, False)))


def rounded(weight: float, factor: float, least: float = 0.0) -> float:
    """weight * factor, rounded half up, at least so much."""
    return max(least, float(math.floor(weight * factor + 0.5)))


def _several(text: str) -> bool:
    """Two UTF-16 units at least."""
    return len(text) > 1 or text > "\uffff"


def tokens_of(normalized: str) -> list[str]:
    return normalized.split() if normalized.isascii() else TOKENS.findall(normalized)


def features_of(parts: list[dict], types: frozenset[int] = ALL_TYPES) -> dict[int, dict[str, float]]:
    """Feature type -> term -> score of one document, of parts (weight, window, url, text) in order; of the given types only.

    Scores are sums over a document's tokens, capped. A join of a window counts once in its part, where it occurs first and only if it
    is of several tokens there, all but the first of two units, and five characters long; a Han bigram counts once in its part.
    """
    out: dict[int, dict[str, float]] = {t: {} for t in (EXACT, PREFIX, SIGNAL, JOIN, HAN, ASCII_GRAM)}
    exact, prefix, signal, join, han, gram = (out[t] for t in (EXACT, PREFIX, SIGNAL, JOIN, HAN, ASCII_GRAM))
    counted, windows, pairs = bool({EXACT, PREFIX} & types), JOIN in types, HAN in types
    # Whole fields need the first tokens only.
    heads_only = not (counted or windows or pairs)

    def add(scores: dict[str, float], term: str, score: float) -> None:
        scores[term] = scores.get(term, 0.0) + score

    for part in parts:
        w, url = part["weight"], part["url"]
        tokens = (m.group() for m in TOKENS.finditer(part["text"])) if heads_only else tokens_of(part["text"])
        begin = rounded(w, 0.4, 6)
        for t, n in Counter(tokens).items() if counted else ():
            if not _several(t):
                continue
            if w == int(w):
                add(exact, t, w * n)
            else:  # added as often as it occurs, for the sum is rounded at each step
                for _ in range(n):
                    add(exact, t, w)
            if t.isascii():
                for k in range(2, min(4, len(t)) + 1):
                    add(prefix, t[:k], begin * n)
        seen, last = set(), 0 if heads_only else len(tokens)
        by_width = _by_width(w, part["window"])
        for i in range(last if windows else 0):
            text, valid = "", True
            for width in range(1, min(part["window"], last - i) + 1):
                t = tokens[i + width - 1]
                text += t
                if width > 1 and not _several(t):
                    valid = False
                size = len(text)
                if size > 12:
                    break
                if size < 3 or text in seen:
                    continue
                seen.add(text)
                if width > 1 and valid and size >= 5:
                    add(join, text, by_width[width])
        if url:
            continue
        compact = part["text"].replace(" ", "")
        if 3 <= len(compact) <= 32:
            add(join, compact, rounded(w, 1.08))
        joined = _joined(tokens)
        if 3 <= len(joined) <= 32:
            add(signal, joined, rounded(w, 1.28))
            for k in range(2, min(4, len(joined)) + 1):
                add(prefix, joined[:k], rounded(w, 0.56, 6))
            if len(joined) <= 12:
                for i in range(len(joined) - 1):
                    add(gram, joined[i : i + 2], rounded(w, 0.16, 4))
        if pairs and not part["text"].isascii():
            for pair in _han_pairs(tokens):
                add(han, pair, rounded(w, 0.22, 4))
    return {t: own if t in types else {} for t, own in out.items()}


def _by_width(weight: float, window: int) -> list[float]:
    """Scores of joins by their number of tokens."""
    return [0.0, *(rounded(weight, 1.02 - k * 0.16, 8) for k in range(window))]


def _joined(tokens: Iterable[str]) -> str:
    """The ASCII tokens joined, up to the one that makes them longer than 32 characters."""
    joined = ""
    for t in tokens:
        if t.isascii():
            joined += t
            if len(joined) > 32:
                break
    return joined


def _han_pairs(tokens: list[str]) -> set[str]:
    single = [len(t) == 1 and "\u3400" <= t <= "\u9fff" for t in tokens]
    return {tokens[i] + tokens[i + 1] for i in range(len(tokens) - 1) if single[i] and single[i + 1]}


@dataclass(frozen=True)
class Wanted:
    """The features that a batch looks up.

    terms: by type. deletions: of misspelt words; exact and signal terms that have one of them are wanted too, if they begin as one of the
    words (begins: first letter -> their lengths) and are within two of its length. starts: exact terms that begin so. types: those of which every feature is.
    """

    terms: Mapping[int, frozenset[str]] = field(default_factory=dict)
    deletions: frozenset[str] = frozenset()
    begins: Mapping[str, frozenset[int]] = field(default_factory=dict)
    starts: tuple[str, ...] = ()
    types: frozenset[int] = frozenset()


def _cuts(term: str) -> set[str]:
    """deletions() of functions.text of a term as the index has them."""
    one = {term[:i] + term[i + 1 :] for i in range(len(term))}
    return one | {t[:i] + t[i + 1 :] for t in one for i in range(len(t))} if len(term) >= 6 else one


class Lookup:
    """features_of() of documents, of wanted features only: the same terms have the same scores."""

    def __init__(self, wanted: Wanted):
        self.wanted = wanted
        self.exact, self.prefix, self.signal, self.join, self.han, self.gram = (wanted.terms.get(t, frozenset()) for t in (EXACT, PREFIX, SIGNAL, JOIN, HAN, ASCII_GRAM))
        self.heads = {j[:k] for j in self.join if len(j) <= 12 for k in range(1, len(j) + 1)}
        # What was found of tokens before: most are wanted for nothing.
        self.dull: set[str] = set()
        self.known: dict[str, tuple[bool, tuple[str, ...]]] = {}

    def near(self, term: str) -> bool:
        """Whether the typo channel may find it."""
        lengths = self.wanted.begins.get(term[:1])
        if not lengths or not CORRECTED.fullmatch(term) or not any(abs(n - len(term)) <= 2 for n in lengths):
            return False
        return not _cuts(term).isdisjoint(self.wanted.deletions)

    def told(self, token: str) -> tuple[bool, tuple[str, ...]] | None:
        """(whether the token itself is wanted, its wanted prefixes)."""
        if not _several(token):
            return None
        prefixes = tuple(p for k in range(2, min(4, len(token)) + 1) if (p := token[:k]) in self.prefix) if token.isascii() else ()
        own = token in self.exact or token.startswith(self.wanted.starts) or self.near(token)
        return (own, prefixes) if own or prefixes else None

    def features(self, parts: list[dict]) -> dict[int, dict[str, float]]:
        if self.wanted.types:
            return features_of(parts, self.wanted.types)
        out: dict[int, dict[str, float]] = {t: {} for t in (EXACT, PREFIX, SIGNAL, JOIN, HAN, ASCII_GRAM)}

        def add(ftype: int, term: str, score: float) -> None:
            out[ftype][term] = out[ftype].get(term, 0.0) + score

        for part in parts:
            w, tokens = part["weight"], tokens_of(part["text"])
            counts = Counter(tokens)
            for t in counts.keys() - self.dull:
                told = self.known.get(t) or self.told(t)
                if not told:
                    self._keep(self.dull, t)
                    continue
                if t not in self.known:
                    self._keep(self.known, t, told)
                n = counts[t]
                for _ in range((1 if w == int(w) else n) if told[0] else 0):
                    add(EXACT, t, w * n if w == int(w) else w)
                for p in told[1]:
                    add(PREFIX, p, rounded(w, 0.4, 6) * n)
            if not self.heads.isdisjoint(counts):
                self._joins(tokens, part, add)
            if part["url"]:
                continue
            compact = part["text"].replace(" ", "")
            if 3 <= len(compact) <= 32 and compact in self.join:
                add(JOIN, compact, rounded(w, 1.08))
            joined = _joined(tokens)
            if 3 <= len(joined) <= 32:
                if joined in self.signal or self.near(joined):
                    add(SIGNAL, joined, rounded(w, 1.28))
                for k in range(2, min(4, len(joined)) + 1):
                    if joined[:k] in self.prefix:
                        add(PREFIX, joined[:k], rounded(w, 0.56, 6))
                for i in range(len(joined) - 1 if len(joined) <= 12 else 0):
                    if joined[i : i + 2] in self.gram:
                        add(ASCII_GRAM, joined[i : i + 2], rounded(w, 0.16, 4))
            if self.han and not part["text"].isascii():
                for pair in _han_pairs(tokens) & self.han:
                    add(HAN, pair, rounded(w, 0.22, 4))
        return out

    def _joins(self, tokens: list[str], part: dict, add: Callable[[int, str, float], None]) -> None:
        """Where wanted joins occur first; a text that begins none of them is left at once."""
        seen, by_width = set(), _by_width(part["weight"], part["window"])
        for i in [i for i, t in enumerate(tokens) if t in self.heads]:
            text, valid = "", True
            for width, t in enumerate(tokens[i : i + part["window"]], 1):
                text += t
                if width > 1 and not _several(t):
                    valid = False
                if text not in self.heads:
                    break
                if len(text) < 3 or text not in self.join or text in seen:
                    continue
                seen.add(text)
                if width > 1 and valid and len(text) >= 5:
                    add(JOIN, text, by_width[width])

    @staticmethod
    def _keep(kept: set | dict, token: str, *told) -> None:
        if len(kept) >= KNOWN_TOKENS:
            kept.clear()
        if told:
            kept[token] = told[0]
        else:
            kept.add(token)


def _looked_up(wanted: Wanted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with parts as their last column -> the same with the parts' wanted features in its place."""
    kind = pa.struct([("ftype", pa.int8()), ("term", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(wanted)
        for whole in batches:
            for at in range(0, whole.num_rows, LOOKED_UP_ROWS):
                batch = whole.slice(at, LOOKED_UP_ROWS)
                kinds, terms, scores, offsets = [], [], [], [0]
                for parts in batch.column(batch.num_columns - 1).to_pylist():
                    for ftype, own in lookup.features(parts).items():
                        terms += own
                        scores += own.values()
                        kinds += [ftype] * len(own)
                    offsets.append(len(terms))
                capped = np.minimum(np.array(scores, float), float(SCORE_CAP))
                rows = pa.StructArray.from_arrays([pa.array(kinds, pa.int8()), pa.array(terms, pa.string()), pa.array(capped)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)], names=[*batch.schema.names[:-1], "features"])

    return run


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ords, kinds, terms, scores = [], [], [], []
        for doc, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for ftype, own in features_of(parts).items():
                terms += own
                scores += own.values()
                kinds += [ftype] * len(own)
                ords += [doc] * len(own)
            if len(terms) > EMITTED_ROWS:
                yield _features(ords, kinds, terms, scores)
                ords, kinds, terms, scores = [], [], [], []
        yield _features(ords, kinds, terms, scores)


def _features(ords: list, kinds: list, terms: list, scores: list) -> pa.RecordBatch:
    capped = np.minimum(np.array(scores, float), float(SCORE_CAP))
    return pa.RecordBatch.from_arrays([pa.array(ords, pa.int64()), pa.array(kinds, pa.int8()), pa.array(terms, pa.string()), pa.array(capped)], names=["doc_ord", "ftype", "term", "score"])


def document_features(documents: DataFrame, config: IndexConfig) -> DataFrame:
    """(doc_ord, ftype, term, score): each document's features with their summed, capped scores as DOUBLE.

    The texts are normalised by built-in expressions; their features are summed in one Arrow pass, document by document. As expressions, the
    exploded emissions and their two aggregations took some twenty times the CPU, and a shuffle.
    """
    return _parts(documents, config).mapInArrow(_emit, "doc_ord long, ftype tinyint, term string, score double")


def with_signals(documents: DataFrame, config: IndexConfig) -> DataFrame:
    """The docs table: stored fields, tags, and the signal and gate texts in compact and ASCII form.

    A signal's ASCII form that is empty reads as its compact form.
    """
    text = [X.value_text(f"`{n}`", documents.schema[n].dataType) for n in config.signal_fields]
    out = documents.select("doc_ord", *stored_of(documents, config), X.normalize_text(F.concat_ws(" ", *text)).alias("_norm"))
    return gated(out.select("doc_ord", "id", "fields", "tags", *signals_of("_norm", config)), config)


def stored_of(documents: DataFrame, config: IndexConfig) -> list[Column]:
    """id, fields and tags of the docs table."""
    text = lambda name: X.value_text(f"`{name}`", documents.schema[name].dataType)
    stored = {n: text(n) if n in documents.columns else F.lit("") for n in config.store_fields}
    fields = F.create_map(*[x for n, c in stored.items() for x in (F.lit(n), c)]) if stored else F.expr("map()").cast("map<string,string>")
    return [F.col(f"`{config.id_column}`").cast("string").alias("id"), fields.alias("fields"), tags_of(documents, config).alias("tags")]


def signals_of(norm: str, config: IndexConfig) -> list[Column]:
    """The signals of the normalised text of the signal fields."""
    most = config.signal_max_length
    cut = lambda text, n: F.substring(text, F.lit(1), F.lit(n))
    # Spaces are single ones, so every second character of a normal form at least is none. Of a long text its head mostly has enough ASCII characters.
    head = X.ascii_of(cut(norm, 4 * most))
    enough = (F.length(norm) <= 4 * most) | (F.length(head) >= most)
    return [cut(X.compact_of(cut(norm, 2 * most)), most).alias("signal_compact"), cut(F.when(enough, head).otherwise(X.ascii_of(norm)), most).alias("signal_ascii")]


def gated(docs: DataFrame, config: IndexConfig) -> DataFrame:
    """The docs table of one without the gates."""
    out = docs.withColumn("signal_ascii", F.when(F.col("signal_ascii") == "", F.col("signal_compact")).otherwise(F.col("signal_ascii")))
    rest = [F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit("")) for n in config.store_fields] + [F.array_join("tags", " ")]
    gate = lambda own: X.normalize_text(F.concat_ws(" ", F.col(own), *rest))
    return out.select("doc_ord", "id", "fields", "tags", "signal_compact", "signal_ascii", X.compact_of(gate("signal_compact")).alias("gate_compact"), X.ascii_of(gate("signal_ascii")).alias("gate_ascii"))


def frequency_cap(n_docs: int, cutoff: float) -> tuple[int, int]:
    """(for prefixes and bigrams, for joins): documents that a feature may be in."""
    return int(n_docs * cutoff // 1), max(JOIN_DF_FLOOR, int(n_docs * min(cutoff, JOIN_DF_SHARE) // 1))


def is_noise(n_docs: int, cutoff: float) -> Column:
    cap, join_cap = frequency_cap(n_docs, cutoff)
    pruned = F.col("ftype").isin(PREFIX, HAN, ASCII_GRAM) & (F.col("df") > cap)
    return (pruned | ((F.col("ftype") == JOIN) & (F.col("df") > join_cap))) if cap > 0 or join_cap > 0 else F.lit(False)


def correction_deletes(features: DataFrame, top_weight: float) -> DataFrame:
    """(deletion, ftype, term, df) of the ASCII tokens and signals of 3 to 14 characters that weigh as much as a title in some document."""
    able = features.where(F.col("ftype").isin(EXACT, SIGNAL) & F.col("term").rlike("^[a-z0-9]{3,14}$") & (F.col("top_score") >= top_weight))
    return able.select(F.explode(X.deletions("term", F.length("term") >= 6)).alias("deletion"), "ftype", "term", "df")


def indexed_columns(documents: DataFrame, config: IndexConfig) -> DataFrame:
    """The columns that the index is made of."""
    wanted = dict.fromkeys([config.id_column, *config.order_by, *(s.name for s in config.fields), *config.store_fields, *([config.tags_field] if config.tags_field else [])])
    for name in [config.id_column, *(s.name for s in config.fields)]:
        if name not in documents.columns:
            raise ValueError(f"no column {name!r} to index")
    return documents.select(*(F.col(f"`{c}`") for c in wanted if c in documents.columns))


def pruned(raw: DataFrame, counted: DataFrame, n_docs: int, config: IndexConfig) -> tuple[DataFrame, DataFrame]:
    """(features that are kept, of counted; their postings, of raw)."""
    noise = is_noise(n_docs, config.noise_df_cutoff)
    # Features of more than a fixed share of all documents are few, however many documents there are; their number is checked all the same.
    gone = counted.where(noise).select("ftype", "term")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_FEATURES else gone
    return counted.where(~noise), raw.join(gone, ["ftype", "term"], "left_anti").select("ftype", "term", "doc_ord", F.floor("score").cast("int").alias("score"))


def partial_index(documents: DataFrame, config: IndexConfig, wanted: Wanted, listed: bool = True) -> Index:
    """The rows of build_index() that lookups of the wanted features meet; its docs are the documents that have any of these, none if not listed.

    Every document is read and each wanted feature is counted over all of them, so rows are those of the whole index. Texts are not
    shuffled: what is left of a document is, for its ordinal.
    """
    config = config.resolved()
    scratch = Scratch(documents.sparkSession, "partial")
    documents = indexed_columns(documents, config)
    cores = documents.sparkSession.sparkContext.defaultParallelism
    if documents.rdd.getNumPartitions() < cores:
        documents = documents.repartition(max(cores, scratch.partitions))
    by = [f"_by{i}" for i in range(len(config.order_by))]
    norm = [f"_norm{i}" for i in range(len(config.fields))]
    keys = [*(F.col(f"`{c}`").alias(n) for c, n in zip(config.order_by, by)), content_hash(documents).alias("_ties")]
    texts = [X.normalize_text(X.value_text(f"`{s.name}`", documents.schema[s.name].dataType)).alias(n) for s, n in zip(config.fields, norm)]
    tags = F.col("tags")
    found = documents.select(*keys, *(stored_of(documents, config) if listed else [tags_of(documents, config).alias("tags")]), *texts)
    # Words end at the spaces between fields, so the normal form of joined fields is that of each, joined.
    signal = F.array_join(F.filter(F.array(*(n for s, n in zip(config.fields, norm) if s.name in config.signal_fields)), lambda t: t != ""), " ")
    found = found.withColumn("_signal", signal) if listed else found
    parts = parts_of(documents, config, [F.col(n) for n in norm], tags).alias("parts")
    own = ["id", "fields", "tags", *signals_of("_signal", config)] if listed else []
    given = found.select(*by, "_ties", *own, parts)
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("features", T.ArrayType(T.StructType.fromDDL("ftype tinyint, term string, score double")))])
    emitted = given.mapInArrow(_looked_up(wanted), schema)
    if listed:
        some = F.size("features") > 0
        emitted = emitted.select(*by, "_ties", *(F.when(some, F.col(c)).alias(c) for c in ("id", "fields", "tags", "signal_compact", "signal_ascii")), "features")
    # Written first, for a range sort reads what it sorts twice.
    placed, n_docs = with_ordinals(scratch.write(emitted, "emitted"), by, scratch, F.col("_ties"))
    raw = placed.select("doc_ord", F.inline("features"))
    counted = scratch.write(raw.groupBy("ftype", "term").agg(F.count("*").cast("int").alias("df"), F.max("score").alias("top_score")), "counted")
    kept, postings = pruned(raw, counted, n_docs, config)
    docs = gated(placed.where(F.size("features") > 0).drop("features", "_ties", *by), config) if listed else placed.select("doc_ord").where("false")
    return Index(config, docs, postings, kept.select("ftype", "term", "df"), correction_deletes(kept, config.top_weight) if config.fuzzy else correction_deletes(kept.where("false"), 0.0), n_docs)


def build_index(documents: DataFrame, config: IndexConfig, scratch: Scratch | None = None) -> Index:
    """Index any DataFrame. Rows repeat, and ids may, without being merged; null fields are empty. No rows make an empty index.

    The tables are written to the scratch folder (by default one under the shared folder); save() of sources.store keeps them.
    """
    config = config.resolved()
    spark: SparkSession = documents.sparkSession
    scratch = scratch or Scratch(spark, "index")
    documents = indexed_columns(documents, config)
    placed, n_docs = with_ordinals(documents, config.order_by, scratch)
    docs = scratch.write(with_signals(placed, config), "docs")

    raw = scratch.write(document_features(placed, config), "raw", partition_by=["ftype"])
    raw = raw.select("doc_ord", F.col("ftype").cast("tinyint").alias("ftype"), "term", "score")
    counted = scratch.write(raw.groupBy("ftype", "term").agg(F.count("*").cast("int").alias("df"), F.max("score").alias("top_score")), "counted")
    kept, scores = pruned(raw, counted, n_docs, config)
    # Ranges over all three columns: a term of very many documents is split over several files, each sorted by term.
    order = ["ftype", "term", "doc_ord"]
    postings = scratch.write(scores.repartitionByRange(scratch.partitions, *order).sortWithinPartitions(*order), "postings", partition_by=["ftype"], **lookup_options("term"))
    # Sorted by what they are looked up by, so that a filter on a few terms reads a few row groups.
    wrong = correction_deletes(kept, config.top_weight) if config.fuzzy else spark.createDataFrame([], "deletion string, ftype tinyint, term string, df int")
    deletes = scratch.write(wrong.repartitionByRange(scratch.partitions, "deletion", "ftype", "term").sortWithinPartitions("deletion"), "deletes", **lookup_options("deletion"))
    features = scratch.write(kept.select("ftype", "term", "df").repartitionByRange(scratch.partitions, "ftype", "term").sortWithinPartitions("ftype", "term"), "features", **lookup_options("term"))
    scratch.release("raw", "ordered", "counted")
    return Index(config, docs, postings.select(F.col("ftype").cast("tinyint").alias("ftype"), "term", "doc_ord", "score"), features, deletes, n_docs)
