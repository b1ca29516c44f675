"""Retrieval quality and timing: truth by containment, generated queries, recall, order statistics, reports."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.config import IndexConfig, SearchOptions
from siltstone.operators.search import SearchEngine

STOP_WORDS = frozenset("a an and are as at be but by can could did do does for from had has have he i if in is it its not of on or our should so than that the their them then there these they this those to us was we were will with would you your".split())
#: Documents that a query mix is drawn from: the bound of that sample.
SAMPLED_ROWS = 10_000
SHARES = {"single": 0.45, "pair": 0.15, "typo": 0.10, "han": 0.10, "long": 0.05, "symbol": 0.05, "prefix": 0.05, "rare": 0.05}


def haystack(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))


#: Queries whose needles go into one automaton; more of them take further passes over the texts.
QUERIES_PER_PASS = 100_000
#: Texts that a worker holds, and whose hits it holds, at once.
TRUTH_ROWS = 500


def _truth_of(rows: list[tuple[int, list[str]]]):
    """(doc, text) batches -> (query_id, doc_id) for the texts that hold all needles of a query, each text read once whatever their number."""

    def run(batches):
        import pyarrow as pa

        needles = sorted({n for _, own in rows for n in own})
        wanted: dict[str, list[int]] = {}
        for i, (_, own) in enumerate(rows):
            for n in set(own):
                wanted.setdefault(n, []).append(i)
        sizes = [len(set(own)) for _, own in rows]
        free = [i for i, n in enumerate(sizes) if not n or "" in rows[i][1] and n == 1]
        try:
            import ahocorasick
        except ImportError:
            ahocorasick = None
        words = [n for n in needles if n]
        if ahocorasick and words:
            automaton = ahocorasick.Automaton()
            for n in words:
                automaton.add_word(n, n)
            automaton.make_automaton()
            found_in = lambda text: {n for _, n in automaton.iter(text)}
        else:
            found_in = lambda text: {n for n in words if n in text}
        for batch in (whole.slice(at, TRUTH_ROWS) for whole in batches for at in range(0, whole.num_rows, TRUTH_ROWS)):
            queries, docs = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen: dict[int, int] = {}
                for n in found_in(text or "") | ({""} & wanted.keys()):
                    for i in wanted[n]:
                        seen[i] = seen.get(i, 0) + 1
                hit = [i for i, k in seen.items() if k == sizes[i]] + [i for i in free if i not in seen]
                queries += [rows[i][0] for i in hit]
                docs += [doc] * len(hit)
            yield pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(docs, batch.column(0).type)], names=["query_id", "doc_id"])

    return run


def _held_of(rows: list[tuple[int, list[str]]]):
    """(doc, text) batches -> (query_id) of the queries all of whose needles some text holds, each once a task; those that were found aren't looked for again."""

    def run(batches):
        import pyarrow as pa

        left = {query: {n.lower() for n in own} for query, own in rows}
        for batch in batches:
            for text in (batch.column(1)[i].as_py() or "" for i in range(batch.num_rows)):
                for query in [q for q, own in left.items() if all(n in text for n in own)]:
                    del left[query]
                    yield pa.RecordBatch.from_arrays([pa.array([query], pa.int64())], names=["query_id"])

    return run


def substring_truth(documents: DataFrame, id_column: str, hay: Column, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id): the documents whose text holds all of a query's needles, letter case aside; queries(query_id, needles ARRAY<STRING>).

    A query without needles holds for every document. The needles are read by the driver, QUERIES_PER_PASS queries at a time, and each pass
    runs one automaton of all of them over the texts: there is no join of texts with queries.
    """
    texts = documents.select(F.col(id_column).alias("doc_id"), hay.alias("_hay"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    lowered = queries.where("needles is not null").select(F.col("query_id").cast("long"), F.transform("needles", F.lower))
    out, rows = None, []

    def passed(out: DataFrame | None, rows: list) -> DataFrame:
        more = texts.mapInArrow(_truth_of(rows), f"query_id long, doc_id {kind}")
        return more if out is None else out.union(more)

    for r in lowered.toLocalIterator():
        rows.append((r[0], list(r[1])))
        if len(rows) == QUERIES_PER_PASS:
            out, rows = passed(out, rows), []
    return passed(out, rows) if rows or out is None else out


def recall(hits: DataFrame, truth: DataFrame, limit: int) -> DataFrame:
    """(query_id, recall) of the queries with any truth: the share of true documents among the first min(limit, number of true ones) hits.

    hits(query_id, rank, doc_id).
    """
    wanted = truth.groupBy("query_id").agg(F.least(F.count("*"), F.lit(limit)).alias("m"))
    good = hits.join(truth, ["query_id", "doc_id"]).join(wanted, "query_id").where(F.col("rank") <= F.col("m")).groupBy("query_id").agg(F.count("*").alias("got"))
    return wanted.join(good, "query_id", "left").select("query_id", (F.coalesce("got", F.lit(0)) / F.col("m")).alias("recall"))


def summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mean, median, stddev, p50, p95, p99) with the sample deviation, 0 of a single value; null values are left out.

    A percentile is the value at place floor(p% of the count) in order, the last one at most. Places come from a window, which
    spills, so no group is ever held as one array.
    """
    v = df.where(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"))
    own = Window.partitionBy("_k")
    placed = v.withColumn("_at", F.row_number().over(own.orderBy("_v")) - 1).withColumn("_n", F.count("*").over(own))
    at = lambda p: F.least(F.col("_n") - 1, F.floor(F.lit(p / 100) * F.col("_n")))
    middle = (F.col("_at") == F.floor((F.col("_n") - 1) / 2)) | (F.col("_at") == F.floor(F.col("_n") / 2))
    chosen = [F.max(F.when(F.col("_at") == at(p), F.col("_v"))).alias(f"p{p}") for p in (50, 95, 99)]
    out = placed.groupBy("_k").agg(F.avg("_v").alias("mean"), F.avg(F.when(middle, F.col("_v"))).alias("median"), F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("stddev"), *chosen)
    return out.withColumnRenamed("_k", key)


def jaccard(left: Column, right: Column) -> Column:
    both = F.size(F.array_union(left, right))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / both)


def latency_ring(df: DataFrame, by: Sequence[str], at: str, value: str, p: float, size: int = 32) -> DataFrame:
    """df with the percentile of the last size values up to each row: the one at floor(p / 100 * (count - 1))."""
    window = Window.partitionBy(*by).orderBy(*([at] if isinstance(at, str) else at)).rowsBetween(-(size - 1), 0)
    kept = F.sort_array(F.collect_list(F.col(value)).over(window))
    return df.withColumn("_ring", kept).withColumn(f"p{p:g}", F.get("_ring", F.floor(F.lit(p / 100) * (F.size("_ring") - 1)).cast("int"))).drop("_ring")


class Mulberry32:
    """A 32-bit generator that gives the same queries for the same seed everywhere."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFF

    def __call__(self) -> float:
        word = 0xFFFFFFFF
        self.state = (self.state + 0x6D2B79F5) & word
        t = self.state
        t = ((t ^ (t >> 15)) * (t | 1)) & word
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & word)) & word
        return ((t ^ (t >> 14)) & word) / 4294967296

    def pick(self, items: Sequence):
        return items[int(self() * len(items))]


def fnv1a(text: str) -> int:
    h = 0x811C9DC5
    for unit in memoryview(text.encode("utf-16-le")).cast("H"):
        h = ((h ^ unit) * 0x01000193) & 0xFFFFFFFF
    return h


def ascii_words(text: str) -> list[str]:
    return [w for w in re.sub(r"[^a-z0-9\s]", " ", text.lower()).split() if len(w) >= 3 and w not in STOP_WORDS]


def han_chars(text: str) -> list[str]:
    return re.findall("[㐀-鿿]", text)


def code_symbols(text: str) -> list[str]:
    return [w for w in re.findall(r"[A-Za-z_][A-Za-z_0-9]{4,30}", text) if "_" in w or re.search("[A-Z]", w[1:])]


def inject_typo(word: str, rng: Mulberry32) -> str:
    """One character dropped or two neighbours swapped; words under four characters stay."""
    if len(word) < 4:
        return word
    at = int(rng() * len(word))
    if rng() < 0.5:
        return word[:at] + word[at + 1 :]
    return word if at == len(word) - 1 else word[:at] + word[at + 1] + word[at] + word[at + 2 :]


def query_mix(documents: DataFrame, count: int, seed: int = 0xDEADBEEF, rows: int = SAMPLED_ROWS, order_by: str | None = None, hay: Column | None = None) -> list[dict]:
    """generate_queries() on a sample of at most rows of documents(title, body), those of the least hash, with the title frequencies of all documents.

    Of what is generated only queries that some document of the whole table holds, by hay, are in the mix. order_by: the column that orders the sample, and that is hashed with the seed.
    """
    spark = documents.sparkSession
    key = F.col(order_by) if order_by else F.xxhash64("title", "body")
    sample = [r.asDict() for r in documents.select("title", "body", key.alias("_key")).orderBy(F.xxhash64(F.lit(seed), "_key"), "_key").limit(rows).collect()]
    wanted = sorted({w for d in sample for w in ascii_words(d["title"] or "")})
    words = F.filter(F.split(F.regexp_replace(F.lower("title"), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: F.length(w) >= 3)
    found = documents.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").count()
    side = spark.createDataFrame([(w,) for w in wanted], "word string")
    tried = generate_queries(sample, count, seed, {r["word"]: r["count"] for r in found.join(F.broadcast(side), "word").collect()}, spare=2)
    if not tried:
        return tried
    # Which queries some text holds, not which text: so a worker holds a text and what is still to be found.
    texts = documents.select(F.lit(1).alias("_one"), (hay if hay is not None else haystack("title", "body")).alias("_hay"))
    found = texts.mapInArrow(_held_of([(q["query_id"], q["needles"]) for q in tried]), "query_id long").distinct().collect()
    held = {r.query_id for r in found}
    out: list[dict] = []
    for kind, share in SHARES.items():
        out += [q for q in tried if q["kind"] == kind and q["query_id"] in held][: int(count * share)]
    return [q | {"query_id": i} for i, q in enumerate(out)]


def generate_queries(documents: list[dict], count: int, seed: int = 0xDEADBEEF, frequency: dict[str, int] | None = None, spare: int = 1) -> list[dict]:
    """A mix of queries from a sample of documents with title and body, each with the needles that its truth must hold.

    SHARES of count: single words, word pairs, typos (with the word they were made of as truth), Han pairs, longer runs, code symbols,
    prefixes and rare words. A kind that the documents can't give in four times its number of attempts comes out short. frequency: in
    how many titles a word is; without it, that of the given documents. spare: up to so many times the queries, for those that turn out to have no truth.
    """
    rng, out = Mulberry32(seed), []
    if not documents:
        return out

    def head(d: dict) -> str:
        return d.get("title") or d.get("body") or ""

    def run(words: list[str], n: int) -> str | None:
        if len(words) < n:
            return None
        at = int(rng() * (len(words) - n + 1))
        return " ".join(words[at : at + n])

    seen = dict(frequency or {})
    for d in documents if frequency is None else ():
        for w in set(ascii_words(head(d))):
            seen[w] = seen.get(w, 0) + 1

    def one(kind: str) -> tuple[str, list[str]] | None:
        d = rng.pick(documents)
        words = ascii_words(head(d))
        if kind == "single":
            q = rng.pick(words) if words else None
        elif kind == "pair":
            q = run(ascii_words(d.get("title") or ""), 2)
        elif kind == "typo":
            long = [w for w in words if len(w) >= 5]
            word = rng.pick(long) if long else None
            q = inject_typo(word, rng) if word else None
            return None if q is None or q == word else (q, [word])
        elif kind == "han":
            chars = han_chars(head(d))
            at = int(rng() * (len(chars) - 1)) if len(chars) > 1 else 0
            q = "".join(chars[at : at + 2]) if len(chars) > 1 else None
            return None if q is None else (q, [q])
        elif kind == "long":
            q = run(ascii_words(d.get("body") or d.get("title") or ""), 3 + int(rng() * 2))
        elif kind == "symbol":
            found = code_symbols(d.get("body") or d.get("title") or "")
            q = rng.pick(found) if found else None
        elif kind == "prefix":
            long = [w for w in words if len(w) >= 6]
            q = rng.pick(long)[: 3 + int(rng() * 3)] if long else None
        else:
            tries = [rng.pick(words) for _ in range(6)] if words else []
            tries = [w for w in tries if len(w) >= 5]
            q = min(tries, key=lambda w: seen.get(w, 0)) if tries else None
        return None if q is None else (q, q.lower().split(" "))

    for kind, share in SHARES.items():
        want, made = int(count * share), 0
        for _ in range(4 * want):
            if made == spare * want:
                break
            got = one(kind)
            if got:
                out.append({"query_id": len(out), "kind": kind, "text": got[0], "needles": got[1]})
                made += 1
    return out


def run_batch(engine: SearchEngine, queries: DataFrame, passes: int = 3, options: SearchOptions = SearchOptions(highlight=False)) -> dict:
    """Warm up once, then time whole batches: median seconds, their deviation, and queries a second."""
    import statistics

    n = queries.count()
    seconds = []
    for i in range(passes + 1):
        began = time.perf_counter()
        engine.search(queries, options).write.format("noop").mode("overwrite").save()
        if i:
            seconds.append(time.perf_counter() - began)
    middle = statistics.median(seconds)
    return {"queries": n, "seconds": middle, "stddev": statistics.stdev(seconds) if passes > 1 else 0.0, "queries_per_second": n / middle}


@dataclass(frozen=True)
class Budgets:
    """Seconds beyond which a build, the first pass of a batch, or a query of a pass count as too slow to report."""

    build: float = 120.0
    warm_up: float = 20.0
    query: float = 2.0


def run_dataset(name: str, documents: DataFrame, config: IndexConfig, mix: list[dict], hay: Column, path: str, passes: int = 7, options: SearchOptions = SearchOptions(highlight=False), budgets: Budgets = Budgets()) -> dict:
    """A row of the report: build, warm up, time whole passes of the mix, and its recall; None for what a budget left out.

    A build over its budget leaves out all that follows; a warm-up or a pass over it the times and the recall.
    """
    import statistics

    from siltstone.sources import store

    spark = documents.sparkSession
    row = dict.fromkeys(("build_s", "index_bytes", "seconds", "stddev", "queries_per_second", "recall"))
    began = time.perf_counter()
    store.save_documents_index(documents, config, path)
    row = {"dataset": name, "docs": documents.count(), "queries": len(mix)} | row | {"build_s": time.perf_counter() - began, "index_bytes": store.index_bytes(spark, path)}
    if row["build_s"] > budgets.build or not mix:
        return row
    engine = store.load_index(spark, path)
    queries = spark.createDataFrame([(q["query_id"], q["text"]) for q in mix], "query_id long, text string")
    seconds = []
    for i in range(passes + 1):
        began = time.perf_counter()
        engine.search(queries, options).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        if took > (budgets.query * len(mix) if i else budgets.warm_up):
            return row
        if i:
            seconds.append(took)
    middle = statistics.median(seconds)
    needles = spark.createDataFrame([(q["query_id"], q["needles"]) for q in mix], "query_id long, needles array<string>")
    truth = substring_truth(documents.select(F.col(config.id_column).cast("string").alias("id"), hay.alias("hay")), "id", F.col("hay"), needles)
    hits = engine.search(queries, options).select("query_id", "rank", F.col("id").alias("doc_id"))
    found = recall(hits, truth, options.limit).agg(F.avg("recall")).first()[0]
    return row | {"seconds": middle, "stddev": statistics.stdev(seconds) if len(seconds) > 1 else 0.0, "queries_per_second": len(mix) / middle, "recall": found}


def render_table(rows: list[dict], columns: Sequence[str], show: Callable[[object], str] = lambda v: "N/A" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)) -> str:
    """Markdown of rows; what a row lacks is N/A."""
    lines = [columns, ["---"] * len(columns), *([show(r.get(c)) for c in columns] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
