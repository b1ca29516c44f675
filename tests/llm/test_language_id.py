import math
import random
from collections import Counter, defaultdict

import numpy as np
from corpora import documents, edges, empty
from oracle import SF_DIR
from pyspark.sql import functions as F

from siltstone.llm import language_id as L

WORDS = {"en": "the and that with from this have were which their people water house".split(), "de": "und der die nicht mit auch eine werden über schön straße wasser häuser".split(), "fr": "les des une dans pour avec être cette où déjà maison eau française".split()}


def text(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def labelled(spark, n=40):
    rng = random.Random(1)
    return documents(spark, [(i, text(rng, lang, 40), lang) for i, lang in enumerate(list(WORDS) * n)])


class Plain:
    """Interpolated Kneser-Ney over dictionaries of tuples of symbols, without hashes."""

    def __init__(self, texts: list[str], order: int):
        self.order = order
        streams = [L.symbols([t])[0].tolist() for t in texts]
        counts = [Counter() for _ in range(order + 1)]
        for s in streams:
            for i in range(L.ORDER, len(s)):
                counts[order][tuple(s[i - order + 1 : i + 1])] += 1
        for n in range(order - 1, 0, -1):
            # Distinct symbols seen before, in the runs that end in a real symbol.
            before = defaultdict(set)
            for s in streams:
                for i in range(L.ORDER, len(s)):
                    before[tuple(s[i - n + 1 : i + 1])].add(s[i - n])
            counts[n] = Counter({g: len(x) for g, x in before.items()})
        self.counts, self.discount, self.total, self.kinds = counts, [0.0], [Counter()], [Counter()]
        for n in range(1, order + 1):
            n1, n2 = (sum(c == k for c in counts[n].values()) for k in (1, 2))
            self.discount.append(min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.95))
            total, kinds = Counter(), Counter()
            for g, c in counts[n].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.total.append(total)
            self.kinds.append(kinds)
        self.size = len(counts[1]) + 1

    def p(self, run: tuple) -> float:
        n = len(run)
        if not n:
            return 1 / self.size
        below = self.p(run[1:])
        context = run[:-1]
        if not self.total[n][context]:
            return below
        d = self.discount[n]
        return (max(self.counts[n][run] - d, 0) + d * self.kinds[n][context] * below) / self.total[n][context]


def test_log_probabilities_equal_dictionaries():
    rng = random.Random(7)
    samples = {lang: [text(rng, lang, 30) + rng.choice(["", ".", " 12 !"]) for _ in range(20)] for lang in WORDS}
    for order in (2, L.ORDER):
        languages = sorted(samples)
        models = L.Models(languages, [L.kneser_ney(L.symbols(samples[k])[0], order) for k in languages], order)
        plain = [Plain(samples[k], order) for k in languages]
        for t in ["the water that", "straße über wasser", "où être zzqx", "a", "q", "日本 the"]:
            s, _ = L.symbols([t])
            got = models.log_probabilities(s)
            for i in range(L.ORDER, len(s)):
                run = tuple(s[i - order + 1 : i + 1].tolist())
                assert np.allclose(got[i], [math.log(m.p(run)) for m in plain], atol=1e-5), (order, t, i)


def test_probabilities_after_a_context_sum_to_one():
    texts = ["the cat sat on the mat", "a hat that sat"]
    models = L.Models(["x"], [L.kneser_ney(L.symbols(texts)[0], 3)], 3)
    symbols = sorted(set(L.symbols(texts)[0].tolist()) - {L.MARK})
    unseen = ord("z")
    for context in ([ord("t"), ord("h")], [ord("a"), ord("t")], [unseen, ord("q")], [ord("c"), ord("a")], [L.MARK, L.MARK]):
        runs = [np.array([L.MARK] * L.ORDER + context + [x], np.uint64) for x in [*symbols, unseen]]
        total = sum(float(np.exp(np.float64(models.log_probabilities(r)[-1, 0]))) for r in runs)
        assert abs(total - 1) < 1e-6


def test_lookup_finds_what_is_there_and_nothing_else():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64))
    at, found = L._lookup(keys, L._directory(keys), keys)
    assert found.all() and (keys[at] == keys).all()
    missing = np.setdiff1d(keys + np.uint64(1), keys)
    assert not L._lookup(keys, L._directory(keys), missing)[1].any()


def test_held_out_texts_are_told_apart(spark):
    models, thresholds = L.fit([(r.lang, 0, r.text) for r in labelled(spark).collect()])
    rng = random.Random(2)
    for j, lang in enumerate(models.languages):
        x, _ = models.cross_entropies([text(rng, lang, 12) for _ in range(200)])
        assert (x.argmin(axis=1) == j).mean() > 0.99 and (x[:, j] <= thresholds[j] + 0.1).mean() > 0.98
    odd, _ = models.cross_entropies(["zxqj kvwp bzzt qqxk " * 20])
    assert odd.min() > thresholds.max()


def test_sample_is_bounded_and_follows_the_hash(spark):
    rows = [(i, f"text {i}", lang) for i in range(60) for lang in ("en", "de")] + [(i, "y", f"junk{i}") for i in range(50)] + [(7, "a again", "en")] * 3
    found = L.labelled_sample(documents(spark, rows), 20, 1)
    assert {r[0] for r in found} == {"en"} and 17 <= len(found) <= 20 and len({r[1] for r in found}) == len(found)
    assert {r[0] for r in L.labelled_sample(documents(spark, rows), 20, 9)} == {"en", "de"}


def test_documents_of_the_test_tables(spark):
    """Documents that no model was fitted on."""
    d = spark.read.parquet(f"{SF_DIR.replace('sf0.001', 'sf0.01')}/documents.parquet")
    fitted = {(lang, h) for lang, h, _ in L.labelled_sample(d, 60)}
    assert len(fitted) <= 240
    hashed = {r.doc_id: (r.lang, r.h) for r in d.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).collect()}
    found = L.identify(d, 60).join(d.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars >= 200").collect()
    found = [r for r in found if hashed[r.doc_id] not in fitted]
    assert len(found) > 500
    named = [r for r in found if r.language != "und"]
    assert len(named) >= 0.95 * len(found) and sum(r.language == r.lang for r in named) >= 0.97 * len(named)


def test_edges(spark):
    both = labelled(spark, 15).union(edges(spark).withColumn("doc_id", F.col("doc_id") + 1000).withColumn("lang", F.lit(None).cast("string")))
    found = L.identify(both).collect()
    assert len(found) == both.count()
    for r in found:
        if r.doc_id in (1003, 1004, 1005, 1010):  # empty, null, blank, no letter
            assert (r.language, r.cross_entropy, r.margin) == ("und", None, None)
    assert next(r for r in found if r.doc_id == 1011).language == "und"
    assert {r.language for r in L.identify(edges(spark)).collect()} <= {"und", "en"}
    assert L.identify(empty(spark)).collect() == []
    assert {r.language for r in L.identify(documents(spark, [(1, "the house", "en")])).collect()} == {"und"}
