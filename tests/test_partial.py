"""Indexing only what a batch looks up, against the whole index."""

import random
import re

import pytest

from siltstone.config import EXACT, SIGNAL, FieldSpec, IndexConfig, SearchOptions, SuggestOptions
from siltstone.operators import build, search
from siltstone.operators.search import DocumentSearch, SearchEngine
from siltstone.plans import registry

WORDS = "apache license mit the a b rc4 rc 7 lic licnse licens 健 康 微博 x1 ünx pub gen eral general gnu q apachelicense licensemit".split()
CONFIG = IndexConfig((FieldSpec("title", 5), FieldSpec("body", 1.5), FieldSpec("link", 1, "url")), id_column="doc_id", tags_field="lang")
QUERIES = ["apache license", "the", "licnese", "generl gnu", "健康", "rc4 rc", "mitlicense", "zzzz", "apachelicense", "ÉCOLE straße"]


def test_wanted_features_have_the_scores_of_all_features():
    rng, met = random.Random(3), 0
    cuts = frozenset(d for w in ("licnese", "gneral") for d in [w, *build._cuts(w)])
    begins = {"l": frozenset({7}), "g": frozenset({6})}

    def near(term: str) -> bool:
        return bool(re.fullmatch("[a-z0-9]{3,14}", term) and build._cuts(term) & cuts and any(abs(n - len(term)) <= 2 for n in begins.get(term[0], ())))

    for _ in range(1_000):
        parts = [{"weight": w, "window": 3, "url": u, "text": " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 2, 3, 8, 30])))} for w, u in ((5.0, False), (1.0, False), (rng.choice([2.5, 7.0]), rng.random() < 0.3))]
        every = build.features_of(parts)
        for t in range(6):
            assert build.features_of(parts, frozenset({t})) == {k: own if k == t else {} for k, own in every.items()}
        terms = {t: frozenset(x for x in [*every[t], "zz"] if rng.random() < 0.4) for t in range(6)}
        want = {t: {x: s for x, s in every[t].items() if x in terms[t] or t in (EXACT, SIGNAL) and near(x) or t == EXACT and x.startswith(("mi", "pub"))} for t in range(6)}
        assert build.Lookup(build.Wanted(terms, cuts, begins, ("mi", "pub"))).features(parts) == want
        met += sum(map(len, want.values()))
    assert met > 10_000


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(8)
    text = lambda n: rng.choice([None, "", " ".join(rng.choice([*WORDS, "École", "STRASSE", "straße", "Σας", "ﬁne", "한글"]) for _ in range(n))])
    rows = [(i // 2, text(3), text(40), rng.choice([None, "http://a.b/the-license"]), rng.choice([None, "", "en", "fr"])) for i in range(200)]
    return spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id long, title string, body string, link string, lang string")


def rows_of(df) -> list:
    return sorted(map(repr, df.collect()))


def test_answers_are_those_of_the_whole_index(documents):
    whole, parts = SearchEngine(build.build_index(documents, CONFIG)), DocumentSearch(documents, CONFIG)
    hits, corrections, rewrites = whole.search_detailed(QUERIES, SearchOptions(min_score_ratio=0.0))
    got = parts.search_detailed(QUERIES, SearchOptions(min_score_ratio=0.0))
    assert hits.count() > 50 and [rows_of(x) for x in got] == [rows_of(x) for x in (hits, corrections, rewrites)]
    assert rows_of(parts.fuzzy_terms(QUERIES)) == rows_of(whole.fuzzy_terms(QUERIES))
    for options in (SuggestOptions(), SuggestOptions(fuzzy=False)):
        assert rows_of(parts.suggest(["lic", "apahc", "the", "x"], options)) == rows_of(whole.suggest(["lic", "apahc", "the", "x"], options))
    for t in range(6):
        own = build.partial_index(documents, CONFIG, build.Wanted(types=frozenset({t})), listed=False).postings
        assert rows_of(own.select("ftype", "term", "doc_ord", "score")) == rows_of(whole.index.postings.where(f"ftype = {t}"))
    assert "index" not in parts.__dict__


def test_no_documents(spark, documents):
    none = DocumentSearch(documents.where("false"), CONFIG)
    assert none.search(["the", "licnese"]).collect() == [] and none.suggest(["the"]).collect() == []


@pytest.mark.parametrize("name", ["search_fuzzy", "suggest_fuzzy", "ascii_bigrams"])
def test_registered_searches_build_no_whole_index(spark, monkeypatch, name):
    def built(*_):
        raise AssertionError("a whole index")

    monkeypatch.setattr(registry, "_engines", {})
    for module in (build, search):
        monkeypatch.setattr(module, "build_index", built)
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count()
