"""The isolation forest of rule statistics and the line field, against brute force and held-out labels."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from corpora import documents, edges, empty
from oracle import SF_DIR
from pyspark.sql import functions as F

from siltstone.llm import _features, quality_crf, quality_rules

LABELS = "doc_id long, quality int, toxic int, text string"
BAD = ["BUY NOW!!! $$$ CLICK", "zzzz zzzz zzzz zzzz", "### *** @@@ %%%", "WIN WIN WIN FREE $$$"]


def sentence(rng: random.Random) -> str:
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 14))]
    return " ".join([words[0].capitalize(), *words[1:]]) + rng.choice("..!?")


def corpus(spark, n=240):
    """Three documents of sentences to one of junk lines; the labels are doubled by a column of the documents' name."""
    rng = random.Random(3)
    rows = [(i, "\n".join(sentence(rng) if i % 4 else rng.choice(BAD) for _ in range(rng.randrange(4, 12)))) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0, "clash") for i in range(n)], LABELS)
    return documents(spark, rows), labels


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    first = np.array([0, 1, 5, 5 + 7])
    score, transition = rng.normal(0, 2, 12), np.array([0.7, -0.4])
    good, expect, log_z = quality_crf.marginals(score, first, transition)
    want_good, want_expect, want_z = np.zeros(12), np.zeros(2), 0.0
    for a, b in itertools.pairwise(first):
        weight, marginal, pairs = 0.0, np.zeros(b - a), np.zeros(2)
        for labels in itertools.product([1, 0], repeat=b - a):
            x = np.array(labels)
            stay = np.array([((x[1:] == 1) & (x[:-1] == 1)).sum(), ((x[1:] == 0) & (x[:-1] == 0)).sum()])
            w = np.exp(score[a:b] @ x + transition @ stay)
            weight, marginal, pairs = weight + w, marginal + w * x, pairs + w * stay
        want_good[a:b], want_expect, want_z = marginal / weight, want_expect + pairs / weight, want_z + np.log(weight)
    assert np.allclose(good, want_good) and np.allclose(expect, want_expect) and np.isclose(log_z, want_z)


def test_neighbours_stop_at_the_ends_of_documents():
    line = np.arange(1.0, 6.0)[:, None]
    x = quality_crf.neighbours(line, np.array([0, 2, 5]))
    assert x.tolist() == [[1, 0, 2, 1, 0], [2, 1, 0, 0, 1], [3, 0, 4, 1, 0], [4, 3, 5, 0, 0], [5, 4, 0, 0, 1]]


def test_quality_is_weighted_by_length():
    found = quality_crf.document_quality(np.array([1.0, 0.0, 0.5]), np.array([30.0, 10.0, 0.0]), np.array([0, 2, 3]))
    assert found.tolist() == [0.75, 0.0]


def test_anomaly_equals_a_walk_down_every_tree():
    rng = np.random.default_rng(5)
    forest = quality_rules.grow(rng.normal(0, 1, (300, 4)), trees=12, depth=6)
    rows = rng.normal(0, 2, (50, 4))

    def path(tree, row):
        at = 0
        while forest["feature"][tree, at] >= 0:
            at = 2 * at + 1 + int(row[forest["feature"][tree, at]] >= forest["value"][tree, at])
        return forest["length"][tree, at]

    want = [2.0 ** (-np.mean([path(t, r) for t in range(12)]) / quality_rules.average_path(quality_rules.SAMPLE)) for r in rows]
    found = quality_rules.anomaly(rows, forest)
    assert np.allclose(found, want, rtol=1e-5)
    near, far = quality_rules.anomaly(np.zeros((1, 4)), forest), quality_rules.anomaly(np.full((1, 4), 9.0), forest)
    assert far[0] > near[0]


def test_threshold_loses_few_good_rows():
    rng = np.random.default_rng(6)
    scores = np.concatenate([rng.normal(0.4, 0.02, 1000), rng.normal(0.6, 0.05, 200)])
    good = np.arange(1200) < 1000
    cut = quality_rules.calibrated(scores, good, 0.003)
    assert (scores[good] > cut).mean() <= 0.003 and (scores[~good] > cut).mean() > 0.9
    assert quality_rules.calibrated(scores, np.zeros(1200, bool)) == np.inf


def test_features_of_rows_do_not_depend_on_their_neighbours():
    import pyarrow as pa

    texts = ["", "One line.", "a\n\nb b b\n", None, "ÀÉ über 12 $$$!", "\n"]
    together = next(_features.measured(pa.array(texts, pa.string())))[2]
    line, length, first, doc = together
    for i, t in enumerate(texts):
        own_line, own_length, own_first, own_doc = next(_features.measured(pa.array([t], pa.string())))[2]
        assert np.allclose(doc[i], own_doc[0]) and np.allclose(line[first[i] : first[i + 1]], own_line)
        assert len(own_line) == (t or "").count("\n") + 1


def naive_words(line: str) -> list[str]:
    return re.findall(r"[\u3000-\udfff]|[A-Za-z0-9\u0080-\u2fff\ue000-\uffff]+", line)


def naive(text: str) -> tuple[list[list[float]], list[float]]:
    """Every statistic of a text's lines and of the text, character by character."""
    size = lambda ws: sum(len(w.encode()) for w in ws)
    lower = lambda c: c.isascii() and c.islower()
    upper = lambda c: c.isascii() and c.isupper() or "\u00c0" <= c <= "\u00de"
    lead = lambda c: ord(c) > 127 and not upper(c)
    stop, inner = ".!?", ",;:'\"-()"
    symbol = lambda c: c.isascii() and not c.isalnum() and not c.isspace() and c not in stop + inner
    n = lambda f, s: sum(map(f, s))
    lines, seen, out = text.split("\n"), set(), []
    again = []
    for line in lines:
        words, chars = naive_words(line), max(len(line), 1)
        spans = [m.end() for m in re.finditer(r"[\u3000-\udfff]|[A-Za-z0-9\u0080-\u2fff\ue000-\uffff]+", line)]
        marked = sum(e < len(line) and symbol(line[e]) for e in spans)
        again.append(bool(words) and line in seen)
        seen.add(line)
        w1 = max(len(words), 1)
        letters = n(lower, line) + n(upper, line) + n(lead, line)
        longest = max([len(w.encode()) for w in words], default=0)
        out.append([np.log1p(len(line)), np.log1p(len(words)), size(words) / w1, n(upper, line) / chars, n(lambda c: c in "0123456789", line) / chars, n(symbol, line) / chars, n(lambda c: c in inner, line) / chars,
            float(line[-1:] in (".", "!", "?")), letters / chars, (len(words) - len(set(words))) / w1, marked / w1, float(bool(words) and upper(words[0][0])), float(again[-1]), np.log1p(longest), n(lambda c: c in stop, line) / chars])
    words, chars = [w for line in lines for w in naive_words(line)], max(len(text), 1)
    w1, counts = max(len(words), 1), Counter(words)
    real = [i for i, line in enumerate(lines) if naive_words(line)]
    r1 = max(len(real), 1)
    marked = sum(round(x[10] * max(len(naive_words(line)), 1)) for x, line in zip(out, lines))
    doc = [np.log1p(len(words)), size(words) / w1, n(upper, text) / chars, n(lambda c: c in "0123456789", text) / chars, n(symbol, text) / chars, n(lambda c: c in inner, text) / chars, n(lambda c: c in stop, text) / chars,
        (n(lower, text) + n(upper, text) + n(lead, text)) / chars, (len(words) - len(counts)) / w1, marked / w1, sum(out[i][7] for i in real) / r1, sum(again[i] for i in real) / r1, sum(len(naive_words(lines[i])) < 4 for i in real) / r1,
        np.log1p(len(words) / r1), max(counts.values(), default=0) / w1, sum(upper(w[0]) for w in words) / w1, np.log1p(len(real)), np.log1p(len(text))]
    return out, doc


def test_features_equal_naive_ones():
    import pyarrow as pa

    rng = random.Random(12)
    bits = ["word", "Word", "ÉTÉ", "été", "$$$", "x1", "1999", "...", "!", "(a)", "日本語", "ß", "-", ",", "  ", "\t", "the the", "\u2014", "a$", "\n", "\n\n", "\nSame line.\nSame line."]
    texts = ["", "\n", "a", "A.\n", "$$$ ###", *(" ".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(150))]
    line, length, first, doc = next(_features.measured(pa.array(texts)))[2]
    for i, t in enumerate(texts):
        lines, whole = naive(t)
        assert np.allclose(line[first[i] : first[i + 1]], lines, atol=1e-12), t
        assert np.allclose(doc[i], whole, atol=1e-12), (t, dict(zip(_features.DOC_FEATURES, zip(doc[i], whole))))
        assert length[first[i] : first[i + 1]].tolist() == [len(x.encode()) for x in t.split("\n")]


def test_line_runs():
    good = np.array([True, True, False, False, True, False, True])
    assert quality_crf.label_runs(good, np.array([0, 3, 4, 7])) == ["2,1", "0,1", "1,1,1"]
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 9, 12)
        first, good = np.concatenate([[0], np.cumsum(lengths)]), rng.random(lengths.sum()) < 0.6
        for told, a, b in zip(quality_crf.label_runs(good, first), first[:-1], first[1:]):
            back = [x for i, n in enumerate(map(int, told.split(","))) for x in [i % 2 == 0] * n]
            assert back == good[a:b].tolist()


def test_query_equals_forward_backward_document_by_document(spark):
    """op7 on the whole table: each document alone, by exact marginals of its own lines."""
    import pyarrow as pa

    d, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_crf.fit(d, labels)
    texts = {r.doc_id: r.text for r in d.collect()}
    for r in quality_crf.op7_quality_crf(spark, SF_DIR).collect():
        line, length, first, _ = next(_features.measured(pa.array([texts[r.doc_id]])))[2]
        x = np.hstack([quality_crf.neighbours((line - model["mean"]) / model["spread"], first), np.ones((len(line), 1))])
        good, _, _ = quality_crf.marginals(x @ model["weights"], first, model["transition"])
        want = float((good * length).sum() / length.sum()) if length.sum() else 0.0
        assert abs(r.quality - want) < 1e-9 and r.good == (r.quality >= model["threshold"])
        assert sum(map(int, r.line_runs.split(","))) == len(line)


def test_a_long_text_of_symbols_is_rejected(spark):
    d, labels = (spark.read.parquet(f"{SF_DIR.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    odd = documents(spark, [(-1, "$$$ ### *** " * 1700), (-2, "@" * 5000)]).select(*d.columns)
    found = {r.doc_id: r.rejected for r in quality_rules.judge_documents(d.union(odd), labels).where("doc_id < 0").collect()}
    assert found == {-1: True, -2: True}


@pytest.mark.parametrize("op", ["rules", "field"])
def test_good_and_bad_documents_are_told_apart(spark, op):
    d, labels = corpus(spark)
    if op == "rules":
        wrong = {r.doc_id: r.rejected for r in quality_rules.judge_documents(d, labels).collect()}
    else:
        wrong = {r.doc_id: not r.good for r in quality_crf.classify(d, labels).collect()}
    good, bad = [w for i, w in wrong.items() if i % 4], [w for i, w in wrong.items() if not i % 4]
    assert np.mean(good) <= 0.05 and np.mean(bad) >= 0.9, (np.mean(good), np.mean(bad))


def test_labels_of_the_test_tables(spark):
    d, labels = (spark.read.parquet(f"{SF_DIR.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    for found in (quality_rules.judge_documents(d, labels).selectExpr("doc_id", "rejected as bad"), quality_crf.classify(d, labels).selectExpr("doc_id", "not good as bad")):
        rows = found.join(labels, "doc_id").collect()
        # Only rows that neither model was grown or trained on.
        ids, kind = (np.array(x) for x in zip(*sorted((r.doc_id, r.quality > 0) for r in rows)))
        grown = set(ids[quality_rules.first_half(ids, kind)].tolist())
        rows = [r for r in rows if r.doc_id not in grown]
        good, bad = [r.bad for r in rows if r.quality == 1], [r.bad for r in rows if r.quality == 0]
        assert np.mean(good) <= 0.02 and np.mean(bad) >= 0.75, (np.mean(good), np.mean(bad))


def test_edges(spark):
    d, labels = corpus(spark, 120)
    odd = labels.union(spark.createDataFrame([(None, 1, 0, None), (5, None, 0, None), (5, 0, 0, None), (99_999, 1, 0, None)], LABELS))
    e = edges(spark).withColumn("doc_id", F.col("doc_id") + 1000)
    both = d.union(e)
    judged, fielded = quality_rules.judge_documents(both, odd).collect(), quality_crf.classify(both, odd).collect()
    assert len(judged) == len(fielded) == both.count()
    assert all(r.anomaly is not None for r in judged)
    assert all((r.quality, r.good) == (0.0, False) for r in fielded if r.doc_id in (1003, 1004))
    kept = quality_rules.drop_rejected(both, odd)
    assert kept.schema == both.schema and kept.count() == sum(not r.rejected for r in judged)
    none = labels.limit(0)
    assert not any(r.rejected for r in quality_rules.judge_documents(e, none).collect())
    assert all(r.good and r.quality is None for r in quality_crf.classify(e, none).collect())
    assert quality_rules.judge_documents(empty(spark), labels).collect() == [] and quality_crf.classify(empty(spark), labels).collect() == []
    assert quality_rules.drop_rejected(empty(spark), labels).collect() == []


def test_texts_of_the_sample_stay_off_the_driver(spark, monkeypatch):
    """Long labelled texts: the field is trained where their lines lie, and is that which the driver trains."""
    d, labels = corpus(spark, 80)
    seen, collect = [], type(d).collect
    monkeypatch.setattr(type(d), "collect", lambda self: seen.append(collect(self)) or seen[-1])
    here = quality_crf.fit(d, labels, epochs=4)
    monkeypatch.setattr(quality_crf, "LOCAL_LINES", 0)
    monkeypatch.setattr(quality_crf, "CHUNK_LINES", 50)
    assert here and not any(isinstance(x, str) for rows in seen for r in rows for x in r)
    seen.clear()
    there = quality_crf.fit(d, labels, epochs=4)
    assert not any(isinstance(x, str | bytes | bytearray) for rows in seen for r in rows for x in r)
    assert all(np.allclose(here[k], there[k], rtol=1e-6, atol=1e-9) for k in here)


def test_the_rules_are_fitted_on_every_labelled_row(spark, tmp_path):
    """Each labelled row is in a half, each of the good half in a tree, and the threshold is that of all of the other half."""
    n = 4_600
    d = documents(spark, [(i, "The river runs on. " * (1 + i % 3)) for i in range(n)])
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(n)], "doc_id long, quality int")
    rows = quality_rules.labelled(quality_rules.measured(d), labels, quality_rules.Scratch(spark, "t", f"{tmp_path}/t")).collect()
    found = sorted((r.id, r.good, r.half) for r in rows)
    ids, good = np.arange(n), np.arange(n) % 4 > 0
    assert [r[0] for r in found] == ids.tolist() and [r[1] for r in found] == good.tolist()
    assert [r[2] for r in found] == quality_rules.first_half(ids, good).tolist()
    for share in (1, 3, quality_rules.TREES):
        trees = quality_rules.trees_of(ids, share)
        assert all(len(set(t)) == share for t in trees.tolist()) and np.bincount(trees.astype(int).ravel(), minlength=quality_rules.TREES).min() > 0
    rng = np.random.default_rng(8)
    for bad in (0, 700):
        scores = np.round(np.concatenate([rng.normal(0.4, 0.03, 3000), rng.normal(0.5, 0.05, bad)]), 3)
        kind = np.arange(len(scores)) < 3000
        table = spark.createDataFrame(list(zip(scores.tolist(), kind.tolist())), "anomaly double, good boolean").repartition(3)
        assert quality_rules.threshold(table, 3000, bad) == pytest.approx(quality_rules.calibrated(scores, kind), abs=1e-12)
