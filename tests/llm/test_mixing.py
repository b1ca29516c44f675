import hashlib
import math
import random

import pytest
from corpora import documents, edges, empty
from oracle import SF_DIR

from siltstone.llm import mixing, quality_crf
from siltstone.llm.token_counts import Tokenizer


def brute(rows: list[tuple], weights=None, budget=None, temperature=mixing.TEMPERATURE) -> dict:
    """(doc_id, source) -> copies, of rows (doc_id, source, tokens, weight); doc_ids are not null."""
    once = {}
    for doc_id, source, n, w in rows:
        once[doc_id, source] = max(once.get((doc_id, source), (0, 0.0)), (n, w))
    docs, have = [], {}
    for (doc_id, source), (n, w) in once.items():
        bits = int(hashlib.md5(f"{doc_id}:{mixing.SEED}".encode()).hexdigest()[:13], 16)
        docs.append((source, -math.log((bits + 0.5) / 2**52) / w, doc_id, n))
        have[source] = have.get(source, 0) + n
    share = {s: weights.get(s, 0.0) for s in have} if weights is not None else {s: float(t) ** temperature for s, t in have.items()}
    whole = sum(share.values())
    total = sum(have.values()) if budget is None else budget
    out = {}
    for s in have:
        target = math.floor(total * share[s] / whole) if whole else 0
        epochs = target // have[s] if have[s] else 0
        rest, spent = target - epochs * have[s], 0
        for _, _, doc_id, n in sorted(d for d in docs if d[0] == s):
            copies = epochs + (spent < rest)
            if copies:
                out[doc_id, s] = copies
            spent += n
    return out


def measured(spark, rows, labels) -> list[tuple]:
    """(doc_id, source, tokens, weight) of rows of documents, text by text: by the tokenizer itself, and by the field's quality of the text."""
    said = Tokenizer.read()
    model = quality_crf.fit(*labels)
    import pyarrow as pa

    out = []
    for r in rows:
        ((_, _, q),) = quality_crf.qualities(pa.array([r.text], pa.string()), model)
        out.append((r.doc_id, r.source, len(said.encoding().encode_ordinary(r.text or "")), mixing.LEAST_WEIGHT + (1 - mixing.LEAST_WEIGHT) * float(q[0])))
    return out


def made(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(0, 60), rng.random() + 0.01) for i in range(400)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n int, weight double").selectExpr("*", "cast(null as string) text", "1 key", "2 mixed_copies")


COLUMNS = {"tokens": "n", "weight": "weight"}


@pytest.mark.parametrize("given", [{}, {"weights": {"a": 1, "c": 3}}, {"budget": 900}, {"weights": {"b": 1}, "budget": 100_000}])
def test_copies_equal_brute_force(spark, monkeypatch, given):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = made(4)
    d = table(spark, rows)
    found = mixing.copies(d, **COLUMNS, **given).collect()
    assert {(r.doc_id, r.source): r.copies for r in found} == brute(rows, **given)
    mixed = mixing.mix_sources(d, **COLUMNS, **given)
    assert mixed.columns == d.columns and mixed.count() == sum(r.copies for r in found)


def test_query_equals_brute_force(spark):
    sf_dir = SF_DIR.replace("sf0.001", "sf0.01")
    labels = tuple(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    want = measured(spark, labels[0].collect(), labels)
    found = mixing.op6_mixing(spark, sf_dir).collect()
    assert {(r.doc_id, r.source): r.copies for r in found} == brute(want)
    tokens = {(i, s): n for i, s, n, _ in want}
    assert all(r.n_tokens == tokens[r.doc_id, r.source] for r in found)


def test_sources_get_their_tokens(spark):
    got = {}
    for r in mixing.copies(table(spark, made(6)), None, {"a": 1, "b": 1, "c": 2}, 40_000, **COLUMNS).collect():
        got[r.source] = got.get(r.source, 0) + r.copies * r.n_tokens
    assert all(0 <= got[s] - t < 60 for s, t in (("a", 10_000), ("b", 10_000), ("c", 20_000)))


def test_better_documents_are_sampled_more_often(spark):
    rows = [(i, "a", 3, 1.0 if i % 2 else 0.1) for i in range(2000)]
    found = mixing.copies(table(spark, rows), budget=2000, **COLUMNS).collect()
    assert sum(r.doc_id % 2 for r in found) / len(found) > 0.8


def test_edges(spark):
    d = edges(spark)
    labels = spark.createDataFrame([(1, 1), (9, 0), (None, 1), (2, None)], "doc_id long, quality int")
    for found in (mixing.copies(d).collect(), mixing.copies(d, labels).collect()):
        assert {r.source for r in found} <= {"src", "other", None} and all(r.doc_id is not None for r in found)
        assert len({(r.doc_id, r.source) for r in found}) == len(found)
        assert None in {r.source for r in found}  # doc 8 has a row without a source
    mixed = mixing.mix_sources(d)
    assert mixed.columns == d.columns and mixed.count()
    assert mixing.copies(empty(spark)).collect() == [] and mixing.mix_sources(empty(spark), labels).collect() == []
    assert mixing.copies(d, budget=0).collect() == [] and mixing.copies(d, None, {"nowhere": 1}).collect() == []
    odd = table(spark, [(1, "a", None, None), (2, "a", -5, -1.0), (3, "a", 7, 1.0), (3, "a", 7, 1.0), (4, None, 2, 0.0)])
    assert {r.doc_id: r.n_tokens for r in mixing.copies(odd, budget=1000, **COLUMNS).collect()} == {1: 0, 2: 0, 3: 7, 4: 2}
    with pytest.raises(TypeError, match="doc_id"):
        mixing.copies(d.withColumn("doc_id", d.text))
    clash = documents(spark, [(1, "a b c")]).withColumnRenamed("n", "mixed_doc").withColumnRenamed("key", "mixed_source")
    assert mixing.mix_sources(clash).columns == clash.columns and mixing.mix_sources(clash).count() == 1
