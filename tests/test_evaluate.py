"""Evaluation: recall, order statistics, generated queries, reports."""

import statistics

from pyspark.sql import functions as F

from siltstone.config import IndexConfig
from siltstone.operators import evaluate as E


def test_recall(spark):
    hits = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 9)], "query_id long, rank int, doc_id long")
    truth = spark.createDataFrame([(1, 10), (1, 12), (2, 1), (3, 5)], "query_id long, doc_id long")
    assert {r.query_id: r.recall for r in E.recall(hits, truth, 10).collect()} == {1: 0.5, 2: 0.0, 3: 0.0}


def test_summary_equals_sorted_lists(spark):
    groups = {"a": [float(x * 7 % 101) for x in range(101)], "b": [3.0], "c": [2.0, 1.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("a", None)], "k string, v double")
    for r in E.summary(df, "k", "v").collect():
        v = sorted(groups[r.k])
        at = lambda p: v[min(len(v) - 1, int(p / 100 * len(v)))]
        assert (r.p50, r.p95, r.p99, r["median"]) == (at(50), at(95), at(99), statistics.median(v))
        assert abs(r["mean"] - statistics.mean(v)) < 1e-9 and abs(r.stddev - (statistics.stdev(v) if len(v) > 1 else 0)) < 1e-9


def test_ring_holds_the_last_values(spark):
    df = spark.createDataFrame([("x", i, float(i)) for i in range(40)], "k string, t long, v double")
    got = {r.t: r.p50 for r in E.latency_ring(df, ["k"], "t", "v", 50).collect()}
    assert got == {i: float(sorted(range(max(0, i - 31), i + 1))[int(0.5 * (min(i + 1, 32) - 1))]) for i in range(40)}


def test_queries_are_drawn_from_the_documents(spark):
    docs = [{"title": f"Quick brown foxes number{i % 7} jumpOver", "body": f"some_symbol alpha beta gamma delta {i} 微博热搜"} for i in range(50)]
    made = E.generate_queries(docs, 100)
    assert made == E.generate_queries(docs, 100) and made != E.generate_queries(docs, 100, seed=1)
    kinds = [q["kind"] for q in made]
    assert kinds.count("single") == 45 and kinds.count("pair") == 15 and kinds.count("typo") <= 10
    assert all(q["needles"] and (q["kind"] == "typo" or q["needles"] == q["text"].lower().split(" ")) for q in made)
    table = spark.createDataFrame([(i, d["title"], d["body"]) for i, d in enumerate(docs)], "doc_id long, title string, body string")
    drawn = E.query_mix(table, 100, order_by="doc_id")
    assert len(drawn) == len(E.query_mix(table.repartition(5), 100, order_by="doc_id")) and drawn == E.query_mix(table.repartition(5), 100, order_by="doc_id")
    assert E.query_mix(table.limit(0), 10, order_by="doc_id") == []


def test_a_dataset_is_reported_within_its_budgets(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"quick fox number{i}", f"alpha beta {i}") for i in range(40)], "doc_id long, title string, body string")
    config = IndexConfig({"title": 5, "body": 1}, id_column="doc_id")
    mix = [{"query_id": i, "text": t, "needles": [t]} for i, t in enumerate(("number7", "fox", "alpha"))]
    hay = E.haystack("title", "body")
    row = E.run_dataset("small", docs, config, mix, hay, f"{tmp_path}/a", passes=2, budgets=E.Budgets(600, 600, 600))
    assert row["docs"] == 40 and row["recall"] == 1.0 and row["seconds"] > 0 and row["index_bytes"] > 0
    slow = E.run_dataset("small", docs, config, mix, hay, f"{tmp_path}/b", budgets=E.Budgets(0.0))
    assert slow["build_s"] > 0 and slow["seconds"] is None and "| N/A |" in E.render_table([slow], ["dataset", "seconds", "build_s"])
    assert E.run_dataset("small", docs, config, mix, hay, f"{tmp_path}/c", budgets=E.Budgets(600, 0.0))["recall"] is None


def test_truth_needs_every_needle(spark):
    d = spark.createDataFrame([(1, "Red green"), (2, "redgreen blue"), (3, None), (4, "BLUE")], "id long, t string")
    q = spark.createDataFrame([(1, ["red", "green"]), (2, ["Blue"]), (3, ["red", "red"]), (4, []), (5, None), (6, ["een b"])], "query_id long, needles array<string>")
    found = sorted(map(tuple, E.substring_truth(d, "id", E.haystack("t"), q).collect()))
    assert found == [(1, 1), (1, 2), (2, 2), (2, 4), (3, 1), (3, 2), (4, 1), (4, 2), (4, 3), (4, 4), (6, 2)]
    assert E.substring_truth(d, "id", E.haystack("t"), q.limit(0)).collect() == []


def test_helpers():
    assert E.fnv1a("") == 0x811C9DC5 and E.fnv1a("a") == 0xE40C292C
    rng = E.Mulberry32(1)
    assert all(0 <= rng() < 1 for _ in range(1000))
    assert E.inject_typo("abc", rng) == "abc" and E.ascii_words("The Quick, fox is it") == ["quick", "fox"]
    assert E.render_table([{"a": 1.5, "b": None}], ["a", "b"]).splitlines() == ["| a | b |", "| --- | --- |", "| 1.500 | N/A |"]


def test_queries_that_some_text_holds_are_told_once_however_many_texts_do():
    import pyarrow as pa

    texts = ["the apache license", None, "apache", "", "mit License x"] * 3_000
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(texts)), pa.array([t and t.lower() for t in texts])], names=["_one", "_hay"])
    rows = [(0, ["apache"]), (1, ["apache", "license"]), (2, ["apache", "mit"]), (3, []), (4, ["zz"]), (5, ["MIT"])]
    told = [q for b in E._held_of(rows)([batch, batch]) for q in b.column(0).to_pylist()]
    assert sorted(told) == [0, 1, 3, 5]
    truth = list(E._truth_of(rows)([batch]))
    assert max(b.num_rows for b in truth) <= E.TRUTH_ROWS * len(rows) and sum(b.num_rows for b in truth) == 6_000 + 3_000 + 15_000
