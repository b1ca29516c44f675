"""The stages together, against each one's brute force over what it was given."""

from collections import Counter, defaultdict

import pytest
from oracle import SF_DIR
from test_line_dedup import brute as lines_of
from test_line_dedup import trimmed
from corpora import edges, empty
from test_mixing import brute as copies_of
from test_mixing import measured
from test_near_dup import brute_groups

import corpus_pipeline
from siltstone.llm import near_dup, packing
from siltstone.llm.token_counts import Tokenizer


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage, each written and read again."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF_DIR).write.parquet(f"{root}/{i}")
        tables.append(spark.read.parquet(f"{root}/{i}"))
    return [t.collect() for t in tables], [t.columns for t in tables]


def test_columns_and_names(stages):
    _, columns = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "mixing", "packing"]
    assert all(c == columns[0] for c in columns[:-1])


def test_rules_only_take_documents_away(stages):
    (before, after, *_), _ = stages
    left = Counter(map(tuple, after))
    assert left and not left - Counter(map(tuple, before))
    assert len(after) >= 0.8 * len(before)


def test_lines(stages):
    (_, before, after, *_), _ = stages
    want = {}
    keep = lines_of([(r.doc_id, r.text) for r in before])
    for r in before:
        kept = keep[r.doc_id]
        lines = [x for x, k in zip((r.text or "").split("\n"), kept) if k]
        if all(kept) or any(trimmed(x) for x in lines):
            want[r.doc_id] = r.text if all(kept) else "\n".join(lines)
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after if r.text != next(b.text for b in before if b.doc_id == r.doc_id))


def test_near_copies(stages):
    (_, _, before, after, *_), _ = stages
    gone = set(brute_groups({r.doc_id: r.text for r in before}, near_dup.THRESHOLD))
    left = {r.doc_id for r in after}
    dropped = {r.doc_id for r in before} - left
    assert dropped <= gone and len(dropped) >= 0.95 * len(gone)


def test_mix(spark, stages):
    (_, _, _, before, after, _), _ = stages
    want = copies_of(measured(spark, before, [spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels")]))
    got = Counter((r.doc_id, r.source) for r in after)
    assert sum((got - Counter(want)).values()) + sum((Counter(want) - got).values()) == 0


def test_packed_sequences_hold_every_token(stages):
    (*_, before, after), _ = stages
    encode = Tokenizer.read().encoding().encode_ordinary
    tokens, packed, at = Counter(), Counter(), defaultdict(list)
    for r in before:
        tokens[r.doc_id] += len(encode(r.text)) if r.text else 0
    for p in after:
        packed[p.doc_id] += p.n_tokens
        at[p.sequence].append((p.offset, p.n_tokens))
    assert packed == +tokens
    for spans in at.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= packing.CAPACITY


def test_run_is_the_stages_in_turn(spark, stages):
    tables, _ = stages
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    key = lambda rows: Counter((r.doc_id, r.chunk, r.n_tokens) for r in rows)
    assert key(found) == key(tables[-1])


def written(spark, root, docs) -> str:
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 1), (9, 0), (10, 0), (None, 1), (3, None)], "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_nulls_repeated_rows_and_clashing_columns_go_through_every_stage(spark, tmp_path):
    docs = edges(spark)
    sf_dir, table = written(spark, tmp_path / "in", docs), docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, sf_dir).write.parquet(f"{tmp_path}/{i}")
        table = spark.read.parquet(f"{tmp_path}/{i}")
        assert table.columns == (docs.columns if name != "packing" else ["doc_id", "chunk", "n_tokens", "sequence", "offset"])
    run = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in run} == {r.doc_id for r in table.collect()} and {1, 6, 11} <= {r.doc_id for r in run}
    # Whole documents: nothing of the long one is cut off.
    assert sum(r.n_tokens for r in run if r.doc_id == 6) > 100_000


def test_no_documents_give_no_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "none", empty(spark))).collect() == []
