import base64
import random
import unicodedata

import pytest
from corpora import documents, edges, empty

from siltstone.llm import mixing
from siltstone.llm import token_counts as T

tiktoken = pytest.importorskip("tiktoken")


def direct(text: str | None) -> int | None:
    with open(T.TOKENIZER, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("direct", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return None if text is None else len(own.encode_ordinary(unicodedata.normalize("NFC", text)))


TEXTS = ["Hello world", "Hello world", "café", "café", "", None, "<|endoftext|> x", "日本語", " \n\t", "x" * 3000]


def test_counts_are_those_of_the_tokenizer(spark, tmp_path):
    want = {i: direct(t) for i, t in enumerate(TEXTS)}
    cache = f"{tmp_path}/cache"
    d = documents(spark, list(enumerate(TEXTS)))
    assert {r.doc_id: r.n_tokens for r in T.count_tokens(d, cache).collect()} == want
    assert spark.read.parquet(cache).count() == len({unicodedata.normalize("NFC", t) for t in TEXTS if t is not None})

    # A second run encodes and appends only what is new.
    more = documents(spark, [*enumerate(TEXTS), (50, "a new text")])
    assert {r.doc_id: r.n_tokens for r in T.count_tokens(more, cache).collect()} == want | {50: direct("a new text")}
    assert spark.read.parquet(cache).count() == len({unicodedata.normalize("NFC", t) for t in TEXTS if t is not None}) + 1


def test_long_texts_are_encoded_in_stretches_that_change_no_count():
    rng, own = random.Random(5), T.Tokenizer.read()
    for size in range(1, 9):
        for _ in range(300):
            text = "".join(rng.choice("aB1.'s é字\n\t  \x85\x1c\u3000") for _ in range(rng.randrange(30)))
            pieces = list(T.stretches(text, size))
            assert "".join(pieces) == text and sum(map(direct_tokens(own), pieces)) == direct_tokens(own)(text), (text, pieces)


def direct_tokens(own: T.Tokenizer):
    encode = own.encoding().encode_ordinary
    return lambda text: len(encode(text))


def test_white_space_beyond_the_reach_of_the_pattern(spark):
    """The encoder ends with an error at a million of white space before a word; mixing is the first stage of the pipeline to meet it."""
    n = 1_200_000
    d = documents(spark, [(1, "some words" + " " * n + "x"), (2, "other words")])
    want = {1: direct("some words") + direct(" " * (n - 1)) + direct(" x"), 2: direct("other words")}
    assert {r.doc_id: r.n_tokens for r in mixing.copies(d, temperature=1.0).collect()} == want


def test_a_stored_count_is_used_and_another_tokenizer_never_meets_it(spark, tmp_path):
    d = documents(spark, [(1, "some words here")])
    cache, other = f"{tmp_path}/a", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    T.count_tokens(d, cache).collect()
    (row,) = spark.read.parquet(cache).collect()
    planted = f"{tmp_path}/b"
    spark.createDataFrame([(row.tokenizer, row.digest, 777)], T.CACHE_SCHEMA).write.parquet(planted)
    assert T.count_tokens(d, planted).first().n_tokens == 777
    assert T.count_tokens(d, planted, other).first().n_tokens != 777
    assert spark.read.parquet(planted).select("tokenizer").distinct().count() == 2
    assert T.count_tokens(d, planted).first().n_tokens == 777


def test_query_meets_a_half_filled_cache(spark, monkeypatch):
    from oracle import SF_DIR

    met, plain = [], T.count_tokens

    def counted(documents, cache, *rest):
        fs = spark.sparkContext._jvm.java.io.File(cache.removeprefix("file:"))
        before = spark.read.parquet(cache).count() if fs.exists() else 0
        out = plain(documents, cache, *rest)
        met.append((before, spark.read.parquet(cache).count()))
        return out

    monkeypatch.setattr(T, "count_tokens", counted)
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert {r.doc_id: r.n_tokens for r in T.op10_token_counts(spark, SF_DIR).collect()} == {r.doc_id: direct(r.text) for r in rows}
    english = len({r.text for r in rows if r.lang == "en"})
    assert met == [(0, english), (english, len({r.text for r in rows}))]


def test_rows_of_one_doc_id_are_counted_each_by_its_text(spark, tmp_path):
    rows = [(1, "one"), (1, "one two three"), (None, "only here and nowhere else"), (None, "one"), (2, "one two three"), (2, "one")]
    cache = f"{tmp_path}/f"
    found = T.count_tokens(documents(spark, rows), cache).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == sorted((i or 0, direct(t)) for i, t in rows)
    assert spark.read.parquet(cache).count() == 3
    with pytest.raises(TypeError, match="doc_id"):
        T.count_tokens(documents(spark, rows).selectExpr("text as doc_id", "text"), cache)


def test_edges(spark, tmp_path):
    d = edges(spark)
    found = T.count_tokens(d, f"{tmp_path}/c").collect()
    assert len(found) == d.count()
    assert [r.n_tokens for r in found if r.doc_id in (3, 4)].count(None) == 1 and 0 in [r.n_tokens for r in found if r.doc_id == 3]
    assert len({r.n_tokens for r in found if r.doc_id in (1, 2, 7)}) == 1
    assert T.count_tokens(empty(spark), f"{tmp_path}/d").collect() == []
    nulls = documents(spark, [(1, None)])
    assert [tuple(r) for r in T.count_tokens(nulls, f"{tmp_path}/e").collect()] == [(1, None)]
