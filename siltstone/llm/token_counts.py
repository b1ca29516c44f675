"""Token counts through a digest cache.

The cache is a table (tokenizer, digest, n_tokens). A text's digest is that of its NFC form; the
tokenizer's digest covers its vocabulary file, pattern, library version and the normalisation, so a change of any of them
never meets old counts. Only distinct digests that the cache lacks are encoded, and then appended to it. For each of them the
row of the least doc_id is encoded where it is read: between the passes over the texts only ids and digests are shuffled.
The vocabulary is read once, by the driver, and broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import types
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._scratch import Scratch, doc_id, sized

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
NORMALISATION = "nfc-1"
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: What the pattern's \\s matches, which is less than str.isspace().
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE, OTHER = re.compile(f"[{WHITE}]"), re.compile(f"[^{WHITE}]")
#: Characters of a long text that are encoded at once. The encoder's pattern gives up, with an error, at a million of white space before a word.
STRETCH = 1 << 18
#: Stands for a null doc_id where rows are looked up by it.
NO_ID = -(1 << 63)


def nfc(text: str) -> str:
    return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def digest(text: str) -> bytes:
    """128 bits of BLAKE2b of a text in NFC."""
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def stretches(text: str, size: int | None = None) -> Iterator[str]:
    """The text in pieces of about size characters that have as many tokens as the whole; a run without white space stays in one.

    No token goes on from a sign into white space, so the text can be cut before any run of that. A run that is longer than size is a piece
    up to its last character, which may belong to the word after it: that is the one token that the pattern makes of it.
    """
    size, at = size or STRETCH, 0
    while len(text) - at > size:
        end = at + size
        if not SPACE.match(text, end):
            found = SPACE.search(text, end)
            cut = found.start() if found else len(text)
        else:
            cut = at + len(text[at:end].rstrip(WHITE))
            if cut == at:
                found = OTHER.search(text, end)
                cut = found.start() - 1 if found else len(text)
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary file's bytes and the version that they and the code amount to; small (under a few MB), and so broadcast."""

    version: str
    vocabulary: bytes

    @classmethod
    def read(cls, path: str = TOKENIZER) -> Tokenizer:
        import tiktoken

        data = Path(path).read_bytes()
        said = hashlib.sha256(data)
        said.update("\0".join([PATTERN, tiktoken.__version__, NORMALISATION]).encode())
        return cls(said.hexdigest(), data)

    def encoding(self):
        """The encoder, made once in a worker process."""
        import tiktoken

        kept = sys.modules.setdefault("_siltstone_tokenizers", types.ModuleType("_siltstone_tokenizers")).__dict__
        if self.version not in kept:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.vocabulary.splitlines())}
            kept[self.version] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return kept[self.version]

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        """Tokens of each text's NFC form; strings of special tokens are ordinary text; a null text has none."""
        encode = self.encoding().encode_ordinary
        return [sum(len(encode(x)) for x in stretches(nfc(t))) if t else 0 for t in texts]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, digest)."""
    for batch in batches:
        found = [None if x is None else digest(nfc(x)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "digest"])


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, text) -> (key, digest, n_tokens); of equal rows of a batch one is encoded."""
        for batch in batches:
            once: dict[tuple[int, bytes], str] = {}
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = nfc(text)
                once.setdefault((key, digest(text)), text)
            keys, digests = zip(*once) if once else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(digests, pa.binary()), pa.array(shared.value.counts(once.values()), pa.int64())], names=["key", "digest", "n_tokens"])

    return run


def count_tokens(documents: DataFrame, cache: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) for each row of documents, through the cache: a folder of Parquet files that is made if missing.

    A null text has a null count, an empty text 0 tokens; a very long text is encoded whole. Special tokens' strings count as
    ordinary text. Repeated rows and a null doc_id each have a row; equal texts (in NFC) have one count, whichever doc_id they have,
    and the least doc_id's row is the one that is encoded. An empty table gives no rows and appends nothing. Only doc_id (of a whole-number type, else a
    TypeError) and text are read, so other columns may have any name. Appending is safe beside other writers: a digest that two
    of them add has one and the same count, of which the join takes one.
    """
    spark = documents.sparkSession
    said = Tokenizer.read(tokenizer)
    shared = spark.sparkContext.broadcast(said)
    scratch = Scratch(spark, "tokens")
    own = doc_id(documents)
    digested = scratch.write(documents.select(own.alias("doc_id"), "text").mapInArrow(_digests, "doc_id long, digest binary"), "digests")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    stored = (spark.read.schema(CACHE_SCHEMA).parquet(cache) if there else spark.createDataFrame([], CACHE_SCHEMA)).where(F.col("tokenizer") == said.version).select("digest", "n_tokens")

    key = F.coalesce(own, F.lit(NO_ID))
    least = digested.where("digest is not null").groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("key"))
    missing = scratch.write(least.join(stored, "digest", "left_anti") if there else least, "missing")
    if n := missing.count():
        keys = missing.select("key").distinct()
        rows = documents.where("text is not null").select(key.alias("key"), "text").join(sized(keys, n), "key", "left_semi")
        counted = rows.mapInArrow(_encode(shared), "key long, digest binary, n_tokens long")
        # A doc_id of several rows brings texts that were not missing, or are another row's to count.
        once = counted.join(missing, ["digest", "key"], "left_semi").dropDuplicates(["digest"])
        once.select(F.lit(said.version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").option("compression", "zstd").parquet(cache)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == said.version) if there or n else spark.createDataFrame([], CACHE_SCHEMA)
    return digested.join(counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "digest", "left").select("doc_id", "n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table through a cache in the shared folder to which an earlier call has added the English documents."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cache = f"{Scratch(spark, 'token-cache').root}/counts"
    count_tokens(documents.where("lang = 'en'"), cache)
    return count_tokens(documents, cache)
