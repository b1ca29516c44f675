"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's token budget is its share of the whole budget. As many complete epochs of the source as fit come
first; what is left of the budget is filled from a weighted sample without replacement: document i has
the key -ln(u_i) / w_i with u_i from a digest of its doc_id and w_i its quality weight, keys are sorted within the source and tokens
prefix-summed until the rest of the budget is used. Tokens are those of the tokenizer of token_counts, and the weight comes from
the document's quality by the line field of quality_crf; both are measured in one pass over the texts.

The prefix sums need no task that holds a whole source: keys fall into ordered buckets of about BUCKET_ROWS
documents, buckets are summed and prefix-summed, and each bucket is then sorted and summed on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm import quality_crf
from siltstone.llm._scratch import Scratch, doc_id, sized, unused
from siltstone.llm.token_counts import TOKENIZER, Tokenizer

#: target share of a source ~ (its tokens) ** TEMPERATURE; below 1, small sources gain.
TEMPERATURE, SEED, BUCKET_ROWS = 0.7, "mix-1", 20_000
#: The weight of a document of quality 0; one of quality 1 has the weight 1.
LEAST_WEIGHT = 0.05


def weight_of(quality: np.ndarray) -> np.ndarray:
    return LEAST_WEIGHT + (1 - LEAST_WEIGHT) * quality


def _measured(tokenizer, model):
    """(doc_id, source, text, n_tokens, weight) -> (doc_id, source, n_tokens, weight), the last two measured where there is a broadcast for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, source, texts, tokens, weight = batch.columns
            if tokenizer:
                tokens = pa.array(tokenizer.value.counts(texts.to_pylist()), pa.int64())
            if model and model.value is not None:
                weight = pa.array(weight_of(np.concatenate([found for _, _, found in quality_crf.qualities(texts, model.value)] or [np.zeros(0)])))
            yield pa.RecordBatch.from_arrays([ids, source, tokens, weight], names=["doc_id", "source", "n_tokens", "weight"])

    return run


def measured(documents: DataFrame, labels: DataFrame | None, tokens: str | None, weight: str | None, tokenizer: str, examples: DataFrame | None) -> DataFrame:
    """(doc_id, source, n_tokens, weight) of each row with a doc_id: from the named columns, else from the text, in one pass."""
    context = documents.sparkSession.sparkContext
    n = F.greatest(F.coalesce(F.col(f"`{tokens}`").cast("long"), F.lit(0)), F.lit(0)).cast("long") if tokens else F.lit(0).cast("long")
    w = F.greatest(F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(0.0)), F.lit(1e-9)) if weight else F.lit(1.0)
    fitted = not weight and labels is not None
    known = [doc_id(documents).alias("doc_id"), F.col("source").cast("string").alias("source"), *([F.col("text")] if not tokens or fitted else []), n.alias("n_tokens"), w.alias("weight")]
    rows = documents.where("doc_id is not null").select(*known)
    if tokens and not fitted:
        return rows
    read = None if tokens else context.broadcast(Tokenizer.read(tokenizer))
    model = context.broadcast(quality_crf.fit(documents if examples is None else examples, labels)) if fitted else None
    return rows.mapInArrow(_measured(read, model), "doc_id long, source string, n_tokens long, weight double")


def exponential_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(doc_id.cast("string"), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def copies(
    documents: DataFrame,
    labels: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    budget: int | None = None,
    temperature: float = TEMPERATURE,
    seed: str = SEED,
    tokens: str | None = None,
    weight: str | None = None,
    tokenizer: str = TOKENIZER,
    examples: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, source, n_tokens, copies) for each document that the mix takes at least once.

    weights: source -> share of the budget (they are normalised; a source not named gets none); without
    them, shares follow the sources' tokens to the power of temperature. budget: tokens in all; without it, those of all documents.
    A document is taken whole once the tokens before it are below the rest of the budget, so the last one may
    pass it, however long it is. tokens, weight: columns of given lengths and quality weights (null: none, and the least weight); without tokens, texts are
    encoded whole by the tokenizer, and without weight the quality comes from the field fitted on labels(doc_id, quality) of examples (by default the documents), 1 everywhere if these are not of both kinds.
    A null source is a source of its own. Rows with a null doc_id are left out; null or empty texts
    have no tokens and are taken as often as complete epochs are, or in the sample while budget is left.
    Rows that repeat a doc_id in a source count as one document: the one of most tokens, then greatest weight. Ties
    in the key go by doc_id. No rows, or no budget, give no rows. Other columns may have any name; a doc_id that is no whole number is a TypeError.
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    once = measured(documents, labels, tokens, weight, tokenizer, examples).groupBy("doc_id", "source").agg(F.max(F.struct("n_tokens", "weight")).alias("m")).select("doc_id", "source", "m.n_tokens", "m.weight")
    rows = scratch.write(once.withColumn("key", exponential_key(F.col("doc_id"), F.col("weight"), seed)).drop("weight"), "rows")

    per = rows.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.count("*").alias("docs"))
    if weights is not None:
        named = documents.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "source string, share double")
        per = per.join(F.broadcast(named), per["source"].eqNullSafe(named["source"]), "left").select(per["source"], "have", "docs", F.coalesce("share", F.lit(0.0)).alias("share"))
    else:
        per = per.withColumn("share", F.pow(F.col("have").cast("double"), F.lit(temperature)))
    whole = per.agg(F.sum("share").alias("all_shares"), F.sum("have").alias("all_have"))
    wanted = F.col("all_have") if budget is None else F.lit(int(budget))
    target = F.coalesce(F.floor(F.lit(1.0) * wanted * F.col("share") / F.nullif("all_shares", F.lit(0.0))), F.lit(0)).cast("long")
    planned = per.crossJoin(F.broadcast(whole)).withColumn("target", target)
    epochs = F.when(F.col("have") > 0, F.floor(F.col("target") / F.col("have"))).otherwise(F.lit(0)).cast("long")
    plan = scratch.write(planned.select("source", epochs.alias("epochs"), (F.col("target") - epochs * F.col("have")).alias("rest"), F.ceil(F.col("docs") / BUCKET_ROWS).alias("buckets")), "plan")

    side = sized(plan, plan.count())
    joined = rows.join(side.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # 1 - exp(-key) grows with the key and spreads it over [0, 1).
    keyed = joined.withColumn("bucket", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * F.col("buckets")).cast("long"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.write(sums.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset")), "offsets")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    spent = F.col("offset") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    taken = F.col("epochs") + F.when(spent < F.col("rest"), 1).otherwise(0)
    return placed.withColumn("copies", taken.cast("long")).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def mix_sources(documents: DataFrame, labels: DataFrame | None = None, **parameters) -> DataFrame:
    """documents as the mix takes them: each row as often as copies() says, all columns as they are, whatever they are called.

    Rows with a null doc_id are left out. Rows that repeat a doc_id in a source are each taken.
    """
    own, source, times, copy = unused(documents.columns, "mixed_doc", "mixed_source", "mixed_copies", "mixed_copy")
    plan = copies(documents, labels, **parameters).select(F.col("doc_id").alias(own), F.col("source").alias(source), F.col("copies").alias(times))
    narrow = Scratch(documents.sparkSession, "mixing-copies").write(plan, "copies")
    joined = documents.join(narrow, (doc_id(documents) == F.col(own)) & F.col("source").cast("string").eqNullSafe(F.col(source)))
    repeated = joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int"))))
    return repeated.select(*(F.col(f"`{c}`") for c in documents.columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
