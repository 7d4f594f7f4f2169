"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Target text is a bounded sample of rows labelled good, raw text is every document. Both give counts of hashed unigrams
and bigrams of words and punctuation runs; the log ratio of the two models, summed over a document's n-grams, is its log
importance weight. Adding Gumbel noise and keeping the k largest samples without replacement in proportion to weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .toxicity import _chunks
from .words import IS_SEPARATOR, U, byte_values, mix, prefix_sums

#: Buckets of hashed n-grams, and labelled rows that the target model is fitted on, at most.
BUCKETS, TARGET_ROWS = 10_000, 20_000
#: Bins of one step of the search for the k-th largest key, and rows that may be read to end it.
BINS, LAST_ROWS = 4096, 10_000
#: Bigram of any word followed by itself: what they have in common tells more than which word it is.
REPEAT = U(0x5EED)

VALUES = byte_values(np.arange(256))

KINDS = np.full(256, 2, np.uint8)  # 0 separates, 1 word, 2 punctuation
KINDS[IS_SEPARATOR] = 0
KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def ngram_buckets(texts: pa.Array):
    """(documents, bucket of each n-gram, its document) of runs of texts; case counts, since shouting is a trait."""
    for buf, bounds in _chunks(texts):
        docs = len(bounds) - 1
        kinds = KINDS[buf]
        new = np.ones(len(buf), bool)
        new[1:] = kinds[1:] != kinds[:-1]
        at = bounds[:-1]
        new[at[at < len(buf)]] = True
        runs = np.flatnonzero(new)
        ends = np.append(runs[1:], len(buf))
        real = kinds[runs] > 0 if len(runs) else np.zeros(0, bool)
        starts, ends = runs[real], ends[real]
        sums = prefix_sums(buf, starts, VALUES)
        one = mix(sums[ends] - sums[starts])
        doc = np.searchsorted(bounds, starts, "right") - 1
        same = doc[1:] == doc[:-1]
        two = np.where(one[:-1] == one[1:], REPEAT, mix(one[:-1] * U(3) + one[1:]))[same]
        grams = np.concatenate([one, two]) % U(BUCKETS)
        yield docs, grams.astype(np.int64), np.concatenate([doc, doc[:-1][same]])


def log_ratio(docs: DataFrame, text: str, target: Column) -> np.ndarray:
    """Log ratio of the target's to the raw model for each bucket, from all rows of ``docs``."""

    def count(batches):
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            chosen, at = batch.column(1).to_numpy(zero_copy_only=False).astype(bool), 0
            for n, grams, doc in ngram_buckets(batch.column(0)):
                raw += np.bincount(grams, minlength=BUCKETS)
                good += np.bincount(grams[chosen[at : at + n][doc]], minlength=BUCKETS)
                at += n
        full = np.flatnonzero(raw)
        yield pa.record_batch({"bucket": pa.array(full, pa.int64()), "raw": pa.array(raw[full], pa.int64()), "good": pa.array(good[full], pa.int64())})

    rows = docs.select(F.col(text), target.alias("chosen")).mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw"), F.sum("good")).collect()  # BUCKETS rows at most
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, g in rows:
        raw[b], good[b] = r, g
    if not good.sum():
        return np.zeros(BUCKETS)
    return np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def weight_column(spark: SparkSession, ratio: np.ndarray, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(ratio)  # BUCKETS numbers

    @F.arrow_udf("double")
    def weight(texts: pa.Array) -> pa.Array:
        out = [np.bincount(doc, shared.value[grams], minlength=n)[:n] for n, grams, doc in ngram_buckets(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return weight.asNondeterministic()(text)


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The ``k``-th largest non-null value, exactly: bins are counted and the one that holds it is cut again."""
    rows = keys.select(F.col(column).alias("x")).where("x is not null")
    lo, hi, n = rows.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if k <= 0 or not n:
        return None
    k = min(k, n)
    while n > LAST_ROWS and lo < hi:
        width = (hi - lo) / BINS
        if lo + width <= lo:
            break
        place = F.least(F.floor((F.col("x") - lo) / width), F.lit(BINS - 1))
        counts = sorted(rows.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect(), reverse=True)
        for _, n, lo, hi in counts:
            if k <= n:
                break
            k -= n
        rows = rows.where(F.col("x").between(lo, hi))
    if lo == hi or n > LAST_ROWS:
        return rows.agg(F.max("x")).first()[0] if lo == hi else rows.orderBy(F.desc("x")).limit(k).agg(F.min("x")).first()[0]
    return sorted((r.x for r in rows.collect()), reverse=True)[k - 1]


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", share: float | None = None, seed: int = 11) -> DataFrame:
    """``key``, ``log_weight``, ``sample_key`` and ``kept`` of every row; about ``share`` of the rows are kept.

    ``share`` defaults to the share of good rows among labelled ones. k is ``share`` of all rows, rounded; rows tied
    with the k-th key are all kept (repeated rows tie). Null and empty texts have weight 0. Null labels are ignored;
    without good labels all weights are 0. The noise depends on seed, key and text only. An empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    if share is None:
        share = known.agg(F.avg("y")).first()[0]
        share = 1.0 if share is None else float(share)
    good = known.where("y = 1").select("id").distinct().orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(TARGET_ROWS).withColumn("chosen", F.lit(True))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    ratio = log_ratio(rows.join(F.broadcast(good), "id", "left"), "text", F.coalesce("chosen", F.lit(False)))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "text"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    scored = scratch.materialize(rows.select("id", (-F.log(-F.log(uniform))).alias("noise"), weight_column(spark, ratio, F.coalesce("text", F.lit(""))).alias("log_weight")), "weights")
    scored = scored.withColumn("sample_key", F.col("log_weight") + F.col("noise"))
    least = kth_largest(scored, "sample_key", round(share * scored.count()))
    kept = F.col("sample_key") >= F.lit(least) if least is not None else F.lit(False)
    return scored.select(F.col("id").alias(key), "log_weight", "sample_key", kept.alias("kept"))


def op5_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
