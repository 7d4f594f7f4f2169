"""Two-pass external shuffle of records into shards [native].

Pass 1 scatters records uniformly into memory-sized buckets by seeded hashes (one exchange). Pass 2 loads one bucket
at a time, permutes it with ``shuffle`` (Spark's Fisher-Yates over an array) and writes it. Slots are bucket offsets,
which are prefix sums over the small bucket table, plus the position inside the bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import scratch

#: Bytes of text that one bucket holds on average; a task keeps one bucket in memory.
BUCKET_BYTES = 16 << 20
#: Most buckets: the bucket table, of 16 bytes a row, is broadcast. Beyond so many, buckets grow with the input (100 TB
#: make buckets of 95 MB).
MOST_BUCKETS = 1 << 20


def rendezvous(key: Column, n_shards: int, seed: int) -> Column:
    """Shard with the highest seeded weight for the key.

    Only key and shard count decide. Weights of old shards do not change when one is added, so a new shard takes rows
    only into itself.
    """
    weights = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("w"), F.lit(i).alias("i")) for i in range(n_shards)]
    return reduce(lambda a, b: F.when(b["w"] > a["w"], b).otherwise(a), weights)["i"] if n_shards > 1 else F.lit(0)


def byte_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def shard_records(
    df: DataFrame, key: str, text: str, n_shards: int = 8, seed: int = 17, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Write ``df`` as shuffled shards; returns ``record`` (all input columns), ``shard``, ``grown_shard``, ``slot``.

    The law is ``key``: ``key`` and the shard count decide the shard. ``slot`` numbers each shard's rows from 0 without
    gaps. A null key is a key of its own; a null text counts no bytes; equal rows all stay and spread over the buckets
    of their shard, because the scatter hash also takes the row's place in its input. Columns of any name may be
    present: they stay inside ``record``. An empty table gives an empty result.

    A hot key's rows share a shard, as the law demands, but not a bucket. The order is reproducible for the same input
    files and settings. The written shards stay in the shared folder and outlive executors.
    """
    n_bytes = df.agg(F.sum(byte_length(F.col(text)) + 1)).first()[0] or 0
    per_shard = max(1, -(-n_bytes // (max(bucket_bytes, -(-n_bytes // MOST_BUCKETS)) * n_shards)))
    scattered = df.select(
        F.struct(*[df[c] for c in df.columns]).alias("record"),
        rendezvous(df[key], n_shards, seed).alias("shard"),
        rendezvous(df[key], n_shards + 1, seed).alias("grown_shard"),
        F.xxhash64(F.lit(seed), F.lit("scatter"), df[key], F.monotonically_increasing_id()).alias("h"),
    ).withColumn("bucket", F.pmod("h", F.lit(per_shard)).cast("int"))
    n_buckets = per_shard * n_shards
    bucketed = (
        scattered.repartition(max(n_buckets, df.sparkSession.sparkContext.defaultParallelism), "shard", "bucket")
        .groupBy("shard", "bucket")
        .agg(F.sort_array(F.collect_list(F.struct("h", "grown_shard", "record"))).alias("rows"))
    )
    written = scratch.materialize(
        bucketed.select("shard", "bucket", F.posexplode(F.shuffle("rows", seed)).alias("place", "row")).select(
            "shard", "bucket", "place", "row.grown_shard", "row.record"
        ),
        "shards",
    )
    sizes = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return written.join(F.broadcast(bases), ["shard", "bucket"]).select(
        "record", "shard", "grown_shard", (F.col("base") + F.col("place")).alias("slot")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shard_records(docs, "doc_id", "text")
    return out.select(
        F.col("record.doc_id").alias("doc_id"),
        (byte_length(F.col("record.text")) + 1).alias("size"),
        F.crc32(F.coalesce(F.col("record.text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )
