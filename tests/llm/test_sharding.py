import zlib
from collections import Counter

from tests.support import SMALL

from folio.llm.registry import QUERIES
from folio.llm.sharding import shard_records


def check(rows, n):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard == r.shard or r.grown_shard == n
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_contract(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op1_sharding"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    check(rows, 8)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
    assert max(Counter(r.shard for r in rows).values()) < len(rows) / 4


def test_key_and_count_decide_the_shard(spark):
    df = spark.range(500).selectExpr("id as doc_id", "cast(id as string) as text")
    a = {r.record.doc_id: (r.shard, r.grown_shard) for r in shard_records(df, "doc_id", "text", 4).collect()}
    b = {r.record.doc_id: r.shard for r in shard_records(df.where("doc_id % 2 = 0").repartition(3), "doc_id", "text", 5).collect()}
    assert all(a[k][1] == b[k] for k in b)


def test_small_buckets_and_order(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "repeat('x', 100) as text").coalesce(1)
    out = shard_records(df, "doc_id", "text", 2, bucket_bytes=5000)
    rows = out.collect()
    check(rows, 2)
    first = [r.record.doc_id for r in sorted((r for r in rows if r.shard == 0), key=lambda r: r.slot)]
    assert first != sorted(first)
    assert sorted((r.record.doc_id, r.shard, r.slot) for r in shard_records(df, "doc_id", "text", 2, bucket_bytes=5000).collect()) == sorted((r.record.doc_id, r.shard, r.slot) for r in rows)


def test_hot_key_spreads_over_buckets(spark):
    df = spark.range(3000).selectExpr("1L as doc_id", "repeat('x', 100) as text")
    rows = shard_records(df, "doc_id", "text", 2, bucket_bytes=10_000).collect()
    assert len({r.shard for r in rows}) == 1
    check(rows, 2)


def test_odd_rows(odd, none):
    rows = shard_records(odd, "doc_id", "text").collect()
    assert len(rows) == odd.count()
    check(rows, 8)
    assert Counter(r.record.doc_id for r in rows)[None] == 2
    assert shard_records(none, "doc_id", "text").count() == 0


def test_buckets_are_bounded(spark, monkeypatch):
    from folio.llm import sharding

    monkeypatch.setattr(sharding, "MOST_BUCKETS", 4)
    df = spark.range(3000).selectExpr("id as doc_id", "repeat('x', 100) as text")
    rows = shard_records(df, "doc_id", "text", 2, bucket_bytes=1000).collect()
    check(rows, 2)
    assert len(rows) == 3000
