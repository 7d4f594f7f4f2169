import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.support import SMALL

from folio.llm import jaccard
from folio.llm.registry import QUERIES

from .test_words import shingles


def brute(rows):
    sets = {d: set(shingles(x)) for d, x in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for d, s in sets.items():
        common = Counter(e for t in s for e in index.get(t, ()))
        for e, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
        for t in s:
            index.setdefault(t, []).append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op9_jaccard_join"](spark, SMALL).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("edits", [2, 6, 12])
def test_families_of_near_copies(spark, edits):
    """Chains through a family: many pairs lie near the threshold and pivots don't decide all of them."""
    rng = random.Random(edits)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for _ in range(6):
        base = rng.choices(vocabulary, k=rng.randint(60, 200))
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, " ".join(["the same opening passage of ten words in every text"] + rng.choices(vocabulary, k=40))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, "doc_id", "text").collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("part", [2048, 64])
def test_a_large_group_is_compared_through_its_pivot(spark, monkeypatch, part):
    """Thousands of edits of one text, most of them not linked with one another: pairs grow with the group, not its square."""
    monkeypatch.setattr(jaccard, "LIST_PART", part)
    compare = jaccard._open_pairs(80, 100)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(2500):
        copy = list(base)
        for j in range(rng.choice([0, 1, 2, 2, 3, 3, 4, 5, 6])):
            copy[rng.randrange(len(copy))] = f"e{i}x{j}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    count = spark.sparkContext.accumulator(0)

    def counted(num, den):
        def run(table):
            out = compare(table)
            count.add(len(out))
            return out

        return run

    monkeypatch.setattr(jaccard, "_open_pairs", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, "doc_id", "text").collect()}
    assert got == brute(rows)
    assert count.value < 40 * len(rows)


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (3, 50, 700):
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 62, n // 3, dtype=np.uint64)]))
        x, y = (np.frombuffer(jaccard.parity_bitmap(s), np.uint8) for s in (a, b))
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_odd_rows(odd, none):
    rows = jaccard.jaccard_components(odd, "doc_id", "text").collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by[4] == by[5] == by[6] == {(4, 4)}
    assert by[0] == {(0, 0)} and by[2] == {(0, 2)} and by[8] == {(1, 8)}
    assert by[None] == {(0, None), (1, None)}
    assert jaccard.jaccard_components(none, "doc_id", "text").count() == 0


def test_every_place_of_the_filter_is_flagged(spark):
    place = F.pmod(F.xxhash64("doc_id"), F.lit(jaccard.WANTED_BITS)).alias("p")
    ids = spark.range(20_000_000).withColumnRenamed("id", "doc_id").where(place.isin(0, 1, 32767, 32768, 32769, jaccard.WANTED_BITS - 1)).cache()
    want = {r.p for r in ids.select(place).collect()}
    assert 0 in want
    assert set(np.flatnonzero(np.unpackbits(jaccard._wanted_bitmap(ids), bitorder="little")).tolist()) == want
