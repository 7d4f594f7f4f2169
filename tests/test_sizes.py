"""Queries against their SQL on tables that the small fixtures do not show: large keys, repeated values, odd ranges."""

import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from tests.support import same_rows

from folio.operators import graph, guards, lineage, protocol
from folio.plans import registry


def against_sql(spark, folder, name, **tables):
    """The query's rows on ``tables``, each (rows, schema), are those of its SQL."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    same_rows(registry.QUERIES[name](spark, str(folder)), con, registry.ORACLE[name])


def test_rewritten_paths_of_shared_urls(spark, tmp_path):
    rows = [(1, "u"), (2, "v"), (3, "u"), (6, "u"), (9, None), (10, None), (12, "w"), (12, "w"), (None, "u")]
    against_sql(spark, tmp_path, "rewritten_paths", pages=(rows, "page_id long, url string"))


def test_identifiers_of_long_keys(spark, tmp_path):
    rows = [(1, "A B"), (999999, "A"), (1000001, "A"), (12345678, "x/y"), (None, "A"), (7, None)]
    against_sql(spark, tmp_path, "identifiers", part=(rows, "p_partkey long, p_type string"))


def test_range_lookup_equals_all_pairs(spark):
    rng = random.Random(4)
    points = [(i, rng.choice("abcd"), rng.choice([None, rng.randint(-40, 90)])) for i in range(300)] + [(300, None, 5), (301, "a", 2**40)]
    ranges = [(rng.choice("abc"), s, s + rng.choice([-2, 0, 1, 7, 8, 31, 120]), i) for i in range(60) for s in [rng.randint(-50, 80)]]
    ranges += [(None, 0, 9, 60), ("a", None, 9, 61), ("a", -(2**62), 2**62, 62)]  # a range of nearly all numbers
    p, r = spark.createDataFrame(points, "i long, g string, p long"), spark.createDataFrame(ranges, "g string, s long, e long, d long")
    holds = lambda g, x: [d for h, s, e, d in ranges if None not in (g, x, h, s, e) and g == h and s <= x <= e]
    inner = [(i, d) for i, g, x in points for d in holds(g, x)]
    left = [(i, d) for i, g, x in points for d in holds(g, x) or [None]]
    for how, want in (("inner", inner), ("left", left)):
        got = guards.range_lookup(p, r, "g", "p", "s", "e", how)
        assert got.columns == ["i", "g", "p", "s", "e", "d"]
        assert sorted(map(str, ((x.i, x.d) for x in got.collect()))) == sorted(map(str, want))


def test_range_lookup_reads_no_whole_bundle(spark):
    """One bundle of many ranges: an equi join on the bundle alone would meet 400 million pairs."""
    p = spark.range(20000).select(F.lit("a").alias("g"), (F.col("id") * 7 % 100000).alias("p"))
    r = spark.range(20000).select(F.lit("a").alias("g"), (F.col("id") * 5).alias("s"), (F.col("id") * 5 + 4).alias("e"))
    found = guards.range_lookup(p, r, "g", "p", "s", "e")
    assert found.count() == 20000
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "_s" in x]
    assert joins and all("_c" in x for x in joins)


def test_mapped_docs_of_all_lines(spark, tmp_path):
    """Lines of any quantity count; pages in several documents or in none, null pages and bundles."""
    part = [(1, "a", 20), (2, "a", 20), (3, "a", None), (4, "a", 0), (5, "a", -30), (6, "a", 40), (7, "a", 20), (8, "b", 30), (9, None, 200), (10, "c", None)]
    kept = [(q, n % 37, [1, 2, 6, 7, 8, 9, 10, 11, None][n % 9], n % 7 + 1) for n, q in enumerate([1.0, 44.0, 45.0, 50.0, None] * 60)]
    lines = [(o, p, n, q) for q, o, p, n in kept] + [(1, 1, 2, 1.0), (1, 1, 2, 50.0), (2, 6, None, 3.0), (None, 6, 1, 3.0), (500, 8, 1, 44.0), (-7, 8, 1, None)]
    against_sql(spark, tmp_path, "mapped_docs", part=(part, "p_partkey long, p_brand string, p_size int"), lineitem=(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double"))
    rows = registry.QUERIES["mapped_docs"](spark, str(tmp_path))
    assert [tuple(r)[2:] for r in rows.where("bundle = 'b' and item in (500, -7)").orderBy("item").collect()] == [(1, 1, 0), (0, 1, 1)]  # pages 6 and 33 of 30


def test_count_mapped_equals_all_pairs(spark):
    rng = random.Random(5)
    cited = [(rng.choice(["a", "b", "c", None]), rng.choice([1, 2, 3, None]), rng.choice([None, rng.randint(-9, 40)])) for _ in range(80)] * 2
    ranges = [(rng.choice("ab"), s, s + rng.choice([-1, 0, 3, 9]), rng.choice([None, 1, 2, 3, 4])) for _ in range(25) for s in [rng.randint(-9, 40)]] + [("a", 0, 9, None), ("a", 0, 9, 1), ("a", 2, 3, 1)]
    want = []
    for g, i in {(g, i) for g, i, _ in cited}:
        pages = {p for h, j, p in cited if (h, j) == (g, i) and p is not None}
        docs = {p: [d for h, s, e, d in ranges if h == g and s <= p <= e] or [None] for p in pages}
        want.append((g, i, len({d for x in docs.values() for d in x} - {None}), len(pages), sum(None in x for x in docs.values())))
    got = lineage.count_mapped(spark.createDataFrame(cited, "g string, i long, p int"), spark.createDataFrame(ranges, "g string, s long, e long, d long"), "g", "i", "p", "s", "e", "d")
    assert sorted(map(str, map(tuple, got.select("g", "i", "docs", "pages", "unmapped").collect()))) == sorted(map(str, want))


def test_question_pairs_equal_all_pairs(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 60))] for _ in range(25)]
    texts = [" ".join(rng.choice(["zz", x]) if rng.random() < 0.08 else x for x in rng.choice(base)) for _ in range(250)] + [None, "", " - ", "Aa bb", "bb, AA!"]
    sets = [set(re.sub(r"\W+", " ", (x or "").lower()).strip().split(" ")) for x in texts]
    first = [sets.index(s) for s in sets]
    want = {(first[i], i, len(s), len(s)) for i, s in enumerate(sets) if first[i] != i}
    reps = sorted(set(first))
    want |= {(i, j, len(sets[i] & sets[j]), len(sets[i] | sets[j])) for i, j in itertools.combinations(reps, 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    got = graph.near_duplicate_questions(spark.createDataFrame(list(enumerate(texts)), "k long, q string"), "k", "q")
    assert len(want) > 60 and sorted(map(tuple, got.collect())) == sorted(want)


def test_question_pairs_shuffle_no_token_texts(spark):
    """What is dealt out by token is a number, and whole sets are fetched packed: texts of tokens fill the disk."""
    rows = spark.createDataFrame([(1, "a b"), (2, "a c")], "k long, q string")
    plan = graph.near_duplicate_questions(rows, "k", "q")._jdf.queryExecution().optimizedPlan()
    kinds = {(x.name(), x.dataType().simpleString()) for n in [plan.collectLeaves()] for i in range(n.size()) for o in [n.apply(i).output()] for x in [o.apply(j) for j in range(o.size())]}
    assert {("packed", "binary"), ("prefix", "array<bigint>")} <= kinds
    assert not any(kind == "array<string>" for _, kind in kinds)


@pytest.mark.parametrize("keys,pages,least", [(400, 60, 10), (400, 3, 1), (12, 60, 0), (4, 5, 0), (90, 10**6, 10)])
def test_spread_subsets_equal_all_pairs(spark, keys, pages, least):
    rng = random.Random(keys + pages)
    rows = [(g, rng.randrange(keys), rng.randrange(pages)) for g in "abc" for _ in range(150)] + [("d", 1, 5), ("d", 2, 90), (None, 3, 4), ("a", None, 1), ("a", 2, None)]
    want = []
    for g in "abcd":
        mine = [(k, p) for h, k, p in rows if h == g and None not in (k, p)]
        every = sorted((-abs(p - q), k, m) for (k, p), (m, q) in itertools.product(mine, mine) if k < m and abs(p - q) >= least)
        want += [(g, k, m, -s, i + 1) for i, (s, k, m) in enumerate(every[:5])]
    got = protocol.spread_subsets(spark.createDataFrame(rows, "g string, k long, p int"), "g", "k", "p", least, 5)
    assert sorted(map(tuple, got.select("g", "a", "b", "span", "rank").collect())) == sorted(want)


def test_spread_subsets_of_a_large_group(spark):
    """All pairs of this group would be two billion."""
    rows = spark.range(60000).select(F.lit("g").alias("g"), F.col("id").alias("k"), (F.col("id") % 50).cast("int").alias("p"))
    got = protocol.spread_subsets(rows, "g", "k", "p", 10, 5).collect()
    assert [(r.a, r.b, r.span) for r in got] == [(0, 49, 49), (0, 99, 49), (0, 149, 49), (0, 199, 49), (0, 249, 49)]
