"""Hand cases of lineage and curation operators."""

import itertools
import random
import zlib
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import curation, graph, lineage, ratios
from folio.plans import registry


def test_dangling_source_fails(spark):
    derived = spark.createDataFrame([(1, ["a", "x"])], "k long, ids array<string>")
    sources = spark.createDataFrame([("a", [3, 1])], "s string, pages array<int>")
    with pytest.raises(Exception, match="unknown"):
        lineage.restore_pages(derived, sources, "k", "ids", "s", "pages").collect()
    ok = lineage.restore_pages(derived.withColumn("ids", F.array(F.lit("a"))), sources, "k", "ids", "s", "pages").first()
    assert ok.pages == [1, 3]


def test_page_must_lie_in_one_document(spark):
    ranges = spark.createDataFrame([("b", 1, 4, "x"), ("b", 5, 9, "y")], "bundle string, s int, e int, d string")
    items = spark.createDataFrame([(1, "b", [2, 6, 7])], "k long, bundle string, p array<int>")
    assert lineage.documents_of_pages(items, ranges, "k", "bundle", "p", "s", "e", "d").first().documents == ["x", "y"]
    with pytest.raises(Exception, match="documents"):
        lineage.documents_of_pages(items.withColumn("p", F.array(F.lit(10))), ranges, "k", "bundle", "p", "s", "e", "d").collect()


def test_span_equals_all_pairs(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.randint(1, 30)) for g in range(40) for i in range(rng.randint(1, 4)) for _ in range(rng.randint(1, 3))]
    want = {}
    for (g, i, p), (h, j, q) in itertools.combinations(rows, 2):
        if g == h and i != j:
            want[g] = max(want.get(g, 0), abs(p - q))
    df = spark.createDataFrame(rows, "g long, i long, p int")
    got = {r.g: r.span for r in curation.groups_with_span(df, "g", "i", "p", 8).collect()}
    assert got == {g: s for g, s in want.items() if s >= 8}


def test_balanced_pick_alternates(spark):
    rows = [(1, "a", 1), (2, "a", 1), (3, "a", 2), (4, "b", 3), (5, "b", 3), (6, "b", 4)]
    df = spark.createDataFrame(rows, "k long, kind string, bundle long")
    assert curation.balanced_pick(df, "k", "kind", "bundle", 4, 1) == [1, 4, 3, 6]


def test_long_documents_are_compared(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    docs = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(reversed([f"x{w}" for w in words]))), (4, "short one")]
    spark.createDataFrame([(i, x, len(x)) for i, x in docs], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {name: registry.QUERIES[name](spark, str(tmp_path)).collect() for name in ("near_dup_ratio", "keep_first_questions", "accept_distinct")}
    assert [(r.a, r.b) for r in got["near_dup_ratio"]] == [(2, 1)]
    assert sorted(r.doc_id for r in got["keep_first_questions"]) == [1, 3, 4]
    assert sorted(r.doc_id for r in got["accept_distinct"]) == [1, 3, 4]


@pytest.mark.parametrize("per_bundle", [1, 3])
def test_balanced_pick_passes_a_hot_bundle(spark, per_bundle):
    rng = random.Random(per_bundle)
    rows = [(i, "a", 1) for i in range(300)] + [(i, rng.choice("ab"), rng.randrange(2, 90)) for i in range(300, 700)]
    queues, counts, used, want = {k: [r for r in rows if r[1] == k] for k in "ab"}, {"a": 0, "b": 0}, {}, []
    while len(want) < 60 and any(queues.values()):
        k = min((k for k in "ab" if queues[k]), key=lambda x: (counts[x], x))
        key, _, bundle = queues[k].pop(0)
        if used.get(bundle, 0) < per_bundle:
            want.append(key)
            used[bundle] = used.get(bundle, 0) + 1
            counts[k] += 1
    df = spark.createDataFrame(rows, "k long, kind string, bundle long")
    assert curation.balanced_pick(df, "k", "kind", "bundle", 60, per_bundle) == want
    assert counts == {"a": 30, "b": 30}


def test_balanced_pick_reads_all_orders(spark, tmp_path):
    rows = [(k, "ab"[k % 2], k) for k in (3998, 3999, 4000, 4001)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.QUERIES["balanced_pick"](spark, str(tmp_path)).collect()
    assert sorted(r.o_orderkey for r in got) == [3998, 3999, 4000, 4001]


def test_attempts(spark):
    sha = F.sha2(F.lit("r"), 256)
    log = lambda *xs: F.array(*[F.struct(F.lit(n).alias("number"), F.lit("r").alias("raw"), sha.alias("sha256"), F.lit(ok).alias("legal")) for n, ok in xs])
    codes = lambda a: lineage.audit_attempts(spark.range(1).select(a.alias("a")), "a").first().codes
    assert codes(log((1, False), (2, True))) == []
    assert codes(log((1, True), (3, True))) == ["attempt_numbers", "attempt_after_legal"]


def test_aliases(spark):
    assets = spark.createDataFrame([("n1", ["o1", "o2"]), ("n2", ["o2"])], "id string, aliases array<string>")
    wanted = spark.createDataFrame([("n1",), ("o1",), ("o2",), ("z",)], "wanted string")
    got = {r.wanted: (r.asset, r.how) for r in curation.resolve_aliases(wanted, assets, "id", "aliases").collect()}
    assert got == {"n1": ("n1", "current"), "o1": ("n1", "alias"), "o2": (None, "ambiguous"), "z": (None, "missing")}


def _changed(rng, said, every):
    return "".join(rng.choice(["", "x", c + "q"]) if i % every == every - 1 else c for i, c in enumerate(said))


def test_ratio_pairs_lose_no_link_and_list_a_copy_once(spark):
    """Rows of one text are one class, but a pair of classes is judged in each order in which its rows stand."""
    rng = random.Random(6)
    parts = ["th", "er", "an", "ing", "qu", "é ", " ", "on ", "zo", "k", "st", "ea "]
    texts = [" ".join("".join(rng.choices(parts, k=k)).split()) for k in (3, 40, 80, 120, 200, 400) for _ in range(3)]
    texts += [" ".join(_changed(rng, x, every).split()) for x in texts for every in (8, 11, 17, 40) for _ in range(2)]
    rows = [*enumerate([*texts, *rng.choices(texts, k=30), *[texts[5]] * 60, " "]), (None, texts[0])]
    got = graph.ratio_pairs(spark.createDataFrame(rows, "id long, q string"), "id", "q", 0.88).collect()
    ids = {}
    for i, x in rows[:-2]:
        ids.setdefault(x, []).append(i)
    want = {(i, own[0]): 1.0 for own in ids.values() for i in own[1:]}
    for x, a in ids.items():
        for y, b in ids.items():
            if x != y and a[-1] > b[0] and (ratio := SequenceMatcher(None, x, y).ratio()) >= 0.88:
                want[a[0] if a[0] > b[0] else a[-1], b[0]] = ratio
    assert {(r.a, r.b): r.ratio for r in got} == pytest.approx(want)
    assert len(got) == len(want) > 300


def test_few_texts_are_compared_letter_by_letter():
    rng = random.Random(7)
    parts = ["th", "er", "an", "in", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of ", "be ", "is ", "ly ", " ", "ing ", "wh", "k", "pa", "vu", "q"]
    texts = ["".join(rng.choices(parts, [8] * 20 + [1] * 4, k=rng.randint(500, 600))) for _ in range(300)]
    n = np.array([len(x) for x in texts])
    packed = [zlib.compress(x.encode()) for x in texts]
    found = sum(len(a) for a, _ in ratios._Postings(packed, n, 0.88).candidates(packed, n))
    assert 300 <= found < 0.05 * 300 * 300
