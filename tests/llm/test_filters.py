"""Decontamination, line dedup, toxicity and quality."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import decontaminate, linededup, quality, toxicity
from folio.llm.registry import ORACLE, QUERIES
from tests.support import SMALL, same_rows

from .test_words import shingles


@pytest.mark.parametrize("name", ["op2_decontaminate", "op7_line_dedup"])
def test_query_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SMALL), duck, ORACLE[name])


def test_short_item_inside_a_long_text(spark):
    item = [f"t{i}" for i in range(20)]
    broken = [*item[:9], "other", *item[10:]]  # 11 of 16 shingles are left
    late = [*item[:-1], "other"]  # 15 of 16
    filler = [f"f{i}" for i in range(20_000)]
    docs = [(1, filler + item), (2, broken + filler), (3, filler[:500] + late + filler), (4, filler), (5, item)]
    df = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in docs], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, "two words"), (9, None)], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contaminated_pairs(df, items).collect()))
    assert got == [(1, 7, 16, 16), (3, 7, 16, 15), (5, 7, 16, 16)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(df, items).collect()) == [2, 4]


def test_blocks_of_items_give_the_same(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    blocks = decontaminate.item_blocks(items, "item_id", "text", block_bytes=2000)
    assert len(blocks) > 1
    got = [r for b in blocks for r in docs.select("doc_id", F.explode(decontaminate.found_in(b, F.col("text"))).alias("h")).select("doc_id", "h.item_id").collect()]
    assert sorted(map(tuple, got)) == sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs, items).collect())


def test_signature_misses_nothing():
    for n in range(1, 200):
        assert decontaminate.signature_length(n, 80, 100) == n - (80 * n + 99) // 100 + 1


def test_odd_decontamination(odd, none, spark):
    items = spark.createDataFrame([(1, "a b c d e f g h"), (2, "one"), (3, None), (4, "")], "item_id long, text string")
    got = [tuple(r) for r in decontaminate.contaminated_pairs(odd, items).select("doc_id", "item_id").collect()]
    assert sorted(got) == [(3, 2), (4, 1), (4, 1), (4, 1), (5, 1), (6, 1)]
    assert decontaminate.contaminated_pairs(none, items).count() == 0
    assert decontaminate.contaminated_pairs(odd, items.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(odd, items.limit(0)).count() == odd.count()


def test_lines_by_spread_not_frequency(spark):
    rows = [(i, f"own {i}\nshared\n\nlast {i}", f"s{i}") for i in range(12)] + [(100 + i, "often\n" * 3, "s1") for i in range(20)]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").collect()
    got = {r.record.doc_id: r for r in out}
    assert got[0].clean == rows[0][1] and list(got[0].removed) == []
    assert got[5].clean == "own 5\n\nlast 5" and list(got[5].removed) == [1] and got[5].n_lines == 4
    assert got[100].clean == rows[12][1]


@pytest.mark.parametrize("sites", [9, 10, 11])
def test_near_threshold_is_exact(spark, sites):
    rows = [(i, "line", f"s{i % sites}") for i in range(60)]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source")
    assert out.where(F.size("removed") > 0).count() == (59 if sites >= 10 else 0)


def test_odd_lines(odd, none):
    out = linededup.dedup_lines(odd, "doc_id", "text", "source", min_sites=1).collect()
    assert len(out) == odd.count()
    got = {r.record.doc_id: r for r in out if r.record.doc_id is not None}
    assert got[0].clean is None and got[0].n_lines == 0
    assert got[1].clean == "" and got[2].clean == "   \n\t "
    assert got[5].clean == "" and got[4].clean == got[4].record.text  # the first occurrence stays
    assert linededup.dedup_lines(none, "doc_id", "text", "source").count() == 0


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() >= 0.9
    assert ((got.doc_id.astype(str).map(lambda x: __import__("zlib").crc32(x.encode()) % 5) == 0) == got.held_out).all()


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score_documents(docs, x).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(int)
    raw = toxicity.BoostedTrees(rounds=40).fit(x, y).raw(x)
    assert ((raw > 0) == y).mean() > 0.97
    xs, ys = toxicity.isotonic(np.array([0.0, 1, 2, 3, 3]), np.array([0, 1, 0, 1, 1]))
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all()
    assert toxicity.BoostedTrees().fit(x, np.zeros(2000)).trees == []


def test_feature_chunks_agree(monkeypatch):
    texts = pa.array(["You IDIOT!! stoooop", "", None, "it 1d10t a.b", "x" * 500, "you are fine?"] * 5)
    lexicon = toxicity.Lexicon(toxicity._hash_bytes(["idiot"]), np.array([5.0]))
    whole = toxicity.features(texts, lexicon)
    monkeypatch.setattr(toxicity, "CHUNK_BYTES", 10)
    assert np.allclose(whole, toxicity.features(texts, lexicon))
    assert whole.shape == (30, len(toxicity.FEATURES)) and whole[0, 0] > 0 and whole[3, 0] > 0 and not whole[1].any()


def test_odd_toxicity(odd, none, spark):
    labels = spark.createDataFrame([(4, 1), (5, None), (None, 1), (999, 0), (1, 0)], "doc_id long, toxic int")
    assert toxicity.score_documents(odd, labels).where("score between 0 and 1").count() == odd.count()
    assert toxicity.score_documents(none, labels).count() == 0
    assert {r.score for r in toxicity.score_documents(odd, labels.limit(0)).collect()} == {0.0}


def test_quality_keeps_good_text(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op5_quality_resampling"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.95 and got[got.quality == 0].kept.mean() < 0.3


def test_weights_equal_brute_force(spark):
    texts = ["good text here.", "BAD!! BAD!!", "good text again.", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.resample(df, labels).collect()}
    grams = [next(iter(quality.ngram_buckets(pa.array([t]))))[1] if t else np.zeros(0, int) for t in texts]
    raw = np.bincount(np.concatenate(grams), minlength=quality.BUCKETS)
    good = np.bincount(np.concatenate([grams[0], grams[2]]), minlength=quality.BUCKETS)
    ratio = np.log((good + 1) / (good.sum() + quality.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality.BUCKETS))
    for i, g in enumerate(grams):
        assert rows[i].log_weight == pytest.approx(ratio[g].sum())
    assert sum(r.kept for r in rows.values()) == round(2 / 3 * 4)


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(quality, "LAST_ROWS", 5)
    values = [((i * 7919) % 1000) ** 3 / 1e5 for i in range(1000)] + [1e300, -1e300] + [5.0] * 30
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for k in (1, 2, 10, 500, 1032):
        assert quality.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, "x", 0) is None


def test_odd_quality(odd, none, spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None)], "doc_id long, quality int")
    rows = quality.resample(odd, labels).collect()
    assert len(rows) == odd.count() and {r.log_weight for r in rows if r.doc_id in (0, 1)} == {0.0}
    assert quality.resample(none, labels).count() == 0
    assert all(r.kept for r in quality.resample(odd, labels.limit(0)).collect())


def test_shingles_helper_matches_sql_words():
    assert shingles("A b\x0bc") == [("a", "b", "c")] and hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def plain_features(text, weights, insults, second):
    """A text's features by plain Python over its bytes; ``weights`` gives a word's or a start's lexicon weight."""
    raw = (text or "").encode()
    words, at = [], None
    for i, b in enumerate([*raw, 0]):
        if toxicity.IN_WORD[b] and i < len(raw):
            at = i if at is None else at
        elif at is not None:
            words.append((at, i))
            at = None
    fold = [bytes(toxicity.FOLD[list(raw[a:b])]) for a, b in words]
    weight = [max([weights(w), *(weights(w, k) for k in toxicity.STEMS if len(w) > k)]) for w in fold]
    hit = [i for i, w in enumerate(weight) if w]
    strong = [i for i in hit if weight[i] >= toxicity.STRONG_ODDS]
    you = [i for i, w in enumerate(fold) if w in second]
    near = [i for i in hit if any(abs(i - y) <= 5 for y in you)]
    letter, n, size = toxicity.LETTER, max(len(words), 1), max(len(raw), 1)
    odd = sum(1 for i in range(1, len(raw) - 1) if letter[raw[i - 1]] and toxicity.STAND_IN[raw[i]] and letter[raw[i + 1]])
    same = sum(1 for i in range(2, len(raw)) if letter[raw[i]] and raw[i] == raw[i - 1] == raw[i - 2])
    upper = lambda a, b: sum(65 <= x <= 90 for x in raw[a:b])
    shout = sum(1 for a, b in words if upper(a, b) > 1 and not any(97 <= x <= 122 for x in raw[a:b]))
    share = lambda table: sum(bool(table[x]) for x in raw) / size
    row = [len(strong) / n, np.log1p(len(strong)), sum(weight) / n, max(weight, default=0.0), sum(w in insults for w in fold) / n, len(you) / n, len(near) / n]
    return [*row, upper(0, len(raw)) / size, shout / n, raw.count(b"!") / size, raw.count(b"?") / size, share(toxicity.PUNCTUATION), odd / n, same / n, np.log1p(len(words))]


def test_scores_equal_plain_python(spark):
    """Features, trees and calibration of the fitted model, recomputed text by text."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, "doc_id", "text", "toxic")
    entries = dict(zip(model.lexicon.hashes.tolist(), model.lexicon.weights.tolist(), strict=True))
    known = {}

    def weights(word, k=None):
        if (word, k) not in known:
            w = toxicity._Words(np.frombuffer(word, np.uint8), np.zeros(1, np.int64))
            h = w.full[0] if k is None else next(h for size, (_, h) in zip(toxicity.STEMS, w.stems(), strict=True) if size == k)[0]
            known[word, k] = entries.get(int(h), 0.0)
        return known[word, k]

    fold = lambda xs: {bytes(toxicity.FOLD[list(x.encode())]) for x in xs}
    insults, second = fold(toxicity.INSULTS), fold(toxicity.SECOND_PERSON)
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts = {k: texts[k] for k in sorted(texts, key=lambda k: len(texts[k] or ""))[:150]}
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    for key, text in texts.items():
        x = plain_features(text, weights, insults, second)
        raw = model.trees.start
        for feature, cut, value in model.trees.trees:
            node = 0
            for _ in range(model.trees.depth):
                node = 2 * node + 1 + int(feature[node] >= 0 and x[feature[node]] > cut[node])
            raw += value[node - (2**model.trees.depth - 1)]
        assert got[key] == pytest.approx(min(1.0, max(0.0, float(np.interp(raw, *model.knots)))), abs=1e-9)


def test_a_repeated_key_is_one_row_of_the_sample(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    once = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    many = {r.doc_id: r.score for r in toxicity.score_documents(docs.union(docs).union(docs), labels).collect()}
    assert once == pytest.approx(many)
