"""Term graph for bundles, and near-duplicate questions."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.text import content_text, key_terms

from .ratios import bounded_ratio, ratio_pairs  # noqa: F401


def term_postings(papers: DataFrame, key: str, terms: Column, least: int = 2, most: int = 50) -> DataFrame:
    """(term, paper, df) of terms that at least ``least`` and at most ``most`` papers have.

    The upper bound is part of the planner's definition of a telling term and bounds a term's pairs.
    """
    rows = papers.select(F.col(key).alias("paper"), F.explode(F.array_distinct(terms)).alias("term"))
    df = rows.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(least, most))
    return rows.join(df, "term")


def related_pairs(postings: DataFrame, papers: int | Column, least_shared: int = 2) -> DataFrame:
    """(a, b, shared, weight, score) of papers with enough telling terms in common; weight = sum ln((N + 1) / (df + 1))."""
    n = F.lit(papers) if isinstance(papers, int) else papers
    a = postings.select("term", "df", F.col("paper").alias("a"))
    b = postings.select("term", F.col("paper").alias("b"))
    shared = a.join(b, "term").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum(F.log((n + 1.0) / (F.col("df") + 1.0))).alias("w"))
    return shared.where(F.col("shared") >= least_shared).select("a", "b", "shared", F.round("w", 6).alias("weight"), F.round(F.col("w") + F.col("shared"), 6).alias("score"))


def ranked_triples(pairs: DataFrame, neighbours: int) -> DataFrame:
    """Triples of a paper and two of its best neighbours, each once with its best score."""
    ends = pairs.select(F.col("a").alias("center"), F.col("b").alias("other"), "score").union(pairs.select(F.col("b").alias("center"), F.col("a").alias("other"), "score"))
    near = ends.withColumn("r", F.row_number().over(W.partitionBy("center").orderBy(F.desc("score"), "other"))).where(F.col("r") <= neighbours)
    p, q = near.select("center", F.col("other").alias("o1"), F.col("score").alias("s1")), near.select("center", F.col("other").alias("o2"), F.col("score").alias("s2"))
    both = p.join(q, "center").where("o1 < o2")  # at most neighbours ** 2 a center
    three = F.array_sort(F.array("center", "o1", "o2"))
    return both.select(three.alias("t"), F.round(F.col("s1") + F.col("s2"), 6).alias("s")).groupBy("t").agg(F.max("s").alias("score")).select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"), "score")


def greedy_reuse(ranked: DataFrame, members: list[str], target: int, reuse: int, *order: Column) -> list[tuple]:
    """Best bundles in order such that no paper is used more than ``reuse`` times, up to ``target``.

    Truly sequential, so it reads the ranked report row by row on the driver and stops at the target.
    """
    used: dict = {}
    out: list[tuple] = []
    for row in ranked.orderBy(*order).toLocalIterator():
        if len(out) == target:
            break
        papers = [row[m] for m in members]
        if all(used.get(p, 0) < reuse for p in papers):
            out.append(tuple(row))
            for p in papers:
                used[p] = used.get(p, 0) + 1
    return out


BUCKETS = 1 << 20  # counters of the token sketch: fixed, whatever the input
SIGN_BITS = 1024


@F.pandas_udf(T.BinaryType())
def _packed(joined: pd.Series) -> pd.Series:
    return joined.map(lambda x: zlib.compress(x.encode(), 6))


def _words(packed: bytes) -> list[str]:
    return zlib.decompress(packed).decode().split(" ")


def _keys(packed: bytes) -> np.ndarray:
    """A hash of each token: equal tokens have equal ones, so it may find too many candidates but loses none."""
    return np.fromiter((zlib.crc32(w.encode()) for w in _words(packed)), np.int64)


def _token_sets(questions: DataFrame, key: str, question: str, *order: Column) -> DataFrame:
    """(id, rank, set, joined, n): each row's token set as sorted text, its hash and its size."""
    tokens = F.sort_array(F.array_distinct(F.split(content_text(F.col(question)), " ")))
    rows = questions.select(F.col(key).alias("id"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("id")).alias("rank"), tokens.alias("tokens"))
    rows = rows.select("id", "rank", F.array_join("tokens", " ").alias("joined"), F.size("tokens").alias("n"))
    return rows.withColumn("set", F.unhex(F.sha2("joined", 256)))


def question_classes(questions: DataFrame, key: str, question: str, *order: Column) -> DataFrame:
    """(set, id, n, packed) of every token set: the first row in order (then by key) that has it, its size and packed tokens."""
    rows = _token_sets(questions, key, question, *order).withColumn("packed", _packed("joined"))
    best = rows.groupBy("set").agg(F.min(F.struct("rank", "n", "packed")).alias("best"))
    # read several times; the part of a lost executor is computed again
    return best.select("set", F.col("best.rank.id").alias("id"), F.col("best.n").alias("n"), F.col("best.packed").alias("packed")).persist(StorageLevel.DISK_ONLY)


def _token_counts(classes: DataFrame) -> np.ndarray:
    """How many sets have a token of each bucket: an order from rare to common, of fixed size."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for packed in batch["packed"]:
                np.add.at(total, _keys(packed) % BUCKETS, 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            yield pd.DataFrame({"bucket": at[i : i + (1 << 16)], "n": total[at[i : i + (1 << 16)]]})

    counted = classes.select("packed").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return out


def _class_pairs(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, common, total) of token sets ``classes(id, n, packed)`` with a Jaccard similarity of num / den or more.

    Tokens are ordered from rare to common; two such sets share a token in their prefixes, so only these are joined. What
    is shuffled is one hash for each prefix token. Parities of token hashes bound a pair's difference from below and rule
    out most candidates before packed sets are fetched; the rest is compared token by token.
    """
    counts = classes.sparkSession.sparkContext.broadcast(_token_counts(classes).astype(np.int32))

    def signed(batches):
        for batch in batches:
            signs, prefixes = [], []
            for packed, n in zip(batch["packed"], batch["n"], strict=True):
                keys = _keys(packed)
                signs.append(np.packbits((np.bincount(keys >> 22, minlength=SIGN_BITS) & 1).astype(np.uint8)).tobytes())
                prefixes.append(keys[np.lexsort((keys, counts.value[keys % BUCKETS]))][: n - -(-n * num // den) + 1])
            yield pd.DataFrame({"id": batch["id"], "n": batch["n"], "sign": signs, "prefix": prefixes})

    @F.pandas_udf(T.IntegerType())
    def differing(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([(int.from_bytes(x) ^ int.from_bytes(y)).bit_count() for x, y in zip(a, b, strict=True)], dtype="int32")

    @F.pandas_udf(T.IntegerType())
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(set(_words(x)).intersection(_words(y))) for x, y in zip(a, b, strict=True)], dtype="int32")

    kind = classes.schema["id"].dataType.simpleString()
    marks = classes.select("id", "n", "packed").mapInPandas(signed, f"id {kind}, n int, sign binary, prefix array<long>").persist(StorageLevel.DISK_ONLY)
    prefix = marks.select("id", "n", F.posexplode("prefix").alias("place", "token"))
    x, y = prefix.select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa")), prefix.select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    # what is left from the shared token on must reach the overlap that the similarity asks for
    reach = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= F.ceil((F.col("na") + F.col("nb")) * num / (num + den))
    pairs = x.join(y, "token").where(fits & reach).select("a", "b").distinct()
    side = lambda df, end, *cols: df.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in cols])
    near = pairs.join(side(marks, "a", "n", "sign"), "a").join(side(marks, "b", "n", "sign"), "b")
    near = near.where(differing("sign_a", "sign_b") * (num + den) <= (F.col("n_a") + F.col("n_b")) * (den - num)).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("both"))
    found = near.join(side(classes, "a", "packed"), "a").join(side(classes, "b", "packed"), "b")
    out = found.select("a", "b", "both", shared("packed_a", "packed_b").alias("common")).select("a", "b", "common", (F.col("both") - F.col("common")).alias("total"))
    return out.where(F.col("common") * den >= F.col("total") * num)


def near_duplicate_questions(questions: DataFrame, key: str, question: str, num: int = 80, den: int = 100) -> DataFrame:
    """(a, b, common, total) of questions whose token sets have a Jaccard similarity of num / den or more.

    Rows of one token set are one class: links join the smallest keys of classes, and each other row its class's smallest
    key, so that N copies make N - 1 rows. A null or blank question has the set of one empty token.
    """
    classes = question_classes(questions, key, question)
    copies = _token_sets(questions, key, question).select("set", F.col("id").alias("b")).join(classes.select("set", F.col("id").alias("a"), "n"), "set").where("a <> b")
    return _class_pairs(classes, num, den).union(copies.select("a", "b", "n", "n"))


def keep_distinct(items: DataFrame, key: str, question: str, *order: Column, num: int = 80, den: int = 100) -> DataFrame:
    """Rows in order without those that are near-duplicates of an earlier row that stays.

    Of rows of one token set only the first can stay: whatever drops it drops the later ones, and if it stays it does.
    """
    first = question_classes(items, key, question, *order)
    best = items.join(first.select(F.col("id").alias(key)), key, "left_semi")
    return keep_first(best, _class_pairs(first, num, den).select("a", "b"), key, *order)


def keep_first(items: DataFrame, pairs: DataFrame, key: str, *order: Column) -> DataFrame:
    """Rows in rank order without those that a kept earlier row duplicates; pairs are (a, b).

    Each round keeps rows with no open better neighbour and drops their neighbours, so rounds follow the longest chain
    of duplicates, not the number of rows.
    """
    ranked = items.select(F.col(key).alias("id"), F.struct(*order, F.col(key)).alias("rank"))
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = both.join(ranked.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(ranked.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b").where("rb < ra").select("a", "b").cache()
    dropped = items.sparkSession.createDataFrame([], f"id {items.schema[key].dataType.simpleString()}")
    open_ = edges
    while not open_.isEmpty():
        waiting = open_.select(F.col("a").alias("id")).distinct()
        sure = open_.select(F.col("b").alias("id")).distinct().join(waiting, "id", "left_anti")
        gone = open_.join(sure.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id")).distinct()
        dropped = dropped.union(gone)
        open_ = open_.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").cache()
    return items.join(dropped.withColumnRenamed("id", key), key, "left_anti")


def set_packing(bundles: DataFrame, key: str, members: str, weight: str) -> list:
    """Disjoint bundles, heaviest first: the greedy answer to weighted set packing on the ranked report."""
    taken: set = set()
    out = []
    for row in bundles.orderBy(F.desc(weight), key).toLocalIterator():
        if taken.isdisjoint(row[members]):
            out.append(row[key])
            taken.update(row[members])
    return out


def paper_terms(body: Column) -> Column:
    return key_terms(body)
