"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A bounded sample of labelled training rows is cut in three by a hash: one part finds lexicon entries (words and word
starts that toxic rows favour), one grows the trees on features that use the lexicon, one calibrates. All texts are then
scored whole, by one vectorised pass. Labels, language, source and ids are no inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .words import LOWER, U, byte_values, mix, prefix_sums, utf8_buffers

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 30_000
#: Lexicon entries kept, at most; the strongest stay.
LEXICON_ENTRIES = 20_000
#: Toxic rows that an entry must occur in, and the least log odds of an entry.
LEAST_ROWS, LEAST_ODDS, STRONG_ODDS = 5, 2.3, 4.0
#: Bytes at the start of a longer word that make an entry of their own.
STEMS = (4, 5, 6, 7)
CHUNK_BYTES = 1 << 18

FOLD = LOWER.copy()  # digits and signs that stand for letters
for _a, _b in zip(b"013457@$", b"oieastas", strict=True):
    FOLD[_a] = _b
FOLD_VALUES = byte_values(FOLD)
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), ord("@"), ord("$"), *range(128, 256)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
SMALL = np.zeros(256, bool)
SMALL[97:123] = True
STAND_IN = np.zeros(256, bool)
STAND_IN[[*range(48, 58), *b"@$*#!%&+"]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

# Common insults and second-person pronouns.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown fool dumb garbage filth vermin imbecile jerk creep pig ugly liar coward hate shut kill die".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi vous ton ta votre vos ti tus usted ustedes vosotros".split()
FEATURES = "strong_density strong_count weighted_density best_weight insult_density second_person near_second_person capitals all_capitals exclamations questions punctuation obfuscation repeats log_words".split()


def _hash_bytes(words: list[str]) -> np.ndarray:
    buf = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.sort(_Words(buf, np.zeros(1, np.int64)).full)


class _Words:
    """Hashes of the words of a chunk and of their starts, after folding."""

    def __init__(self, buf: np.ndarray, doc_starts: np.ndarray):
        inside = IN_WORD[buf]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        at = doc_starts[doc_starts < len(buf)]
        first[at] |= inside[at]
        at = at[at > 0] - 1
        last[at] |= inside[at]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.sums = prefix_sums(buf, self.starts, FOLD_VALUES)
        self.full = self._part(self.ends, 0)

    def _part(self, ends: np.ndarray, kind: int) -> np.ndarray:
        return mix(self.sums[ends] - self.sums[self.starts] + U(kind))

    def stems(self):
        """(which words, hashes) for each length of stem."""
        length = self.ends - self.starts
        for k in STEMS:
            which = np.flatnonzero(length > k)
            yield which, mix(self.sums[self.starts[which] + k] - self.sums[self.starts[which]] + U(k))


def _chunks(texts: pa.Array):
    """(bytes, document starts) of runs of documents; a long document is a run of its own."""
    data, offsets = utf8_buffers(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
        yield data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


@dataclass
class Lexicon:
    hashes: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.hashes)
        self.hashes, self.weights = self.hashes[order], self.weights[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.hashes & U((1 << 20) - 1)).astype(np.int64)] = True

    def weight(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` of entries, and their weights."""
        at = np.flatnonzero(self.filter[(h & U((1 << 20) - 1)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return at[:0], np.zeros(0)
        i = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        found = self.hashes[i] == h[at]
        return at[found], self.weights[i[found]]


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES for each text; an empty one has zeros."""
    out = []
    second, insults = (Lexicon(_hash_bytes(x), np.ones(len(x))) for x in (SECOND_PERSON, INSULTS))
    for buf, bounds in _chunks(texts):
        docs = len(bounds) - 1
        if not len(buf):
            out.append(np.zeros((docs, len(FEATURES))))
            continue
        w = _Words(buf, bounds[:-1])
        doc = np.searchsorted(bounds, w.starts, "right") - 1
        n = np.bincount(doc, minlength=docs)[:docs].astype(float)
        weight = np.zeros(len(w.full))
        at, got = lexicon.weight(w.full)
        np.maximum.at(weight, at, got)
        for which, h in w.stems():
            at, got = lexicon.weight(h)
            np.maximum.at(weight, which[at], got)
        hit = np.flatnonzero(weight)
        per = lambda x, y=None: np.bincount(doc[x], None if y is None else y, minlength=docs)[:docs]
        best = np.zeros(docs)
        np.maximum.at(best, doc[hit], weight[hit])
        strong = hit[weight[hit] >= STRONG_ODDS]
        you = second.weight(w.full)[0]
        near = np.zeros(0, int)
        if len(you) and len(hit):
            i = np.searchsorted(you, hit)
            sides = [you[np.minimum(i, len(you) - 1)], you[np.maximum(i - 1, 0)]]
            near = hit[np.any([(np.abs(y - hit) <= 5) & (doc[y] == doc[hit]) for y in sides], axis=0)]
        filled = bounds[:-1] < bounds[1:]
        spots = bounds[:-1][filled]

        def count(flags, filled=filled, spots=spots, docs=docs):
            x = np.zeros(docs)
            x[filled] = np.add.reduceat(flags, spots, dtype=np.int64)
            return x

        letter = LETTER[buf]
        odd = np.zeros(len(buf), bool)
        odd[1:-1] = letter[:-2] & STAND_IN[buf[1:-1]] & letter[2:]
        same = np.zeros(len(buf), bool)
        same[2:] = letter[2:] & (buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2])
        odd[spots] = same[spots] = odd[spots[1:] - 1] = False  # no pattern spans two documents
        same[np.minimum(spots + 1, len(buf) - 1)] = False
        upper = np.concatenate([[0], np.cumsum(CAPITAL[buf])])
        lower = np.concatenate([[0], np.cumsum(SMALL[buf])])
        shout = np.flatnonzero((upper[w.ends] - upper[w.starts] > 1) & (lower[w.ends] == lower[w.starts]))
        words, chars = np.maximum(n, 1), np.maximum(np.diff(bounds), 1)
        out.append(
            np.stack(
                [per(strong) / words, np.log1p(per(strong)), per(hit, weight[hit]) / words, best, per(insults.weight(w.full)[0]) / words, per(you) / words, per(near) / words]
                + [count(CAPITAL[buf]) / chars, per(shout) / words, count(buf == 33) / chars, count(buf == 63) / chars, count(PUNCTUATION[buf]) / chars, count(odd) / words, count(same) / words, np.log1p(n)],
                axis=1,
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


class BoostedTrees:
    """Second-order boosting of small trees on binned features for logistic loss."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.15, bins: int = 64, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.penalty = rounds, depth, rate, bins, penalty

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        if not len(y):
            self.start, self.trees = float("-inf"), []
            return self
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        p = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
        self.start, self.trees = float(np.log(p / (1 - p))), []
        if not 0 < y.sum() < len(y):
            return self
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = p - y, p * (1 - p)
            node = np.zeros(len(y), int)
            feature, cut = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1)
            for d in range(self.depth):
                first, wide = 2**d - 1, 2**d
                best = [(1e-6, -1, 0)] * wide
                for f in range(x.shape[1]):
                    nb = len(self.edges[f]) + 1
                    at = (node - first) * nb + binned[:, f]
                    g = np.cumsum(np.bincount(at, grad, wide * nb).reshape(wide, nb), axis=1)
                    h = np.cumsum(np.bincount(at, hess, wide * nb).reshape(wide, nb), axis=1)
                    gain = g**2 / (h + self.penalty) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + self.penalty) - g[:, -1:] ** 2 / (h[:, -1:] + self.penalty)
                    for i in range(wide):
                        b = int(gain[i, :-1].argmax()) if nb > 1 else 0
                        if nb > 1 and gain[i, b] > best[i][0]:
                            best[i] = (gain[i, b], f, b)
                for i, (_, f, b) in enumerate(best):
                    feature[first + i], cut[first + i] = f, self.edges[f][b] if f >= 0 else np.inf
                f = feature[node]
                right = np.where(f >= 0, x[np.arange(len(y)), np.maximum(f, 0)] > cut[node], False)
                node = 2 * node + 1 + right
            leaf = node - (2**self.depth - 1)
            g, h = np.bincount(leaf, grad, 2**self.depth), np.bincount(leaf, hess, 2**self.depth)
            value = -self.rate * g / (h + self.penalty)
            score += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                node = 2 * node + 1 + np.where(f >= 0, x[rows, np.maximum(f, 0)] > cut[node], False)
            score += value[node - (2**self.depth - 1)]
        return score


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of ``y`` on ``raw`` (pool adjacent violators), smoothed by one case a class."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first raw, last raw
    for r, v in zip(raw[order], y[order], strict=True):
        blocks.append([float(v), 1.0, r, r])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, w, _, b = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = b
    prior = float(y.mean()) if len(y) else 0.0
    if not blocks:
        return np.zeros(1), np.zeros(1)
    xs = np.array([v for b in blocks for v in b[2:]])
    ys = np.repeat([(b[0] + prior) / (b[1] + 1) for b in blocks], 2)
    return xs, np.maximum.accumulate(ys)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: BoostedTrees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: pa.Array) -> np.ndarray:
        return np.clip(np.interp(self.trees.raw(features(texts, self.lexicon)), *self.knots), 0, 1)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _entry_counts(batches):
    """Hashes of the words and stems of rows, with the number of toxic and other rows that have each."""
    for batch in batches:
        toxic = np.array(batch.column(1).to_pylist(), int)
        for lo in range(0, len(batch), 512):
            t, at, parts = toxic[lo : lo + 512], 0, []
            for buf, bounds in _chunks(batch.column(0).slice(lo, 512)):
                w = _Words(buf, bounds[:-1]) if len(buf) else None
                if w is not None:
                    doc = np.searchsorted(bounds, w.starts, "right") - 1 + at
                    parts += [(w.full, doc), *((h, doc[which]) for which, h in w.stems())]
                at += len(bounds) - 1
            if not parts:
                continue
            h, d = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            one = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
            h, d = h[one], d[one]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            a = np.add.reduceat(t[d], first)
            b = np.diff(np.append(first, len(h))) - a
            yield pa.record_batch({"h": pa.array(h[first].view(np.int64)), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on at most ``rows`` labelled rows outside the held-out fold, the first in the order of a hash of the key.

    Of rows with one key the least text counts, so a repeated key is one row of the sample.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id")))
    order = F.xxhash64(F.lit("toxicity"), "id")
    sample = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(order, "id").limit(rows)
    texts = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    one_each = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    picked = scratch.materialize(one_each.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(10))), "labelled")
    counts = picked.where("part < 5").select("text", "y").mapInArrow(_entry_counts, "h long, a long, b long").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") >= LEAST_ROWS)
    n1, n0 = picked.where("part < 5").agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    n1, n0 = n1 or 0, n0 or 0
    odds = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0))
    entries = counts.select("h", odds.alias("w")).where(F.col("w") >= LEAST_ODDS).orderBy(F.desc("w"), "h").limit(LEXICON_ENTRIES).collect()
    lexicon = Lexicon(np.array([r.h for r in entries], np.int64).view(U), np.array([r.w for r in entries], float))
    shared = spark.sparkContext.broadcast(lexicon)

    def rows_of(batches):
        for batch in batches:
            x = features(batch.column(0), shared.value)
            yield pa.record_batch({"x": pa.array(x.tolist(), pa.list_(pa.float64())), "y": batch.column(1), "part": batch.column(2)})

    got = picked.where("part >= 5").select("text", "y", "part").mapInArrow(rows_of, "x array<double>, y int, part long").toPandas()  # at most half the sample
    x = np.array(got.x.tolist(), float).reshape(-1, len(FEATURES))
    y, grow = got.y.to_numpy(int), got.part.to_numpy() < 8
    order = np.lexsort(x.T)  # the same fit whatever the order of rows
    x, y, grow = x[order], y[order], grow[order]
    trees = BoostedTrees().fit(x[grow], y[grow])
    return ToxicityModel(lexicon, trees, isotonic(trees.raw(x[~grow]), y[~grow]))


def score_column(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """Score in 0 to 1 of every whole text; a null text is an empty one."""
    shared = spark.sparkContext.broadcast(model)  # trees and at most LEXICON_ENTRIES entries

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts), pa.float64())

    return score.asNondeterministic()(text)  # so that a filter on it doesn't run it twice


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Every row of ``docs`` with ``held_out``, ``score`` and ``predicted``.

    Labels are learnt only from rows whose crc32(key as text) mod 5 is not 0. Null labels and labels of unknown keys are
    ignored; without both classes all scores are the share of toxic rows, 0 without labels. Null and empty texts get the
    score of zero features. Ties need no rule: equal texts have equal scores. Output columns replace clashing ones.
    """
    scored = score_column(docs.sparkSession, train(docs, labels, key, text, label), F.col(text))
    out = docs.withColumn("held_out", held_out(F.col(key))).withColumn("score", scored)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", "predicted")
