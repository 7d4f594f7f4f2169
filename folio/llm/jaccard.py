"""Exact Jaccard join of shingle sets with set-relation skipping.

1. A count sketch over all shingles orders them, common ones last; any order is exact, this one keeps index lists short.
2. Every distinct set posts the prefix that any partner must meet, as (shingle, set, size, position) packed in binary
   blocks, dealt by shingle.
3. A list first pairs its members with one pivot only: the member with the fewest shingles before the shared one, which
   the others of a near-copy group are edits of. The verified overlaps are computed answers: the others of a list follow
   from them where they join one component, and the triangle inequality of the Jaccard distance rules out more. Lists
   that are not one component then are cut into blocks by size; a block is skipped when its best position cannot reach
   the overlap needed, and only what is left is compared. A long list is dealt as pairs of parts.
4. Candidates whose parity bitmaps differ in more bits than a link allows are ruled out; the rest are verified on whole
   sets, and links become components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .components import star_components
from .words import iter_word_hashes, shingle_hashes

POSTING = np.dtype([("h", "<u8"), ("id", "<i8"), ("n", "<i4"), ("pos", "<i4")])
SKETCH_BLOCK = 4096
FLUSH_POSTINGS = 300_000
SKIP_BLOCK = 64
#: Members of an index list that one comparison holds from either side.
LIST_PART = 2048
SEEN_SETS = 500_000


def document_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in order."""
    for _, _, hashes, counts in iter_word_hashes(texts):
        shingles, sizes = shingle_hashes(hashes, counts, k)
        ends = np.cumsum(sizes)
        for a, b in zip(ends - sizes, ends, strict=True):
            s = np.sort(shingles[a:b])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128-bit identity of a set."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def shingle_levels(docs: DataFrame, text: str, k: int, bits: int) -> tuple[np.ndarray, int]:
    """A commonness level for each of ``2 ** bits`` shingle buckets, and the number of shingles, over all rows.

    The result has a fixed size; level 0 is the ordinary load of a bucket.
    """

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, _, hashes, counts in iter_word_hashes(batch.column(0)):
                s, _ = shingle_hashes(hashes, counts, k)
                total += np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        blocks = total.reshape(-1, SKETCH_BLOCK)
        full = np.flatnonzero(blocks.any(axis=1))
        yield pa.record_batch({"block": pa.array(full, pa.int32()), "counts": pa.array([blocks[i].tobytes() for i in full], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_BLOCK, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"block": table.column("block").slice(0, 1).cast(pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, counts binary"
    parts = docs.select(text).mapInArrow(count, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    # two steps, so that no group holds a block of every task
    halves = parts.groupBy("block", "part").applyInArrow(merge, schema)
    merged = halves.groupBy("block").applyInArrow(merge, schema).collect()  # 2 ** bits counters at most
    total = np.zeros((1 << bits) // SKETCH_BLOCK * SKETCH_BLOCK, np.int64).reshape(-1, SKETCH_BLOCK)
    for row in merged:
        total[row.block] = np.frombuffer(row.counts, np.int64)
    total = total.ravel()
    usual = np.median(total)
    excess = total - usual
    common = excess > 6 * np.sqrt(usual) + 0.5 * usual + 16
    return np.where(common, np.log2(np.maximum(excess, 1)).astype(np.int64) + 1, 0).astype(np.uint8), int(total.sum())


def prefix_length(n: int, num: int, den: int) -> int:
    """Shingles of a set of ``n`` that any partner must meet: n - ceil(n * num / den) + 1."""
    return n - -(-n * num // den) + 1


def parity_bitmap(s: np.ndarray) -> bytes:
    """Parities of a set's counts in at least twice as many bins as it has members.

    The bits in which two bitmaps differ are at most as many as the members that only one set has.
    """
    size = max(64, 1 << int(2 * len(s) - 1).bit_length())
    counts = np.bincount(((s >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _set_keys(k: int):
    """(doc_id, text) to (doc_id, n, k1, k2, bitmap); a set's bitmap comes with the first documents that have it."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for s in document_sets(batch.column(1), k):
                k1, k2 = set_key(s) if len(s) else (None, None)
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                rows.append((len(s), k1, k2, parity_bitmap(s) if len(s) and k1 not in seen else None))
                seen.add(k1)
            if rows:
                n, k1, k2, bits = zip(*rows, strict=True)
                yield pa.record_batch({"doc_id": batch.column(0).cast(pa.int64()), "n": pa.array(n, pa.int64()), "k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()), "bits": pa.array(bits, pa.binary())})

    return run


def _close_enough(num: int, den: int):
    """Keeps pairs (a, b, na, nb, bits_a, bits_b) whose bitmaps allow a link."""

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                x, y = (x, y) if len(x) >= len(y) else (y, x)
                while len(x) > len(y):  # halves of a bitmap add up to the bitmap of half as many bins
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                keep.append(int(np.bitwise_count(x ^ y).sum()) * (num + den) <= (na[i] + nb[i]) * (den - num))
            yield pa.record_batch({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(keep, pa.bool_()))

    return run


def _postings(levels, bits: int, k: int, num: int, den: int, buckets: int):
    """Texts to packed blocks of postings by bucket; a set met before in a task posts nothing again."""

    def run(batches):
        common, seen, held, count = levels.value, set(), [], 0

        def flush():
            p = np.concatenate(held)
            b = ((p["h"] & np.uint64(0x7FFFFFFF)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(b, kind="stable")
            p, b = p[order], b[order]
            cuts = np.flatnonzero(np.diff(b)) + 1
            held.clear()
            return pa.record_batch({"bucket": pa.array(b[np.concatenate([[0], cuts])], pa.int32()), "block": pa.array([x.tobytes() for x in np.split(p, cuts)], pa.binary())})

        for batch in batches:
            for s in document_sets(batch.column(0), k):
                n = len(s)
                k1 = set_key(s)[0] if n else None
                if not n or k1 in seen:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(k1)
                level = common[(s >> np.uint64(64 - bits)).astype(np.int64)]
                if level.any():
                    s = s[np.argsort(level, kind="stable")]
                m = prefix_length(n, num, den)
                p = np.empty(m, POSTING)
                p["h"], p["id"], p["n"], p["pos"] = s[:m], k1, n, np.arange(m)
                held.append(p)
                count += m
                if count >= FLUSH_POSTINGS:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    return run


def _may_link(na, ra, nb, rb, num: int, den: int):
    """Whether sizes and the shingles left after the shared one allow the overlap: ceil((na + nb) * num / (num + den))."""
    lo, hi = np.minimum(na, nb), np.maximum(na, nb)
    need = -(-(na + nb) * num // (num + den))
    return (lo * den >= hi * num) & (np.minimum(ra, rb) >= need)


def _index_lists(num: int, den: int):
    """A bucket's postings to star candidates (kind 0) and to its lists of three sets or more, pivot in ``a`` (kind 1)."""
    schema = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("ids", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64())), ("rems", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        p = np.concatenate([np.frombuffer(x.as_buffer(), POSTING) for x in table.column("block")])
        p = p[np.lexsort((p["id"], p["h"]))]
        same_h = np.concatenate([[False], p["h"][1:] == p["h"][:-1]])
        p = p[~(same_h & np.concatenate([[False], p["id"][1:] == p["id"][:-1]]))]  # the same set from several tasks
        starts = np.flatnonzero(np.concatenate([[True], p["h"][1:] != p["h"][:-1]])) if len(p) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(p)))
        keep = np.repeat(sizes > 1, sizes)
        p, sizes = p[keep], sizes[sizes > 1]
        starts = np.cumsum(sizes) - sizes
        n, rem, ids = p["n"].astype(np.int64), (p["n"] - p["pos"]).astype(np.int64), p["id"]
        two = starts[sizes == 2]
        two = two[_may_link(n[two], rem[two], n[two + 1], rem[two + 1], num, den)]
        stars = [np.stack([ids[two], ids[two + 1]], axis=1)]
        lists: dict[bytes, list] = {}
        for s, m in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            key = hashlib.blake2b(ids[s : s + m].tobytes(), digest_size=16).digest()
            if key in lists:  # the same members met by another shingle: the better position counts
                np.maximum(lists[key][2], rem[s : s + m], out=lists[key][2])
            else:
                lists[key] = [ids[s : s + m], n[s : s + m], rem[s : s + m].copy()]
        pivots = []
        for own, size, left in lists.values():
            i = int(np.lexsort((own, size - left))[0])
            other = _may_link(size[i], left[i], size, left, num, den) & (own != own[i])
            stars.append(np.stack([np.minimum(own[other], own[i]), np.maximum(own[other], own[i])], axis=1))
            pivots.append(own[i])
        pairs = np.unique(np.concatenate(stars), axis=0)
        a, b = len(pairs), len(lists)
        wide = [pa.array([None] * a + [x[i] for x in lists.values()], pa.list_(pa.int64())) for i in range(3)]
        return pa.Table.from_arrays([pa.array(np.repeat([0, 1], [a, b]), pa.int8()), pa.array([*pairs[:, 0], *pivots], pa.int64()), pa.array([*pairs[:, 1], *[None] * b], pa.int64()), *wide], schema=schema)

    return run


def _open_pairs(num: int, den: int):
    """Pairs of a list that lie in different components and that positions and computed answers don't rule out.

    A table holds a whole list (lo = hi = 0), or parts ``lo`` and ``hi`` of one, which are compared with each other.
    """
    limit = 1 - num / den + 1e-9

    def run(table: pa.Table) -> pa.Table:
        ids, n, rem, comp, part, lo, hi = (table.column(c).to_numpy() for c in ("id", "n", "rem", "comp", "part", "lo", "hi"))
        dist, across, out = table.column("dist").to_numpy(), lo[0] != hi[0], []
        if (comp != comp[0]).any():
            order = np.argsort(n, kind="stable")
            ids, n, rem, comp, part, dist = ids[order], n[order], rem[order], comp[order], part[order], dist[order]
            cuts = range(0, len(ids), SKIP_BLOCK)
            best = [rem[c : c + SKIP_BLOCK].max() for c in cuts]
            for i, c in enumerate(cuts):
                x = slice(c, c + SKIP_BLOCK)
                for j, d in enumerate(cuts[i:], i):
                    if n[x][-1] * den < n[d] * num:
                        break  # all further blocks hold larger sets
                    if min(best[i], best[j]) < -(-(n[c] + n[d]) * num // (num + den)):
                        continue  # no position in one of the blocks reaches the overlap
                    y = slice(d, d + SKIP_BLOCK)
                    ok = _may_link(n[x][:, None], rem[x][:, None], n[y][None], rem[y][None], num, den) & (comp[x][:, None] != comp[y][None])
                    ok &= ~(np.abs(dist[x][:, None] - dist[y][None]) > limit)  # NaN: unknown
                    if across:  # pairs inside a part meet elsewhere
                        ok &= part[x][:, None] != part[y][None]
                    u, v = np.nonzero(ok)
                    u, v = ids[x][u], ids[y][v]
                    out.append(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1))
        got = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(got[:, 0], pa.int64()), "b": pa.array(got[:, 1], pa.int64())})

    return run


#: Fewest and most flags of the filter on document ids that are read again, 32 for each id in between; what it lets
#: through is joined exactly afterwards. The most take 16 MB.
WANTED_BITS, MOST_WANTED_BITS = 1 << 22, 1 << 27


def _wanted_bitmap(ids: DataFrame, places: int = WANTED_BITS) -> np.ndarray:
    """Packed flags of the hash places that ``doc_id`` takes."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(places)) + 1  # Spark's buckets begin with 1; 0 has one of its own
    rows = ids.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    flags = np.zeros(places // 8, np.uint8)
    for r in rows:
        flags[(r.bucket - 1) * 4096 :][: len(r.bits)] |= np.frombuffer(r.bits, np.uint8)
    return flags


def _rebuild(k: int, flags):
    """(place, text) to (id, set) of the rows whose place is flagged."""

    def run(batches):
        for batch in batches:
            place = batch.column(0).to_numpy()
            part = batch.filter(pa.array((flags.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))
            for lo in range(0, len(part), 256):
                sets = [(set_key(s)[0], s) for s in document_sets(part.column(1).slice(lo, 256), k) if len(s)]
                yield pa.record_batch({"id": pa.array([x[0] for x in sets], pa.int64()), "set": pa.array([x[1].view(np.int64) for x in sets], pa.list_(pa.int64()))})

    return run


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, total) of each pair, on whole sets. Hot ends are left to the skew join."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"), (F.size("sa") + F.size("sb")).cast("long").alias("sizes"))
    return both.select("a", "b", "common", (F.col("sizes") - F.col("common")).alias("total"))


def jaccard_components(df: DataFrame, key: str, text: str, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` of every row; links are den * common >= num * total.

    ``component_id`` is the smallest key reachable by links, the row's own included. A null, empty or blank text has an
    empty set and links with nothing: its component is its own key. Rows of one key with different texts may lie in
    different components; a repeated row gets one result each. A null key is never a component's smallest unless all
    are null. Other columns are not read. An empty table gives an empty result.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(n_bytes, 1) / 6 / 512)), 16, 22))
    levels, n_shingles = shingle_levels(docs, "text", k, bits)
    buckets = max(64, n_shingles * (den - num) // den * POSTING.itemsize >> 23)
    shared = spark.sparkContext.broadcast(levels)  # 2 ** 22 bytes at most
    keys = scratch.materialize(docs.mapInArrow(_set_keys(k), "doc_id long, n long, k1 long, k2 long, bits binary"), "keys")
    index = scratch.materialize(
        docs.select("text").mapInArrow(_postings(shared, bits, k, num, den, buckets), "bucket int, block binary").groupBy("bucket").applyInArrow(_index_lists(num, den), "kind tinyint, a long, b long, ids array<long>, ns array<long>, rems array<long>"), "lists"
    )
    lists = index.where("kind = 1").select(F.xxhash64("ids").alias("list"), F.col("a").alias("pivot"), F.explode(F.arrays_zip("ids", "ns", "rems")).alias("m")).select("list", "pivot", F.col("m.ids").alias("id"), F.col("m.ns").alias("n"), F.col("m.rems").alias("rem"))
    classes = keys.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"))
    bitmaps = keys.where("bits is not null").groupBy("k1").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))

    def possible(pairs: DataFrame) -> DataFrame:
        ends = [bitmaps.select(F.col("k1").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab"]
        both = pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "na", "nb", "bits_a", "bits_b")
        return scratch.materialize(both.mapInArrow(_close_enough(num, den), "a long, b long"), "pairs")

    def sets_of(pairs: DataFrame) -> DataFrame:
        members = scratch.materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
        wanted = classes.join(members.withColumnRenamed("id", "k1"), "k1").select(F.col("first").alias("doc_id"))
        places = int(np.clip(1 << (32 * members.count()).bit_length(), WANTED_BITS, MOST_WANTED_BITS))
        flags = spark.sparkContext.broadcast(_wanted_bitmap(wanted, places))
        place = F.pmod(F.xxhash64("doc_id"), F.lit(places))
        found = docs.select(place, "text").mapInArrow(_rebuild(k, flags), "id long, set array<long>")
        return scratch.materialize(found.join(members, "id", "left_semi").groupBy("id").agg(F.first("set").alias("set")), "sets")

    stars = possible(index.where("kind = 0").select("a", "b").distinct())
    sets = sets_of(stars)
    links = F.col("common") * den >= F.col("total") * num
    answers = scratch.materialize(verified(stars, sets), "answers")
    edges = answers.where(links).select("a", "b")
    roots = scratch.materialize(star_components(edges, "jaccard"), "roots")
    dist = (1 - F.col("common") / F.col("total")).alias("dist")
    told = answers.select(F.col("a").alias("pivot"), F.col("b").alias("id"), dist).union(answers.select(F.col("b").alias("pivot"), F.col("a").alias("id"), dist))
    known = lists.join(roots.withColumnRenamed("root", "comp"), "id", "left").join(told, ["pivot", "id"], "left")
    known = known.select("list", "pivot", "id", "n", "rem", F.coalesce("comp", "id").alias("comp"), F.when(F.col("id") == F.col("pivot"), 0.0).otherwise(F.coalesce("dist", F.lit(float("nan")))).alias("dist"))
    split = known.groupBy("list", "pivot").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.ceil(F.count("*") / LIST_PART).alias("parts")).where("least < most").drop("least", "most")
    place = ["list", "pivot", "lo", "hi"]
    dealt = known.join(split, ["list", "pivot"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("list", "pivot", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "id", "n", "rem", "comp", "dist")
    # a stated number of partitions: comparing is the cost, which the sizes of the rows don't show
    rest = dealt.repartition(buckets, *place).groupBy(*place).applyInArrow(_open_pairs(num, den), "a long, b long").distinct().join(answers.select("a", "b"), ["a", "b"], "left_anti")
    rest = possible(rest)
    more = scratch.materialize(verified(rest, sets_of(rest)).where(links).select("a", "b"), "more")
    over = more.select("a", "b").union(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))
    final = star_components(over, "jaccard").withColumnRenamed("id", "k1")

    placed = classes.join(final, "k1", "left").withColumn("root", F.coalesce("root", "k1"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, "root").select("k1", "k2", "component_id")
    full = keys.where("n > 0").join(named, ["k1", "k2"]).select("doc_id", "n", "component_id")
    empty = keys.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.union(empty).select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
