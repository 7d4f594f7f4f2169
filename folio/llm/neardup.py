"""Embedding near-duplicates by NN-descent.

Equal vectors are one node. A neighbour graph starts from vectors that lie near one another in the order of random
hyperplane codes, and is refined by joins of neighbours with neighbours' neighbours. Lists that are full of links are
enlarged to their whole component: the next round's lists hold nodes of other components only, and rounds go on while a
list holds nothing but links. Components are compared in blocks, so link counts are exact inside one. Recall is audited
by brute force: the vectors whose ids are divisible by 20, and in later rounds those of the next remainders, against all
rows, in blocks; what the audit finds is added, and rounds go on until a fresh audit finds enough and a round's own joins have run dry. If they never do, the
query fails. Edges of at least the threshold in double precision are kept.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch
from .components import star_components

#: Neighbours of other components kept for each node while the graph is refined.
LIST = 8
#: Codes drawn for each round of the start, and rows of the sorted order that are compared with one another.
TABLES, WINDOW = 8, 256
#: Neighbours that one comparison proposes for a node.
PROPOSED = 4
#: Most rows of a component on either side of one block comparison, and most neighbours joined at one node at once.
BLOCK, JOINED = 2048, 48
TARGET_RECALL, MOST_ROUNDS = 0.995, 5
#: A round's audit takes as queries the vectors whose id leaves the round's number as remainder by this; in blocks of so
#: many bytes, each searched in slices of so many rows.
AUDIT_STEP, AUDIT_BYTES, AUDIT_ROWS = 20, 8 << 20, 1024

EDGE = "u long, v long, s double"


def _nodes(batches):
    """(vec_id, embedding) to (vec_id, node key, unit vector); a vector without a direction has null key and unit."""
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        k1, k2, units = [], [], []
        values, offsets = column.values, column.offsets.to_numpy() if len(column) else np.zeros(1, int)
        flat = values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
        null = column.is_null().to_numpy(zero_copy_only=False)
        for i in range(len(column)):
            x = flat[offsets[i] : offsets[i + 1]]
            top = np.abs(x).max() if not null[i] and len(x) else 0.0
            if not np.isfinite(top) or top == 0:
                k1.append(None), k2.append(None), units.append(None)
                continue
            d = hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest()
            x = x / top  # no overflow or underflow in the norm
            k1.append(int.from_bytes(d[:8], "little", signed=True))
            k2.append(int.from_bytes(d[8:], "little", signed=True))
            units.append((x / np.linalg.norm(x)).tobytes())
        yield pa.record_batch({"vec_id": ids.cast(pa.int64()), "k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()), "unit": pa.array(units, pa.binary())})


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.float64).reshape(len(column), -1)


def _codes(seed: int):
    """(node, root, unit) to (dim, table, code, node, root, unit): the code of a table are the sides of 62 random hyperplanes."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.array([len(x.as_buffer()) // 8 for x in batch.column(2)], int)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng(seed).standard_normal((dim, TABLES * 62))
                sides = (_matrix(part.column(2)) @ planes[dim] > 0).reshape(len(part), TABLES, 62)
                codes = sides @ (1 << np.arange(61, -1, -1, dtype=np.int64))
                for t in range(TABLES):
                    yield pa.record_batch({"dim": pa.array(np.full(len(part), dim), pa.int32()), "table": pa.array(np.full(len(part), t), pa.int32()), "code": pa.array(codes[:, t], pa.int64()), "node": part.column(0), "root": part.column(1), "unit": part.column(2)})

    return run


def _best(s: np.ndarray, rows: np.ndarray, cols: np.ndarray, row_roots: np.ndarray, col_roots: np.ndarray):
    """The PROPOSED best columns of each row of ``s`` (its own component excluded), as edges."""
    s = np.where(row_roots[:, None] == col_roots[None], -2.0, s)
    k = min(PROPOSED, s.shape[1])
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    u, v, w = np.repeat(rows, k), cols[at].ravel(), np.take_along_axis(s, at, axis=1).ravel()
    keep = w > -1.5
    return u[keep], v[keep], w[keep]


def _edges(parts) -> pa.RecordBatch:
    u, v, s = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "s": pa.array(s, pa.float64())})


def _windows(batches):
    """Rows in the order of their codes: each is compared with its window and the one before."""
    held: tuple | None = None  # dim and table, nodes, roots, matrix of the window before
    for batch in batches:
        for lo in range(0, len(batch), WINDOW):
            part = batch.slice(lo, WINDOW)
            dims, tables = part.column(0).to_numpy(), part.column(1).to_numpy()
            parts = []
            cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(tables) != 0)) + 1
            for rows in np.split(np.arange(len(part)), cuts):
                own = part.slice(rows[0], len(rows))
                nodes, roots, x = own.column(3).to_numpy(), own.column(4).to_numpy(), _matrix(own.column(5))
                key = (dims[rows[0]], tables[rows[0]])
                cols, col_roots, y = (np.concatenate(c) for c in zip(held[1:], (nodes, roots, x), strict=True)) if held and held[0] == key else (nodes, roots, x)
                s = x @ y.T
                parts.append(_best(s, nodes, cols, roots, col_roots))
                if len(cols) > len(nodes):
                    parts.append(_best(s[:, : len(cols) - len(nodes)].T, held[1], nodes, held[2], roots))
                held = (key, nodes, roots, x)
            yield _edges(parts)


def _local_joins(table: pa.Table) -> pa.Table:
    """Of a bucket of (center, chunk, node, root, unit): the best edges among the members that share a center."""
    table = table.sort_by([("center", "ascending"), ("chunk", "ascending"), ("node", "ascending")])
    center, chunk, node, root = (table.column(c).to_numpy() for c in ("center", "chunk", "node", "root"))
    units = table.column("unit").combine_chunks()
    parts = []
    for rows in np.split(np.arange(len(node)), np.flatnonzero((np.diff(center) != 0) | (np.diff(chunk) != 0)) + 1):
        if len(rows) > 1:
            x = _matrix(units.slice(rows[0], len(rows)))
            parts.append(_best(x @ x.T, node[rows], node[rows], root[rows], root[rows]))
    return pa.Table.from_batches([_edges(parts)])


def best_lists(edges: DataFrame) -> DataFrame:
    """The LIST best neighbours of each node; ties go to the smaller node."""
    best = W.partitionBy("u").orderBy(F.desc("s"), "v")
    once = edges.groupBy("u", "v").agg(F.max("s").alias("s"))
    return once.withColumn("r", F.row_number().over(best)).where(F.col("r") <= LIST).drop("r")


def outside(lists: DataFrame, members: DataFrame) -> DataFrame:
    """The edges of ``lists`` that lead to another component of ``members(node, root)``."""
    ends = [members.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "uv"]
    return lists.join(ends[0], "u").join(ends[1], "v").where("root_u <> root_v").select("u", "v", "s")


def refine(lists: DataFrame, nodes: DataFrame, buckets: int) -> DataFrame:
    """One round of NN-descent: members of a node's forward and reverse list are compared with one another.

    A node with many reverse neighbours has them dealt into chunks, so none is dropped.
    """
    members = lists.select(F.col("u").alias("center"), F.col("v").alias("node")).union(lists.select(F.col("v").alias("center"), F.col("u").alias("node"))).distinct()
    many = members.groupBy("center").agg(F.count("*").alias("d")).where(F.col("d") > JOINED)
    chunk = F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("d") / (JOINED // 2))), F.lit(0)).cast("int")
    dealt = members.join(many, "center", "left").select("center", chunk.alias("chunk"), "node")
    full = dealt.join(nodes.select("node", "root", "unit"), "node").withColumn("bucket", F.pmod(F.xxhash64("center", "chunk"), F.lit(buckets)))
    found = full.groupBy("bucket").applyInArrow(lambda t: _local_joins(t), EDGE)
    return best_lists(lists.union(found))


def _block_counts(threshold: float):
    """(node, links) of left rows against right rows of each block pair; ``copies`` of the right row count."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("root", "ascending"), ("i", "ascending"), ("j", "ascending"), ("side", "ascending"), ("node", "ascending")])
        root, i, j, side, node, copies = (table.column(c).to_numpy() for c in ("root", "i", "j", "side", "node", "copies"))
        units, out = table.column("unit").combine_chunks(), []
        for rows in np.split(np.arange(len(node)), np.flatnonzero((np.diff(root) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1):
            x = _matrix(units.slice(rows[0], len(rows)))
            left, right = rows[side[rows] == 0], rows[side[rows] == 1]
            near = x[left - rows[0]] @ x[right - rows[0]].T >= threshold
            near &= node[left][:, None] != node[right][None]
            out.append((node[left], near @ copies[right]))
        u, n = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"node": pa.array(u, pa.int64()), "links": pa.array(n, pa.int64())})

    return run


def count_links(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links) for ``members(root, node, copies, unit)``: linked rows of other nodes in the same component.

    A component of more than BLOCK nodes is cut into blocks by a hash, and every pair of blocks is one comparison.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("nb"))
    rows = members.join(sizes, "root").withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))
    left = rows.select("root", "nb", F.col("b").alias("i"), other.alias("j"), F.lit(0).alias("side"), "node", "copies", "unit")
    right = rows.select("root", "nb", other.alias("i"), F.col("b").alias("j"), F.lit(1).alias("side"), "node", "copies", "unit")
    # small components share a group; each block pair of a large one has its own
    place = F.when(F.col("nb") == 1, F.struct(F.pmod(F.xxhash64("root"), F.lit(256)).alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("c"))).otherwise(F.struct(F.col("root").alias("a"), F.col("i").alias("b"), F.col("j").alias("c")))
    return left.union(right).withColumn("place", place).groupBy("place").applyInArrow(_block_counts(threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _search(shared, threshold: float):
    """Rows (node, root, unit) against a block of queries: (a, b) of missed links, and a query's counts without b."""

    def run(batches):
        by_dim: dict[int, tuple] = {}
        for size in {len(u) for _, _, u in shared.value}:
            own = [(n, r, np.frombuffer(u)) for n, r, u in shared.value if len(u) == size]
            by_dim[size] = (*(np.array([x[i] for x in own], np.int64) for i in (0, 1)), np.stack([x[2] for x in own]), np.zeros((2, len(own)), np.int64))
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) for x in batch.column(2)], int)
            for size in by_dim.keys() & set(sizes.tolist()):
                part = batch.filter(pa.array(sizes == size))
                qn, qr, q, counts = by_dim[size]
                for lo in range(0, len(part), AUDIT_ROWS):
                    rows = part.slice(lo, AUDIT_ROWS)
                    node, root = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                    a, b = np.nonzero(q @ _matrix(rows.column(2)).T >= threshold)
                    other = qn[a] != node[b]
                    a, b = a[other], b[other]
                    lost = qr[a] != root[b]
                    counts += np.stack([np.bincount(x, minlength=len(qn)) for x in (a, a[lost])])
                    if lost.any():
                        none = np.zeros(int(lost.sum()), np.int64)
                        yield pa.record_batch({"a": pa.array(qn[a[lost]]), "b": pa.array(node[b[lost]]), "root": pa.array(qr[a[lost]]), "true": pa.array(none), "missed": pa.array(none)})
        for qn, qr, _, (true, lost) in by_dim.values():
            some = true > 0
            yield pa.record_batch({"a": pa.array(qn[some]), "b": pa.array([None] * int(some.sum()), pa.int64()), "root": pa.array(qr[some]), "true": pa.array(true[some]), "missed": pa.array(lost[some])})

    return run


def audit(members: DataFrame, threshold: float, round_: int) -> tuple[float, DataFrame]:
    """Mean recall of "linked rows share a component" over components with queries that have links, and the missed links.

    Queries of ``members(node, first, root, unit)`` are those whose ``first`` has the round's remainder. A component's
    recall is the mean of its queries', so a large group counts once.
    """
    spark = members.sparkSession
    queries = scratch.materialize(members.where(F.pmod(F.coalesce("first", F.lit(0)), F.lit(AUDIT_STEP)) == round_ % AUDIT_STEP).select("node", "root", "unit"), "queries")
    blocks = -(-(queries.agg(F.sum(F.octet_length("unit"))).first()[0] or 0) // AUDIT_BYTES)
    found = None
    for i in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == i).collect()  # of a checked size
        shared = spark.sparkContext.broadcast([(r.node, r.root, bytes(r.unit)) for r in block])
        part = members.select("node", "root", "unit").mapInArrow(_search(shared, threshold), "a long, b long, root long, true long, missed long")
        part = scratch.materialize(part, "audit")
        found = part if found is None else found.union(part)
    if found is None:
        return 1.0, spark.createDataFrame([], "a long, b long")
    each = found.where("b is null").groupBy("root", "a").agg((1 - F.sum("missed") / F.sum("true")).alias("recall"))
    recall = each.groupBy("root").agg(F.avg("recall").alias("recall")).agg(F.avg("recall")).first()[0]
    return 1.0 if recall is None else recall, found.where("b is not null").select("a", "b")


def near_duplicates(df: DataFrame, key: str, vector: str, threshold: float = 0.9, seed: int = 5) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of every row.

    ``n_links`` counts other rows of cosine >= ``threshold`` in double precision; ``component_id`` is the smallest key
    reachable by links, the own included. Null, empty and zero vectors and such with null or non-finite components link
    with nothing, vectors of different length not with one another. Equal vectors are always linked. Repeated rows
    count as rows; a null key is never a component's smallest unless all are null. An empty table gives an empty
    result; other columns are not read.
    """
    spark = df.sparkSession
    rows = scratch.materialize(df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>")).mapInArrow(_nodes, "vec_id long, k1 long, k2 long, unit binary"), "vectors")
    classes = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    nodes = scratch.materialize(classes.withColumnRenamed("k1", "node"), "nodes")
    n = nodes.count()
    parts = max(spark.sparkContext.defaultParallelism, n * TABLES // 50_000)
    links = scratch.materialize(spark.createDataFrame([], "a long, b long"), "links")
    left = n  # components before a round
    members, lists = scratch.materialize(nodes.withColumn("root", F.col("node")), "members"), None
    for round_ in itertools.count():
        coded = members.select("node", "root", "unit").mapInArrow(_codes(seed + round_), "dim int, table int, code long, node long, root long, unit binary")
        ordered = coded.repartitionByRange(parts, "dim", "table", "code", "node").sortWithinPartitions("dim", "table", "code", "node")
        near = ordered.mapInArrow(_windows, EDGE)
        lists = scratch.materialize(best_lists(near if lists is None else near.union(outside(lists, members))), "neighbours")
        lists = scratch.materialize(refine(lists, members, max(64, n * LIST // 8_000)), "neighbours")
        full = lists.groupBy("u").agg(F.min("s").alias("s")).where(F.col("s") >= threshold).limit(1).count()
        links = links.union(lists.where(F.col("s") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b")))
        roots = star_components(links, "near")
        members = scratch.materialize(nodes.join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node")), "members")
        before, left = left, members.agg(F.count_distinct("root")).first()[0]
        recall, missed = audit(members, threshold, round_)
        if recall < 1.0:
            links = links.union(missed)
            roots = star_components(links, "near")
            members = scratch.materialize(nodes.join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node")), "members")
        # a list of links only may hide more; each such round joins components, so they end
        if not full:
            dry = before - left <= (1 - TARGET_RECALL) * (n - left)
            if recall >= TARGET_RECALL and dry:
                break
            if round_ + 1 >= MOST_ROUNDS:
                raise RuntimeError(f"near duplicates: recall {recall:.4f} of a fresh audit and {before - left} of {n - left} joins new after {round_ + 1} rounds")
        left = members.agg(F.count_distinct("root")).first()[0]
    together = members.join(members.groupBy("root").agg(F.count("*").alias("size")).where("size > 1").select("root"), "root", "left_semi")
    counts = count_links(together.select("root", "node", "copies", "unit"), threshold)
    smallest = members.groupBy("root").agg(F.min("first").alias("component_id"))
    named = members.join(smallest, "root").join(counts, "node", "left").select(F.col("node").alias("k1"), "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = rows.where("k1 is not null").select("vec_id", "k1", "k2").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select(F.col("vec_id").alias(key), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


OP6_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select vec_id as id, vec_id as root from v union select l.b, r.root from r join l on r.id = l.a),
c as (select id, min(root) as component_id from r group by id),
n as (select a, count(*) as n from l group by a)
select vec_id, coalesce(n.n, 0) as n_links, component_id, vec_id = component_id as kept
from v join c on c.id = v.vec_id left join n on n.a = v.vec_id
"""
