"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Links that one task may finish: 16 MB of them. More are reduced by distributed steps first, to the same roots.
LOCAL_LINKS = 1_000_000


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the smallest id that each is linked with: labels fall to the neighbours' minimum, pointers are doubled."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, label[side], low)  # hook the whole tree
            np.minimum.at(new, side, low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def _finish(batches):
    tables = [b for b in batches if len(b)]
    if tables:
        t = pa.Table.from_batches(tables)
        ids, roots = _roots(t.column(0).to_numpy(), t.column(1).to_numpy())
        yield pa.record_batch({"id": pa.array(ids, pa.int64()), "root": pa.array(roots, pa.int64())})


def _star_step(cur: DataFrame) -> DataFrame:
    both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # the neighbours of u are all smaller here
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(least.select("u", F.col("m").alias("v"))).distinct()


def star_components(edges: DataFrame, name: str = "components", local_links: int | None = None) -> DataFrame:
    """``(id, root)`` for every id in ``edges(a, b)``: ``root`` is the smallest id that links lead to.

    A counted, small enough table is finished in one task. A larger one takes star steps until it is small enough or
    every id points at its root: each step is a grouped minimum (combined before the shuffle) and a join on the node,
    written to the shared folder, and their number is logarithmic in practice. Self links, repeated links and either
    direction are accepted; rows with a null end are no links. No links give an empty table.
    """
    most = LOCAL_LINKS if local_links is None else local_links
    stats = lambda x: tuple(x.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
    links = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    cur = scratch.materialize(links.distinct(), name)
    seen = stats(cur)
    while True:
        if seen[0] <= most:
            return scratch.materialize(cur.coalesce(1).mapInArrow(_finish, "id long, root long"), name)
        cur, before = scratch.materialize(_star_step(cur), name), seen
        seen = stats(cur)
        if seen == before:
            roots = cur.select(F.col("u").alias("id"), F.col("v").alias("root"))
            return roots.union(roots.select(F.col("root").alias("id"), "root").distinct())
