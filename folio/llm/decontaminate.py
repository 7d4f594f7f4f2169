"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by size. Each is indexed by its smallest hash values (its bottom MinHash signature); the
signature is so long for its partition's largest size that a document which contains the stated share of the item must
contain a signature value, so the search misses nothing. A document probes only partitions whose items can fit in it,
and each candidate is verified on whole sets. Documents are read once for each block of items; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .jaccard import document_sets
from .words import U, iter_word_hashes, shingle_hashes

#: Text bytes of the items that are indexed and broadcast at once; a larger benchmark takes several passes.
BLOCK_BYTES = 32 << 20


def signature_length(n: int, num: int, den: int) -> int:
    """Values of which at least one is shared when ``num / den`` of ``n`` are: what may be missing, and one more."""
    return n - -(-n * num // den) + 1


@dataclass
class ItemIndex:
    """Signature values of one block of items, by size partition."""

    ids: list
    sets: list[np.ndarray]
    num: int
    den: int

    def __post_init__(self):
        sizes = np.array([len(s) for s in self.sets], np.int64)
        part = np.frexp(np.maximum(sizes, 1))[1]  # partition p holds sizes of p bits
        values, owners, least = [], [], []
        for p in np.unique(part[sizes > 0]):
            inside = np.flatnonzero((part == p) & (sizes > 0))
            longest = signature_length(int(sizes[inside].max()), self.num, self.den)
            fits = -(-int(sizes[inside].min()) * self.num // self.den)  # shingles that a document needs to hold any of them
            for i in inside:
                v = self.sets[i][: min(longest, int(sizes[i]))]
                values.append(v)
                owners.append(np.full(len(v), i))
                least.append(np.full(len(v), fits))
        self.values = np.concatenate(values) if values else np.zeros(0, U)
        order = np.argsort(self.values, kind="stable")
        self.values = self.values[order]
        self.owners = np.concatenate(owners)[order] if values else np.zeros(0, np.int64)
        self.least = np.concatenate(least)[order] if values else np.zeros(0, np.int64)
        self.bits = max(16, int(np.ceil(np.log2(max(len(self.values), 1)))) + 6)
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(self.values >> U(64 - self.bits)).astype(np.int64)] = True

    def search(self, texts: pa.Array, k: int) -> list[list[tuple[int, int]]]:
        """(item, shared shingles) of the contained items, for each text."""
        out: list[list[tuple[int, int]]] = []
        for _, _, hashes, counts in iter_word_hashes(texts):
            s, sizes = shingle_hashes(hashes, counts, k)
            base = len(out)
            out += [[] for _ in sizes]
            maybe = np.flatnonzero(self.filter[(s >> U(64 - self.bits)).astype(np.int64)])
            if not len(maybe):
                continue
            ends = np.cumsum(sizes)
            lo, hi = np.searchsorted(self.values, s[maybe], "left"), np.searchsorted(self.values, s[maybe], "right")
            doc = np.repeat(np.searchsorted(ends, maybe, "right"), hi - lo)
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(int((hi - lo).sum()))
            fit = sizes[doc] >= self.least[at]
            for d, i in sorted(set(zip(doc[fit].tolist(), self.owners[at[fit]].tolist(), strict=True))):
                common = int(np.isin(self.sets[i], s[ends[d] - sizes[d] : ends[d]]).sum())
                if common * self.den >= len(self.sets[i]) * self.num:
                    out[base + d].append((i, common))
        return out


def item_blocks(items: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items with a text, cut by a hash into blocks of about ``block_bytes``."""
    rows = items.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _index(block: DataFrame, k: int, num: int, den: int) -> ItemIndex:
    rows = block.collect()  # of a checked size
    sets = list(document_sets(pa.array([r.text for r in rows], pa.string()), k))
    return ItemIndex([r.item_id for r in rows], sets, num, den)


def found_in(block: DataFrame, text: Column, k: int = 5, num: int = 80, den: int = 100) -> Column:
    """Array of (item_id, n_item, n_common) of the block's items that each text contains."""
    index = block.sparkSession.sparkContext.broadcast(_index(block, k, num, den))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_item", pa.int64()), ("n_common", pa.int64())]))

    @F.arrow_udf("array<struct<item_id: bigint, n_item: bigint, n_common: bigint>>")
    def search(texts: pa.Array) -> pa.Array:
        x = index.value
        return pa.array([[{"item_id": x.ids[i], "n_item": len(x.sets[i]), "n_common": c} for i, c in got] for got in x.search(texts, k)], kind)

    return search.asNondeterministic()(text)


def contaminated_pairs(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, item_id, n_item, n_common) where a document holds ``num / den`` of an item's distinct shingles or more.

    Words and shingles are those of the Jaccard join: an item of fewer than ``k`` words is one shingle, its whole
    sequence, which only a text of just these words holds. Null, empty and blank texts contain nothing and are contained
    in nothing. Repeated documents or items give repeated rows. Empty tables give no rows; other columns are not read.
    """
    out = None
    for block in item_blocks(items, item_key, item_text):
        hits = docs.select(F.col(key).alias("doc_id"), F.explode(found_in(block, F.col(text), k, num, den)).alias("hit")).select("doc_id", "hit.*")
        out = hits if out is None else out.union(hits)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose text contains no item, as they are."""
    for block in item_blocks(items, item_key, item_text):
        docs = docs.where(F.size(found_in(block, F.coalesce(F.col(text), F.lit("")), k, num, den)) == 0)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Distinct shingles of (id, text) rows in DuckDB; of fewer than five words the whole sequence.
SHINGLES_SQL = """
  select id, array_to_string(w[i:i + 4], ' ') || repeat(' ', (len(w) < 5)::int) as s
  from (select id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) as i
    from (select id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x20\\x09-\\x0D]+') as w from {rows}))
"""

OP2_SQL = f"""
with i as (select distinct id, s from ({SHINGLES_SQL.format(rows="(select item_id as id, text from benchmark)")})),
n as (select id, count(*) as n_item from i group by id),
d as (select distinct id, s from ({SHINGLES_SQL.format(rows="(select doc_id as id, text from documents)")}))
select d.id as doc_id, i.id as item_id, n_item, count(*) as n_common
from d join i on d.s = i.s join n on n.id = i.id
group by d.id, i.id, n_item having 100 * count(*) >= 80 * n_item
"""
