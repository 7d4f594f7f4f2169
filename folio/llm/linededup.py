"""Cross-site boilerplate lines: removed by their spread over distinct sites, not by raw frequency.

A HyperLogLog sketch of sites for each line hash merges by aggregation. Lines whose estimate is near the threshold get an
exact distinct count. Of each boilerplate line one occurrence stays: the first by document id, text hash and position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: Distinct sites from which a line counts as boilerplate.
MIN_SITES = 10
#: Log2 of the sketch's size; its standard error is about 1.04 / sqrt(2 ** LG_K) = 1.6 %.
LG_K = 12
#: Estimates within this share of the threshold are counted exactly: over ten standard errors.
NEAR = 0.2


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, first) of the lines ``(h, site, place)`` that at least ``min_sites`` distinct non-null sites have."""
    spread = scratch.materialize(
        lines.groupBy("h")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.count("*").alias("n"), F.min("place").alias("first"))
        .where((F.col("n") >= min_sites) & (F.col("sites") >= min_sites * (1 - NEAR)))
        .select("h", "sites", "first"),
        "spread",
    )
    near = spread.where(F.col("sites") < min_sites * (1 + NEAR)).select("h", "first")
    exact = lines.join(near, "h").select("h", "first", "site").distinct().groupBy("h", "first").agg(F.count("site").alias("sites"))
    far = spread.where(F.col("sites") >= min_sites * (1 + NEAR)).select("h", "first")
    return far.union(exact.where(F.col("sites") >= min_sites).select("h", "first"))


def dedup_lines(df: DataFrame, key: str, text: str, site: str, min_sites: int = MIN_SITES) -> DataFrame:
    """``record`` (the row as it was), ``clean``, ``n_lines`` and ``removed`` (positions of lines taken out) of every row.

    A line is a run between line feeds, compared as it is. Lines of white space only are never boilerplate. A null text
    stays null and has no lines; an empty text has one blank line. A null site is no site. Rows with the same key and
    text are one document: they are cut alike, so a first occurrence stays in each of them. No row is dropped: a
    document may end up empty. Columns of any name may be present. An empty table gives an empty result.
    """
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("record"), df[key].alias("k"), F.xxhash64(df[text]).alias("t"))
    lines = (
        df.select(df[key].alias("k"), F.xxhash64(df[text]).alias("t"), df[site].cast("string").alias("site"), F.posexplode(split_lines(df[text])).alias("pos", "line"))
        .where("line rlike '\\\\S'")
        .select("k", "t", "pos", F.xxhash64("line").alias("h"), "site")
    )
    place = F.struct("k", "t", "pos")
    found = scratch.materialize(boilerplate_lines(lines.select("h", "site", place.alias("place")), min_sites), "boilerplate")
    # a common line's rows all meet one row here; the skew join splits them, or the planner broadcasts a small table
    cuts = lines.join(found, "h").where(~place.eqNullSafe(F.col("first"))).groupBy("k", "t").agg(F.collect_set("pos").alias("removed"))
    cuts = cuts.select(F.col("k").alias("ck"), F.col("t").alias("ct"), F.array_sort("removed").alias("removed"))
    joined = rows.join(cuts, F.col("k").eqNullSafe(F.col("ck")) & (F.col("t") == F.col("ct")), "left")
    body = F.col(f"record.`{text}`")
    parts = split_lines(body)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("removed"))
    clean = F.when(F.col("removed").isNull(), body).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    n_lines = F.when(body.isNull(), 0).otherwise(F.size(parts))
    return joined.select("record", clean.alias("clean"), n_lines.alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"), "doc_id", "text", "source")
    return out.select(
        F.col("record.doc_id").alias("doc_id"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"),
        F.sha2(F.coalesce("clean", F.lit("")), 256).alias("clean_sha256"),
    )


OP7_SQL = f"""
with l as (
  select doc_id, source, coalesce(text, '') as text, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
b as (
  select line, min((doc_id, pos)) as first from l
  where regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') group by line having count(distinct source) >= {MIN_SITES}),
m as (
  select l.doc_id, l.pos, l.line, b.first is not null and (l.doc_id, l.pos) <> b.first as cut
  from l left join b on l.line = b.line)
select doc_id, count(*) as n_lines, count(*) filter (cut) as n_removed,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not cut), '')) as clean_sha256
from m group by doc_id
"""
