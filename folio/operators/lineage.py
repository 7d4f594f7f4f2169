"""Lineage, page plans, dataset construction and release operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.pages import canonical_pages
from folio.operators.guards import range_lookup, require_known


def restore_pages(derived: DataFrame, sources: DataFrame, key: str, source_keys: str, source_key: str, pages: str) -> DataFrame:
    """Derived items with the sorted union of their sources' pages; a dangling reference fails the job."""
    refs = derived.select(key, F.explode(source_keys).alias(source_key))
    known = require_known(refs, sources, source_key)
    union = known.join(sources.select(source_key, pages), source_key).groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pages)))).alias(pages))
    return derived.join(union, key, "left")


def documents_of_pages(items: DataFrame, ranges: DataFrame, key: str, bundle: str, pages: str, start: str, end: str, document: str) -> DataFrame:
    """Items with the sorted documents that their pages lie in; a page in none or several documents fails the job."""
    each = items.select(key, bundle, F.explode(pages).alias("_page"))
    found = range_lookup(each, ranges.select(bundle, start, end, document), bundle, "_page", start, end, "left")
    per_page = found.groupBy(key, "_page").agg(F.count(document).alias("_n"), F.min(document).alias(document))
    one = per_page.select(key, F.when(F.col("_n") != 1, F.raise_error(F.concat(F.lit("page in "), F.col("_n").cast("string"), F.lit(" documents")))).otherwise(F.col(document)).alias(document))
    return items.join(one.groupBy(key).agg(F.array_sort(F.collect_set(document)).alias("documents")), key, "left")


def count_mapped(cited: DataFrame, ranges: DataFrame, bundle: str, item: str, page: str, start: str, end: str, document: str) -> DataFrame:
    """Distinct documents, pages, and pages without a document of each item of a bundle; pages may lie in several documents.

    Only the distinct pages of a bundle are looked up. A page counts in the first of its documents, a null one before the
    others, so that one distinct aggregate is enough.
    """
    asked = cited.select(bundle, F.coalesce(page, F.lit(0)).alias(page)).distinct()  # not null: without a filter, both uses of ``cited`` share its shuffles
    docs = range_lookup(asked, ranges.select(bundle, start, end, document), bundle, page, start, end).select(bundle, page, document).distinct()
    docs = docs.withColumn("_first", F.row_number().over(W.partitionBy(bundle, page).orderBy(F.col(document).asc_nulls_first())) == 1)
    each = cited.select(bundle, item, page).join(docs, [bundle, page], "left").groupBy(bundle, item, page, document).agg(F.any_value("_first").alias("_first"))
    pages = F.count(F.when(F.coalesce("_first", F.lit(True)), F.col(page)))
    return each.groupBy(bundle, item).agg(F.count_distinct(document).alias("docs"), pages.alias("pages"), F.count(F.when(F.col(document).isNull(), F.col(page))).alias("unmapped"))


def bundle_plan(members: DataFrame, bundle: str, order: str, size: str) -> DataFrame:
    """Bundle manifest: ordered sources with first and last merged page, one row a bundle."""
    upto = W.partitionBy(bundle).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = members.withColumn("_end", F.sum(size).over(upto)).withColumn("_n", F.row_number().over(W.partitionBy(bundle).orderBy(order)))
    source = F.struct(F.col("_n").alias("doc_number"), F.col(order).alias("paper_id"), (F.col("_end") - F.col(size) + 1).alias("merged_start_page"), F.col("_end").alias("merged_end_page"), F.col(size).alias("source_page_count"))
    return rows.groupBy(bundle).agg(F.array_sort(F.collect_list(source)).alias("sources"), F.sum(size).alias("page_count"))


def source_rows(manifest: DataFrame, bundle: str) -> DataFrame:
    """Manifest rows to one row a source."""
    return manifest.select(bundle, F.explode("sources").alias("s")).select(bundle, "s.*")


def per_item_page_plan(items: DataFrame, pages: str, page_count: str) -> DataFrame:
    """Pages to show for each item: its own, or the whole document when it has none."""
    own = canonical_pages(F.coalesce(F.col(pages), F.array().cast("array<int>")))
    return items.withColumn("plan", F.when(F.size(own) > 0, own).otherwise(F.sequence(F.lit(1), F.col(page_count).cast("int"))))


def separated_pages(pages: Column, least_gap: int) -> Column:
    """Whether two pages lie at least that far apart, and the widest pair."""
    low, high = F.array_min(pages), F.array_max(pages)
    return F.struct((F.coalesce(high - low, F.lit(0)) >= least_gap).alias("separated"), low.alias("first"), high.alias("last"))


def rotation_choice(suffix: Column, round_: Column, cycle: list[str], supported: Column) -> Column:
    """First supported entry of a cycle that starts at (suffix + round) mod its length."""
    n = len(cycle)
    start = F.pmod(suffix + round_, F.lit(n))
    turned = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(F.array(*[F.lit(x) for x in cycle]), (F.pmod(start + i, F.lit(n)) + 1).cast("int")))
    return F.get(F.filter(turned, lambda x: F.array_contains(supported, x)), F.lit(0))


def release_ids(rows: DataFrame, prefix: str, key: str, *order: Column) -> DataFrame:
    """Content-derived ids and ranks of released rows."""
    ident = F.concat(F.lit(prefix), F.left(F.sha2(F.col(key), 256), F.lit(16)))
    return rows.withColumn("release_id", ident).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def audit_attempts(rows: DataFrame, attempts: str) -> DataFrame:
    """Rows with codes of their attempt log: numbers run from 1, hashes fit, nothing follows a legal attempt.

    ``attempts`` is an array of (number, raw, sha256, legal).
    """
    a = F.col(attempts)
    numbered = F.forall(F.transform(a, lambda x, i: x["number"] == i + 1), lambda x: x)
    hashed = F.forall(a, lambda x: F.sha2(x["raw"], 256) == x["sha256"])
    early = F.exists(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x: x["legal"])
    found = F.array_compact(F.array(F.when(F.size(a) == 0, "no_attempts"), F.when(~numbered, "attempt_numbers"), F.when(~hashed, "raw_hash"), F.when(early, "attempt_after_legal")))
    return rows.withColumn("codes", found)


def semantic_groups(facts: DataFrame, group: str, key: str, terms: str, least_shared: int, limit: int) -> DataFrame:
    """Connected pairs and triples of facts of one paper that share enough terms, best first, ``limit`` a paper.

    Pairs come from an inverted index of terms; a triple is a pair extended by a fact that a member shares terms with.
    """
    rows = facts.select(group, key, F.explode(F.array_distinct(terms)).alias("term"))
    a, b = rows.withColumnRenamed(key, "a"), rows.withColumnRenamed(key, "b")
    pairs = a.join(b, [group, "term"]).where("a < b").groupBy(group, "a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least_shared)
    links = pairs.select(group, "a", "b", "shared").union(pairs.select(group, F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    middle = links.select(group, F.col("a").alias("m"), F.col("b").alias("x"), F.col("shared").alias("s1"))
    other = links.select(group, F.col("a").alias("m"), F.col("b").alias("y"), F.col("shared").alias("s2"))
    triples = middle.join(other, [group, "m"]).where("x < y").select(group, F.array_sort(F.array("m", "x", "y")).alias("members"), (F.col("s1") + F.col("s2")).alias("shared")).groupBy(group, "members").agg(F.max("shared").alias("shared"))
    twos = pairs.select(group, F.array("a", "b").alias("members"), "shared")
    best = W.partitionBy(group).orderBy(F.desc("shared"), F.size("members"), "members")
    return triples.unionByName(twos).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
