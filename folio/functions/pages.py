"""Page sets: canonical form, agreement with gold, spans, ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text


def canonical_pages(pages: Column) -> Column:
    """Sorted distinct positive pages; null stays null."""
    return F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.isNotNull() & (p >= 1))))


def pages_in_text(c: Column) -> Column:
    """Labelled pages first, then bare numbers of up to four digits; distinct, in order."""
    labelled = F.regexp_extract_all(text(c), F.lit(r"(?i)(?:PDF_PAGE_|PAGE_|Page\s*[:=]?\s*)([0-9]+)"), 1)
    bare = F.regexp_extract_all(text(c), F.lit(r"(?<![A-Za-z0-9_.-])([0-9]{1,4})(?![A-Za-z0-9_.-])"), 1)
    return F.array_distinct(F.filter(F.transform(F.concat(labelled, bare), lambda x: x.try_cast("int")), lambda p: p > 0))


def page_agreement(gold: Column, predicted: Column) -> Column:
    """Struct (precision, recall, f1, exact, common) of two page sets: both empty 1, one empty 0."""
    g, p = (F.array_distinct(F.coalesce(x, F.array().cast("array<int>"))) for x in (gold, predicted))
    n = F.size(F.array_intersect(g, p)).cast("double")
    both = (F.size(g) == 0) & (F.size(p) == 0)
    share = lambda d: F.when(both, 1.0).otherwise(F.coalesce(F.try_divide(n, d), F.lit(0.0)))
    return F.struct(
        share(F.size(p)).alias("precision"),
        share(F.size(g)).alias("recall"),
        F.when(both, 1.0).otherwise(F.coalesce(F.try_divide(2 * n, F.size(g) + F.size(p)), F.lit(0.0))).alias("f1"),
        ((F.size(g) == n) & (F.size(p) == n)).cast("int").alias("exact"),
        n.cast("int").alias("common"),
    )


def evidence_span(pages: Column) -> Column:
    return F.coalesce(F.array_max(pages) - F.array_min(pages), F.lit(0))


def leave_one_out(pages: Column) -> Column:
    """One struct (dropped, kept) for each page of a set of two or more."""
    each = F.transform(pages, lambda p: F.struct(p.alias("dropped"), F.array_remove(pages, p).alias("kept")))
    return F.when(F.size(pages) >= 2, each).otherwise(F.slice(each, 1, 0))


def neighbourhood(pages: Column, k: int, first: Column, last: Column) -> Column:
    """Pages within ``k`` of a cited one, clipped to a range."""
    near = F.flatten(F.transform(pages, lambda p: F.sequence(F.greatest(p - k, first), F.greatest(F.least(p + k, last), F.greatest(p - k, first)))))
    return F.array_sort(F.array_distinct(F.filter(near, lambda p: (p >= first) & (p <= last))))
