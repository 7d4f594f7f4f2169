"""Review events, status views, assignments, queues and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.operators.guards import last_wins


def latest_status(events: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Current state by key from the append-only log."""
    return last_wins(events, keys, *[F.col(c) for c in order])


def undo_target(events: DataFrame, actor: str, reversible: Column, *order: str) -> DataFrame:
    """The event that an undo of each actor reverts: the latest reversible one."""
    return last_wins(events.where(reversible), [actor], *[F.col(c) for c in order])


def gap_sessions(events: DataFrame, key: str, ts: str, tie: str, gap_seconds: int) -> DataFrame:
    """Runs of heartbeats with no longer gap between neighbours: a gap starts the next run."""
    by_time = W.partitionBy(key).orderBy(ts, tie)
    late = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(by_time).cast("timestamp")) > gap_seconds * 1_000_000
    numbered = events.withColumn("session", F.sum(F.coalesce(late, F.lit(False)).cast("int")).over(by_time.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("beats"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def ready_tasks(tasks: DataFrame, depends: DataFrame, key: str, status: str) -> DataFrame:
    """Pending tasks whose dependencies are all done; ``depends`` has (key, needs). An unknown dependency blocks."""
    state = tasks.select(F.col(key).alias("needs"), F.col(status).alias("_s"))
    blocked = depends.join(state, "needs", "left").where(F.col("_s").isNull() | (F.col("_s") != "done")).select(key).distinct()
    return tasks.where(F.col(status) == "pending").join(blocked, key, "left_anti")


def assignment_progress(assignments: DataFrame, members: DataFrame, reviews: DataFrame, key: str, item: str, status: str) -> DataFrame:
    """Members of each assignment by review status; an unreviewed one is open."""
    rows = assignments.join(members, key, "left").join(reviews, item, "left")
    s = F.col(status)
    return rows.groupBy(key).agg(
        F.count(item).alias("total"), F.count_if(s == "kept").alias("kept"), F.count_if(s == "edited").alias("edited"), F.count_if(s == "deleted").alias("deleted"), F.count_if(F.col(item).isNotNull() & s.isNull()).alias("open")
    )


def reviewer_progress(users: DataFrame, assignments: DataFrame, reviews: DataFrame, user: str, item: str, status: str, at: str) -> DataFrame:
    """Distinct items of each reviewer by status, and the last activity; a reviewer without any shows zeros."""
    rows = users.join(assignments, user, "left").join(reviews, item, "left")
    of = lambda v: F.count_distinct(F.when(F.col(status) == v, F.col(item)))
    return rows.groupBy(user).agg(F.count_distinct(item).alias("assigned"), of("kept").alias("kept"), of("edited").alias("edited"), of("deleted").alias("deleted"), F.max(at).alias("last_at"))


def assignment_conflicts(members: DataFrame, assignment: str, item: str) -> DataFrame:
    """Items that more than one assignment has, with the first two."""
    return members.groupBy(item).agg(F.count_distinct(assignment).alias("n"), F.min(assignment).alias("first"), F.max(assignment).alias("last")).where("n > 1")


def admit(tasks: DataFrame, resource: str, caps: dict[str, int], *order: Column) -> DataFrame:
    """Tasks that start now: the first of each resource class up to its cap."""
    cap = F.coalesce(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col(resource)], F.lit(0))
    return tasks.withColumn("turn", F.row_number().over(W.partitionBy(resource).orderBy(*order))).where(F.col("turn") <= cap)


def apply_fixes(items: DataFrame, reviews: DataFrame, key: str, fields: list[str], decision: str = "decision") -> DataFrame:
    """Items with the non-blank corrections of FIX reviews, and the names of changed fields."""
    joined = items.join(reviews.select(key, decision, *[F.col(f"corrected_{f}") for f in fields]), key, "left")
    fix = F.coalesce(F.col(decision) == "FIX", F.lit(False))
    given = {f: F.nullif(F.trim(F.col(f"corrected_{f}")), F.lit("")) for f in fields}
    changed = F.array_compact(F.array(*[F.when(fix & given[f].isNotNull() & ~given[f].eqNullSafe(F.col(f)), f) for f in fields]))
    out = joined.withColumn("changed", changed)
    for f in fields:
        out = out.withColumn(f, F.when(fix, F.coalesce(given[f], F.col(f))).otherwise(F.col(f)))
    return out.drop(decision, *[f"corrected_{f}" for f in fields])


def field_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after) of the fields that differ; nulls are equal to nulls."""
    a = before.select(key, *[F.col(f).cast("string").alias(f"_b_{f}") for f in fields])
    b = after.select(key, *[F.col(f).cast("string").alias(f"_a_{f}") for f in fields])
    each = F.array_compact(F.array(*[F.when(~F.col(f"_b_{f}").eqNullSafe(F.col(f"_a_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"_b_{f}").alias("before"), F.col(f"_a_{f}").alias("after"))) for f in fields]))
    return a.join(b, key).select(key, F.explode(each).alias("c")).select(key, "c.*")


def memoized(requests: DataFrame, cache: DataFrame, key: str, verdict: str) -> DataFrame:
    """Requests with their recorded verdict, or null where one must still be made. A conflicting cache fails the job."""
    distinct = cache.groupBy(key).agg(F.min(verdict).alias(verdict), F.count_distinct(verdict).alias("_n"))
    sure = distinct.select(key, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("conflicting verdicts for "), F.col(key)))).otherwise(F.col(verdict)).alias(verdict))
    return requests.join(sure, key, "left")


def lease_state(claims: DataFrame, now: Column, updated: str, failures: str, timeout: int, most: int) -> DataFrame:
    """claimed, stale, retryable or quarantined for each claim."""
    age = now - F.col(updated)
    state = F.when(F.col(failures) >= most, "quarantined").when(age > timeout, "stale").when(F.col(failures) > 0, "retryable").otherwise("claimed")
    return claims.withColumn("state", state)


def asset_aliases(files: DataFrame, content_hash: str, path: str, *preference: Column) -> DataFrame:
    """One asset for each content: its preferred path, and the others as sorted aliases."""
    return files.groupBy(content_hash).agg(F.min_by(path, F.struct(*preference, F.col(path))).alias("preferred"), F.array_sort(F.collect_list(path)).alias("paths"), F.count("*").alias("copies"))
