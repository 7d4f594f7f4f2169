"""Relational state of a review service: sessions, assignments, deletions, logs and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import text

# Lanes of batch tasks, and marks of a command that needs one.
LANES = ("cpu", "gpu", "gpu_high_vram")
HIGH_MEMORY_MARKS = ("high_vram",)
GPU_MARKS = ("--gpu", "gpu_queue", "ablation")


def live_users(sessions: DataFrame, users: DataFrame, user: str, now: Column) -> DataFrame:
    """Users of the sessions that have not run out, with the session's own columns."""
    return sessions.where(F.col("expires") > now).join(users, user)


def insert_assignments(current: DataFrame, wanted: DataFrame, owner: str, group: str) -> DataFrame:
    """Outcome of each wanted assignment ``(owner, group, first, last)``: conflict if another owner holds a position of
    its group that it covers, else inserted."""
    held = current.select(F.col(group), F.col(owner).alias("_owner"), F.col("first").alias("_a"), F.col("last").alias("_b"))
    clash = (wanted[group] == held[group]) & (wanted[owner] != held["_owner"]) & (wanted["first"] <= held["_b"]) & (wanted["last"] >= held["_a"])
    lost = wanted.join(held, clash, "left_semi").select(owner, group, "first", "last", F.lit("conflict").alias("outcome"))
    fine = wanted.join(held, clash, "left_anti").select(owner, group, "first", "last", F.lit("inserted").alias("outcome"))
    return fine.union(lost)


def replace_members(members: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Members with those of the changed keys replaced as a whole."""
    return members.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without those of the deleted keys."""
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def bury(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """(key, body) of the deleted rows as JSON texts, from which ``restore`` brings them back."""
    return rows.join(gone, key, "left_semi").select(key, F.to_json(F.struct(*rows.columns)).alias("body"))


def restore(tombstones: DataFrame, schema: str) -> DataFrame:
    return tombstones.select(F.from_json("body", schema).alias("_row")).select("_row.*")


def newest_lines(logs: DataFrame, task: str, most: int, *order: Column) -> DataFrame:
    """The last lines of each task's log, newest first; the bound is what a snapshot shows."""
    from pyspark.sql import Window as W

    return logs.withColumn("place", F.row_number().over(W.partitionBy(task).orderBy(*[c.desc() for c in order]))).where(F.col("place") <= most)


def resource_class(stated: Column, command: Column) -> Column:
    """Lane of a batch task: as stated, else by marks in its command."""
    said, folded = F.lower(F.trim(text(stated))), F.lower(text(command))
    marked = lambda marks: F.array_max(F.array(*[F.contains(folded, F.lit(m)) for m in marks]))
    return F.when(said.isin(*LANES), said).when(marked(HIGH_MEMORY_MARKS), "gpu_high_vram").when(marked(GPU_MARKS), "gpu").otherwise("cpu")


def annotate_progress(log: Column, percent: Column, scope: Column) -> Column:
    """A log with the progress before every line that is filled and has none."""
    prefix = F.concat(F.lit("[progress_scope="), scope, F.lit(" progress_percent="), F.format_string("%.2f", percent.cast("double")), F.lit("% progress_basis=current_stage_snapshot] "))
    lines = F.transform(F.split(text(log), "\n"), lambda x: F.when((F.trim(x) == "") | F.contains(x, F.lit("progress_percent=")), x).otherwise(F.concat(prefix, x)))
    return F.array_join(lines, "\n")
