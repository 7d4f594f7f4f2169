"""Evaluation of result items: one row of resolved fields, statuses and evidence measures for each."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import items, pages
from folio.functions.recover import recovered_answer
from folio.functions.text import is_illegal_answer, squash_space
from folio.operators.guards import require_unique


def recover_predictions(rows: DataFrame, status: str, record: str) -> DataFrame:
    """Predictions with the recovered ``answer`` and a status by it; missing ones and technical failures stay as they are."""
    kept = F.col(status).isin("missing", "technical_failure")
    found = rows.withColumn("_r", recovered_answer(F.when(~kept, F.col(record))))
    answer = F.coalesce("_r.answer", F.lit(""))
    by_answer = F.when(is_illegal_answer(answer), "technical_failure").otherwise("legal")
    return found.withColumns({"answer": F.when(kept, "").otherwise(answer), "parse_status": F.when(~kept, F.col("_r.status")), status: F.when(kept, F.col(status)).otherwise(by_answer)}).drop("_r")


def evaluate_items(rows: DataFrame, raw: str, unit: str, qa: str, verdicts: DataFrame | None = None) -> DataFrame:
    """Items given as JSON text with key, gold, prediction, status and evidence measures; repeated keys fail the job.

    ``verdicts(key, verdict)`` are a judge's; an evaluated item without one has the verdict null. An item without a gold
    page field has no evidence credit: it is malformed, not unanswerable.
    """
    base = rows.withColumn("_m", items.fields(F.try_parse_json(raw)))
    m = F.col("_m")
    found = base.withColumns({"_k": items.alignment_key(F.lit("results"), F.col(unit), F.col(qa), m), "_g": items.gold_answer(m), "_p": recovered_answer(F.col(raw)), "_gp": items.gold_pages(F.col(raw)), "_pp": items.predicted_pages(F.col(raw))})
    keyed = require_unique(found.withColumn("key", F.col("_k.key")), "key")
    agreed = keyed.withColumn("_e", pages.page_agreement(F.col("_gp.pages").cast("array<int>"), F.col("_pp.pages").cast("array<int>")))
    judged = agreed.join(verdicts.select("key", "verdict"), "key", "left") if verdicts is not None else agreed.withColumn("verdict", F.lit(None).cast("string"))
    no_pages, answer = F.col("_gp.source") == "missing", F.coalesce("_p.answer", F.lit(""))
    status = (
        F.when(is_illegal_answer(answer), "technical_failure")
        .when(squash_space(items.value(m, "question")) == "", "technical_failure_missing_question")
        .when(F.col("_g.source") == "missing", "technical_failure_missing_gold_answer")
        .otherwise("evaluated")
    )
    none = lambda c, zero: F.when(no_pages, zero).otherwise(c)
    return judged.withColumns(
        {
            "status": status,
            "gold": F.col("_g.answer"),
            "answer": answer,
            "verdict": F.when(status == "evaluated", F.col("verdict")).otherwise("technical_failure"),
            "evidence_correct": none(F.col("_e.exact"), 0),
            "evidence_precision": none(F.col("_e.precision"), 0.0),
            "evidence_recall": none(F.col("_e.recall"), 0.0),
            "evidence_f1": none(F.col("_e.f1"), 0.0),
        }
    ).drop("_m", "_k", "_g", "_p", "_gp", "_pp", "_e")


def walk_refs(node: Any, paper: str | None = None) -> Iterator[tuple[str | None, str, str]]:
    """(paper, question, answer as JSON) of every object with a question text and an answer; papers are inherited."""
    if isinstance(node, dict):
        own = node.get("source_paper_id") or node.get("paper_id")
        paper = str(own) if own else paper
        if isinstance(node.get("question"), str) and "answer" in node:
            yield paper, node["question"], json.dumps(node["answer"], ensure_ascii=False)
    for child in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
        yield from walk_refs(child, paper)


def item_refs(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, paper, question, answer) of the items anywhere inside JSON texts; broken or null texts have none."""

    def run(batches):
        for batch in batches:
            out = []
            for k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    out += [(k, *found) for found in walk_refs(json.loads(text or "null"))]
                except ValueError:
                    continue
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.record_batch({key: pa.array(cols[0], batch.column(0).type), **{n: pa.array(c, pa.string()) for n, c in zip(("paper", "question", "answer"), cols[1:], strict=True)}})

    return rows.select(key, raw).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, paper string, question string, answer string")
