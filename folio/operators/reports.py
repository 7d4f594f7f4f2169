"""Report joins, summaries and projections over items, results and reviews."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.text import text
from folio.operators.contracts import codes, rule

# Answer fields kept for reviewers, and evidence left out of what a model is shown.
REVIEW_FIELDS = ("question", "answer")
# Roles of a reasoning type by place in a category's taxonomy.
ROLES = {"structural": 0, "empirical": 1, "analytical": 2}


def reconcile(gold: DataFrame, results: DataFrame, key: str, bound: list[str]) -> DataFrame:
    """(key, codes) of every gold or result key: missing_result, unknown_result, or the bound fields that differ."""
    g = gold.select(key, F.struct(*bound).alias("_g"))
    r = results.select(key, F.struct(*bound).alias("_r"))
    found = codes(
        rule(F.col("_r").isNull(), "missing_result"),
        rule(F.col("_g").isNull(), "unknown_result"),
        *[rule(F.col("_g").isNotNull() & F.col("_r").isNotNull() & ~F.col(f"_g.{c}").eqNullSafe(F.col(f"_r.{c}")), f"{c}_mismatch") for c in bound],
    )
    return g.join(r, key, "full").select(key, found.alias("codes"))


def accuracy_by(rows: DataFrame, correct: str, *dimensions: str) -> DataFrame:
    """Count, correct and percent over all rows and by each dimension on its own, from one pass of grouping sets."""
    grouped = rows.groupingSets([[], *[[d] for d in dimensions]], *dimensions).agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("correct"), F.grouping_id().alias("_g"))
    names = F.create_map(F.lit((1 << len(dimensions)) - 1).cast("long"), F.lit("all"), *[F.lit(x) if isinstance(x, str) else F.lit(x).cast("long") for i, d in enumerate(dimensions) for x in (((1 << len(dimensions)) - 1) ^ (1 << (len(dimensions) - 1 - i)), d)])
    value = F.coalesce(*[F.col(d).cast("string") for d in dimensions])
    return grouped.select(names[F.col("_g")].alias("dimension"), value.alias("value"), "n", "correct", (F.col("correct") * 100.0 / F.col("n")).alias("percent"))


def status_table(rows: DataFrame, model: str, status: str, statuses: list[str]) -> DataFrame:
    """Counters of each status by model; the statuses are stated, so that the columns do not depend on the data."""
    return rows.groupBy(model).pivot(status, statuses).agg(F.count(F.lit(1))).na.fill(0)


def metric_rows(evaluations: DataFrame, label: str, metrics: list[str]) -> DataFrame:
    """One row for each evaluation and metric: mode and model are the parts of the label around its last underscore."""
    mode = F.regexp_extract(label, r"^(.*)_[^_]*$", 1)
    named = evaluations.select(F.col(label).alias("evaluation"), F.when(mode == "", F.col(label)).otherwise(mode).alias("mode"), F.element_at(F.split(label, "_"), -1).alias("model"), *metrics)
    return named.unpivot(["evaluation", "mode", "model"], metrics, "metric", "value")


def method_summary(rows: DataFrame, method: str, completed: Column, correct: Column) -> DataFrame:
    """Rows, completed and correct ones by method."""
    return rows.groupBy(method).agg(F.count("*").alias("selected"), F.count_if(completed).alias("completed"), F.count_if(completed & correct).alias("correct"))


def catalog(parts: dict[str, DataFrame], unit: str) -> DataFrame:
    """One row for each dataset: its units and items."""
    out = None
    for name, df in sorted(parts.items()):
        row = df.agg(F.lit(name).alias("dataset"), F.count_distinct(unit).alias("units"), F.count("*").alias("items"))
        out = row if out is None else out.union(row)
    return out


def hardest(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first rows in descending order of all of ``order``; the number is what the report asks for."""
    return rows.orderBy(*[c.desc() for c in order]).limit(most)


def quota_reservation(rows: DataFrame, group: str, quotas: dict[str, int], *order: Column) -> DataFrame:
    """The first rows of each group up to its quota, with their place; groups without a quota have none."""
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col(group)]
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("place") <= quota)


def selection_reasons(picked: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, reasons) of all keys that some reason selects, reasons sorted."""
    out = None
    for name, df in picked.items():
        one = df.select(key, F.lit(name).alias("reason"))
        out = one if out is None else out.union(one)
    return out.groupBy(key).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def changed_views(views: DataFrame, sources: DataFrame, key: str, body: str) -> DataFrame:
    """(key, state) of views against their sources by content: same, stale, or missing on one side."""
    a, b = (x.select(key, F.sha2(text(F.col(body)), 256).alias(c)) for x, c in ((views, "_a"), (sources, "_b")))
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "orphan").when(F.col("_a") == F.col("_b"), "same").otherwise("stale")
    return a.join(b, key, "full").select(key, state.alias("state"))


def item_table(items: DataFrame, pages: str, docs: str, modalities: str, answer: str) -> DataFrame:
    """Items with their flags and joined lists: answerable, cross_document, multi_page, multimodal, pages and modalities as texts."""
    distinct = lambda c: F.array_sort(F.array_distinct(F.col(c)))
    return items.withColumns(
        {
            "answerable": F.trim(text(F.col(answer))) != "Unanswerable",
            "cross_document": F.size(distinct(docs)) > 1,
            "multi_page": F.size(distinct(pages)) > 1,
            "multimodal": F.size(distinct(modalities)) > 1,
            "page_list": F.array_join(distinct(pages), "|"),
            "modality_list": F.array_join(distinct(modalities), "|"),
        }
    )


def review_payload(items: DataFrame, bundle: str, key: str, fields: tuple[str, ...] = REVIEW_FIELDS) -> DataFrame:
    """(bundle, ids, payload): sorted item ids and the JSON text of the shown fields, without evidence."""
    shown = F.struct(F.col(key).cast("string").alias("qa_id"), *fields)
    grouped = items.groupBy(bundle).agg(F.array_sort(F.collect_list(shown)).alias("_items"))
    return grouped.select(bundle, F.transform("_items", lambda x: x["qa_id"]).alias("ids"), F.to_json("_items").alias("payload"))


def dataset_profile(items: DataFrame, dataset: str, unit: str, question: str, answer: str, pages: str) -> DataFrame:
    """List view of datasets: units, items, blank questions, refusals and the highest page."""
    return items.groupBy(dataset).agg(
        F.count_distinct(unit).alias("units"),
        F.count("*").alias("items"),
        F.count_if(F.trim(text(F.col(question))) == "").alias("blank"),
        F.count_if(F.trim(text(F.col(answer))) == "Unanswerable").alias("refusals"),
        F.coalesce(F.max(F.array_max(pages)), F.lit(0)).alias("last_page"),
    )


def category_for(taxonomy: dict[str, list[str]], primary: Column, role: Column) -> Column:
    """Category of a role in a primary category's taxonomy; null for unknown ones."""
    table = F.create_map(*[x for k, v in taxonomy.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    place = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.get(table[primary], place[role])


def first_object(raw: str | None) -> str | None:
    """The first JSON object that decodes at any opening brace; what follows it does not matter."""
    decoder, at = json.JSONDecoder(), -1
    while raw and (at := raw.find("{", at + 1)) >= 0:
        try:
            found, _ = decoder.raw_decode(raw, at)
        except ValueError:
            continue
        return json.dumps(found, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return None


@F.arrow_udf(T.StringType())
def embedded_object(raws: pa.Array) -> pa.Array:
    """JSON text, keys sorted, of the first object inside each text; null without one."""
    return pa.array([first_object(x) for x in raws.to_pylist()], pa.string())


def lenient_json(raw: Column) -> Column:
    """Variant of JSON text in which a backslash before any other than an escape letter is meant as itself."""
    return F.try_parse_json(F.regexp_replace(raw, r'(?<!\\)((?:\\\\)*)\\(?!["\\/bfnrtu])', r"$1\\\\"))


def choice_prompt(question: Column, options: Column) -> Column:
    """Prompt of a multiple-choice question: the question, its options by letter, and what to answer with."""
    lines = F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o))
    return F.concat(F.lit("Question: "), question, F.lit("\nOptions:\n"), F.array_join(lines, "\n"), F.lit("\nAnswer with the letter of one option."))


def fill_prompt(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer in as few words as the question needs."))
