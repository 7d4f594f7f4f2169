"""Fields of an item given as a variant object: by presence of a key, not by value, where the rules say so.

``m`` is the item's map from key to variant (``fields``). Page fields may hold numbers, texts, lists or containers, which
columns cannot walk: one Arrow UDF reads them from the item's JSON text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .recover import clean
from .text import UNANSWERABLE, squash_space, text

# Keys of gold and predicted fields, best first.
GOLD_ANSWERS = ("answer", "gold_answer", "reference_answer")
GOLD_PAGES = ("evidence_pages", "gold_evidence_pages")
PREDICTED_PAGES = ("evidence_pages_pre", "pred_evidence_pages", "predicted_evidence_pages", "evidence_pages_pred")
RAW_PAGES = "evidence_pages_pre_raw"
PAGE_OUTPUTS = ("answer_pre", "response", "raw_output", "raw_response")
OUTPUT_PAGES = ("evidence_pages_pre", "pred_evidence_pages", "predicted_evidence_pages", "evidence_pages")
CONTAINER_PAGES = (*OUTPUT_PAGES, "gold_evidence_pages", "pages")
UNIT_NAMES = ("paper", "paper_id", "doc_id", "unit_id")
PDF_PATHS = ("pdf_path_resolved", "pdf_path", "paper_path", "merged_pdf_path")
ANSWERABLE = ("answerable", "is_answerable")
# Shapes of page numbers in a text.
PAGE_LABEL = re.compile(r"(?:PDF_PAGE_|PAGE_|Page\s*|page\s*[:=]?\s*)(\d+)", re.IGNORECASE)
BARE_PAGE = re.compile(r"(?<![A-Za-z0-9_.-])(\d{1,4})(?![A-Za-z0-9_.-])")


def fields(item: Column) -> Column:
    """Map from key to variant of a variant object; null for any other value."""
    return F.try_variant_get(item, "$", "map<string,variant>")


def has(m: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(m, key), F.lit(False))


def value(m: Column, key: str) -> Column:
    """Text of a field; null if it is missing or null."""
    return F.try_variant_get(m[key], "$", "string")


def _by_presence(m: Column, keys: tuple[str, ...], pick, default: Column) -> Column:
    out = default
    for key in reversed(keys):
        out = F.when(has(m, key), pick(key)).otherwise(out)
    return out


def first_existing(m: Column, keys: tuple[str, ...], default: Column | None = None) -> Column:
    """Text of the first field that is there, even if it is null."""
    return _by_presence(m, keys, lambda k: value(m, k), F.lit(None).cast("string") if default is None else default)


def gold_answer(m: Column) -> Column:
    """Struct (answer, source) of the first gold field that is there; its null is an empty answer."""
    pick = lambda k: F.struct(squash_space(value(m, k)).alias("answer"), F.lit(k).alias("source"))
    return _by_presence(m, GOLD_ANSWERS, pick, F.struct(F.lit("").alias("answer"), F.lit("missing").alias("source")))


def item_uid(m: Column) -> Column:
    """The item's own id, else its short one, without outer blanks; empty without either."""
    return F.trim(F.coalesce(F.nullif(value(m, "item_uid"), F.lit("")), value(m, "uid"), F.lit("")))


def alignment_key(dataset: Column, unit: Column, qa: Column, m: Column) -> Column:
    """Struct (key, method): unit and item id, else the uid, else the question's hash; the job fails without any."""
    question = squash_space(value(m, "question"))
    keyed = lambda key, method: F.struct(key.alias("key"), F.lit(method).alias("method"))
    both = (F.trim(text(unit)) != "") & (F.trim(text(qa)) != "")
    return (
        F.when(both, keyed(F.concat(F.lit("unitqa::"), text(unit), F.lit("::"), text(qa)), "unit_id+qa_id"))
        .when(item_uid(m) != "", keyed(F.concat(F.lit("uid::"), item_uid(m)), "item_uid"))
        .when(question != "", keyed(F.concat(F.lit("question_sha256::"), F.sha2(question, 256)), "question_sha256"))
        .otherwise(F.raise_error(F.concat(F.lit("no key for an item of "), text(dataset))).cast("struct<key:string,method:string>"))
    )


def _filled(ms: tuple[Column, ...], keys: tuple[str, ...], default: Column) -> Column:
    return F.coalesce(*[F.nullif(value(m, k), F.lit("")) for m in ms for k in keys], default)


def paper_or_unit(unit_id: Column, unit: Column, m: Column) -> Column:
    """Name of an item's paper: the first filled field of the item, then of its unit, else the unit's id."""
    return _filled((m, unit), UNIT_NAMES, text(unit_id))


def pdf_path(unit: Column, m: Column) -> Column:
    return _filled((m, unit), PDF_PATHS, F.lit(""))


def answerable_display(m: Column, gold: Column) -> Column:
    """The item's flag as it is, else 0 or 1 by the gold answer, else empty."""
    inferred = F.when(gold == "", "").when(F.lower(gold) == UNANSWERABLE.lower(), "0").otherwise("1")
    return first_existing(m, ANSWERABLE, inferred)


def is_unanswerable_gold(gold: Column, flag: Column) -> Column:
    """Whether gold is the refusal in any case, or the flag says no."""
    said = F.lower(squash_space(flag))
    number = said.try_cast("double")
    return (F.lower(squash_space(gold)) == UNANSWERABLE.lower()) | said.isin("false", "no", "unanswerable") | F.coalesce(number.cast("long") == 0, F.lit(False))


def question_kind(m: Column) -> Column:
    """mcq or fill: as stated, else by whether there are options."""
    stated = F.lower(F.trim(F.coalesce(value(m, "type"), F.lit(""))))
    options = F.coalesce(F.try_variant_get(m["options"], "$", "string"), F.lit(""))
    return F.when(stated.isin("mcq", "fill"), stated).when(options.isin("", "[]", "{}", "false", "0"), "fill").otherwise("mcq")


OPTIONS = "array<struct<id:string,text:string>>"


def selected_option(options: Column, answer: Column) -> Column:
    """The first option whose folded id is the folded answer; null if none is."""
    from .text import fold_text

    return F.get(F.filter(options, lambda o: fold_text(o["id"]) == fold_text(answer)), F.lit(0))


def effective_answer(options: Column, answer: Column) -> Column:
    """Text of the selected option, else the answer."""
    chosen = selected_option(options, answer)
    return F.when(chosen.isNotNull(), chosen["text"]).otherwise(answer)


def without_fields(m: Column, dropped: tuple[str, ...]) -> Column:
    """The item's map without some fields."""
    return F.map_filter(m, lambda k, _: ~k.isin(*dropped))


def core_first(names: Column, core: tuple[str, ...]) -> Column:
    """Field names with the core ones first, in their order, then the rest as they are."""
    first = F.array(*[F.lit(c) for c in core])
    return F.concat(F.array_intersect(first, names), F.array_except(names, first))


def model_name(path: Column, prefix: str = "judge_") -> Column:
    """File name of a path without folder, last suffix and a leading ``prefix``."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.when(stem.startswith(prefix), F.substring(stem, F.lit(len(prefix) + 1), F.length(stem))).otherwise(stem)


def display_name(name: Column, known: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(pairs[name], name)


def legal_evidence(output_is_legal: Column, method: Column, answer: Column, pages: Column) -> Column:
    """The recorded flag, else a parsed, filled answer with a list of pages."""
    derived = (F.coalesce(method, F.lit("")) != "") & (method != "invalid_json") & (F.trim(text(answer)) != "") & pages.isNotNull()
    return F.coalesce(output_is_legal, derived, F.lit(False))


def canonical_gold(answer: Column, item: Column) -> Column:
    """The trimmed gold answer; the job fails at an empty one."""
    bare = F.trim(text(answer))
    return F.when(bare != "", bare).otherwise(F.raise_error(F.concat(text(item), F.lit(": the gold answer must be a filled text"))))


def page_numbers(node: Any) -> Iterator[int]:
    """Positive page numbers of a page field, repeats included; of a container only the first known page field."""
    if isinstance(node, str):
        yield from (n for pattern in (PAGE_LABEL, BARE_PAGE) for n in map(int, pattern.findall(node)) if n > 0)
    elif isinstance(node, list):
        for child in node:
            yield from page_numbers(child)
    elif isinstance(node, dict):
        yield from page_numbers(next((node[k] for k in CONTAINER_PAGES if k in node), None))
    elif isinstance(node, (int, float)) and not isinstance(node, bool) and node > 0 and node == int(node):
        yield int(node)


def page_list(node: Any) -> list[int]:
    return list(dict.fromkeys(page_numbers(node)))


def pages_of_output(raw: Any) -> list[int]:
    """Pages that a raw output states: of a JSON object, of the one inside a text, or of a lone page array."""
    if isinstance(raw, str):
        body = clean(raw)
        for part in (body, body[body.find("{") : body.rfind("}") + 1]):
            try:
                found = json.loads(part)
            except ValueError:
                continue
            if isinstance(found, dict):
                return pages_of_output(found)
        lone = re.search(r'"evidence_pages"\s*:\s*\[([^\]]*)\]', body, re.IGNORECASE)
        return page_list(lone[1]) if lone else []
    return page_list(next((raw[k] for k in OUTPUT_PAGES if k in raw), None)) if isinstance(raw, dict) else []


def gold_pages_of(item: dict) -> tuple[list[int], str]:
    key = next((k for k in GOLD_PAGES if k in item), None)
    return (page_list(item[key]), key) if key else ([], "missing")


def predicted_pages_of(item: dict) -> tuple[list[int], str]:
    """Pages of the first predicted field; an empty one is filled from the raw field. Gold fields are never read."""
    raw = page_list(item.get(RAW_PAGES))
    key = next((k for k in PREDICTED_PAGES if k in item), None)
    if key:
        pages = page_list(item[key])
        return (raw, f"{RAW_PAGES}_fallback") if raw and not pages else (pages, key)
    if RAW_PAGES in item:
        return raw, RAW_PAGES
    for key in PAGE_OUTPUTS:
        if pages := pages_of_output(item.get(key)):
            return pages, f"{key}:jsonish_evidence_pages"
    return [], "missing"


PAGE_FIELD = T.StructType([T.StructField("pages", T.ArrayType(T.LongType())), T.StructField("source", T.StringType())])


def _page_udf(find):
    @F.arrow_udf(PAGE_FIELD)
    def run(items: pa.Array) -> pa.Array:
        out = []
        for raw in items.to_pylist():
            try:
                item = json.loads(raw) if raw else {}
            except ValueError:
                item = {}
            out.append(dict(zip(("pages", "source"), find(item if isinstance(item, dict) else {}), strict=True)))
        return pa.array(out, pa.struct([("pages", pa.list_(pa.int64())), ("source", pa.string())]))

    return run


def gold_pages(item_json: Column) -> Column:
    """Struct (pages, source) of the first gold page field that is there."""
    return _page_udf(gold_pages_of)(item_json)


def predicted_pages(item_json: Column) -> Column:
    """Struct (pages, source) of an item's predicted pages."""
    return _page_udf(predicted_pages_of)(item_json)
