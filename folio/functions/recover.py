"""Deterministic recovery of answers and pages from arbitrary prediction containers.

Provider outputs nest without a fixed schema, which columns cannot express, so one Arrow UDF walks them: a depth-first
search over the children of a container in the order of key tables, ending at the first text that is not blank. Gold
fields of an item are never looked at.
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

# Fields of an item that hold a prediction, best first.
PREDICTION_KEYS = (
    "answer_pre", "pred_answer", "prediction", "model_answer", "final_answer", "generated_answer",
    "answer_pre_raw", "raw_answer", "model_response", "assistant_response", "generated_text", "output_text",
    "generation", "completion", "response", "raw_output", "raw_response", "output", "result",
)
# Inside a prediction, keys of an answer, of a text and of a nested container.
ANSWER_KEYS = ("answer_pre", "pred_answer", "prediction", "model_answer", "final_answer", "generated_answer", "answer")
TEXT_KEYS = ("generated_text", "output_text", "text", "content")
CONTAINER_KEYS = ("response", "raw_response", "raw_output", "output", "result", "message", "generation", "completion", "data")
JSON_ANSWER_KEYS = ("answer_pre", "pred_answer", "answer")
DEEPEST = 6

FIELD = re.compile(r'"answer_pre"\s*:\s*"((?:[^"\\]|\\.)*)', re.DOTALL)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def squash(value: Any) -> str:
    return " ".join(str("" if value is None else value).split())


def clean(text: str) -> str:
    text = re.sub(r"<\|[a-z_]+\|>", "", text).strip()
    fenced = re.fullmatch(r"```(?:json|JSON)?\s*(.*?)\s*(?:```)?", text, re.DOTALL)
    return (fenced[1] if fenced else text).strip()


def first_object(text: str) -> tuple[dict | None, str]:
    """The object that a text is, or the one between its outer braces, and how it was found."""
    for candidate, how in ((text, "json"), (text[text.find("{") : text.rfind("}") + 1], "json_extracted")):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value, how
    return None, ""


def answer_in_text(text: str) -> tuple[str, str]:
    """Answer of a text output: a JSON answer, a lone answer field, or the text itself."""
    text = clean(text)
    if not text:
        return "", "empty"
    found, how = first_object(text)
    if found is not None:
        return squash(next((found[k] for k in JSON_ANSWER_KEYS if k in found), "")), how
    if m := FIELD.search(text):  # a blank field is a blank answer, not the text around it
        return squash(re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), m[1], flags=re.DOTALL)), "field_scan"
    return squash(text), "raw_text"


def children(node: Any) -> Iterator[tuple[str, Any]]:
    """Where an answer may lie inside a container, best first, with the label of the step."""
    if isinstance(node, list):
        yield from (("list", x) for x in node)
        return
    yield from ((k, node[k]) for k in ANSWER_KEYS if k in node)
    for choice in node.get("choices") if isinstance(node.get("choices"), list) else ():
        if isinstance(choice, dict):
            yield from ((f"choices.{k}", choice[k]) for k in ("message", "text") if k in choice)
    yield from ((k, node[k]) for k in (*TEXT_KEYS, *CONTAINER_KEYS) if k in node)


def blocks_of_text(node: Any) -> str:
    """Texts of typed content blocks, one a line."""
    rows = [x for x in node if isinstance(x, dict)] if isinstance(node, list) else []
    return "\n".join(t for x in rows if squash(x.get("type")).lower() in {"text", "output_text"} and (t := squash(x.get("text"))))


def find_answer(node: Any, depth: int = 0) -> tuple[str, str]:
    """First answer in a container and the path to it."""
    if node is None or depth > DEEPEST:
        return "", "empty"
    if isinstance(node, str):
        return answer_in_text(node)
    if not isinstance(node, (list, dict)):
        return squash(node), "scalar"
    if blocks := blocks_of_text(node):
        return blocks, "content_blocks"
    for label, child in children(node):
        answer, how = find_answer(child, depth + 1)
        if answer:
            return answer, f"{label}:{how}"
    return "", "empty_list" if isinstance(node, list) else "empty_dict"


def predicted_answer(item: dict) -> tuple[str, str, str]:
    """(answer, status, field) of an item's prediction; the first field's status if none is recovered."""
    seen = ("", "missing", "")
    for key in PREDICTION_KEYS:
        if key in item:
            answer, how = find_answer(item[key])
            if squash(answer):
                return squash(answer), how, key
            seen = seen if seen[1] != "missing" else ("", how, key)
    return seen


@F.arrow_udf(T.StructType([T.StructField(name, T.StringType()) for name in ("answer", "status", "field")]))
def _recover(items: pa.Array) -> pa.Array:
    out = []
    for raw in items.to_pylist():
        try:
            item = json.loads(raw) if raw else {}
        except ValueError:
            item = {}
        out.append(dict(zip(("answer", "status", "field"), predicted_answer(item if isinstance(item, dict) else {}), strict=True)))
    return pa.array(out, pa.struct([("answer", pa.string()), ("status", pa.string()), ("field", pa.string())]))


def recovered_answer(item_json: Column) -> Column:
    """Struct (answer, status, field) of an item given as JSON text; null or broken JSON has the status missing."""
    return _recover(item_json)


# Number words and what they stand for.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth".split()
SCALES = {"thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
VALUES = {w: i for i, w in enumerate(UNITS)} | {w: 10 * (i + 2) for i, w in enumerate(TENS)}
# Shapes of fractions and numerals.
FRACTION = re.compile(r"\\frac\{\s*(-?\d+)\s*\}\{\s*(-?\d+)\s*\}|(-?\d+)\s*/\s*(-?\d+)")
NUMERAL = re.compile(r"[-+]?\d+(?:,\d{3})*(?:\.\d+)?(?:e[-+]?\d+)?%?")
#: Words of the longest number phrase.
PHRASE = 6


def words_value(words: list[str]) -> float | None:
    """Value of English number words, or None if a word is none; an ordinal counts only alone, ``and`` not at all."""
    words = [w for w in words if w != "and"]
    if len(words) == 1 and words[0] in ORDINALS:
        return float(ORDINALS.index(words[0]) + 1)
    total = part = 0
    for w in words:
        if w in VALUES:
            part += VALUES[w]
        elif w == "hundred":
            part = (part or 1) * 100
        elif w in SCALES:
            total, part = total + (part or 1) * SCALES[w], 0
        else:
            return None
    return float(total + part) if words else None


def numbers_in(text: str) -> list[float]:
    """Fractions, numerals, percents (also over 100) and, from every word on, the longest number phrase.

    In that order, each value once (to 12 decimals). A fraction over zero is none.
    """
    text = text or ""
    found = [int(a or c) / int(b or d) for a, b, c, d in FRACTION.findall(text) if int(b or d)]
    for numeral in NUMERAL.findall(text):
        value = float(numeral.rstrip("%").replace(",", ""))
        found += [value, value / 100] if numeral.endswith("%") else [value]
    words = re.findall(r"[a-z]+", text.lower())
    for i in range(len(words)):
        phrases = (words_value(words[i:j]) for j in range(min(len(words), i + PHRASE), i, -1))
        value = next((v for v in phrases if v is not None), None)
        found += [] if value is None else [value]
    once: dict[float, float] = {}
    for x in found:
        once.setdefault(round(x, 12), x)
    return list(once.values())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _numbers(texts: pa.Array) -> pa.Array:
    return pa.array([numbers_in(x) for x in texts.to_pylist()], pa.list_(pa.float64()))


def extracted_numbers(text: Column) -> Column:
    return _numbers(text)
