"""Validation as rule columns: an array of codes for each row, empty when the row is fine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import UNANSWERABLE, text

# Refusals that are not the canonical label, and shapes of secrets.
NONCANONICAL = ("Not mentioned", "Not provided", "Unknown", "N/A", "None", "I cannot answer")
SECRETS = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("access_key", r"\b(AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("api_key", r"\b(sk|pk|ghp|xoxb)[-_][A-Za-z0-9_-]{16,}"),
    ("assignment", r"(?i)(api[_-]?key|secret|passwd|password|token)\s*[:=]\s*['\"]?[A-Za-z0-9/+_-]{8,}"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
)


def rule(condition: Column, code: str | Column) -> Column:
    return F.when(condition, F.lit(code) if isinstance(code, str) else code)


def codes(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def assert_clean(df: DataFrame, found: Column, what: str) -> DataFrame:
    """``df``; the job fails at the first row that has a code."""
    return df.where(F.when(F.size(found) > 0, F.raise_error(F.concat(F.lit(f"{what}: "), F.array_join(found, ",")))).otherwise(F.lit(True)))


def with_prediction_codes(df: DataFrame, raw: str, page_count: Column, out: str = "codes") -> DataFrame:
    """``df`` with the codes of raw outputs that must be {"answer_pre": text, "evidence_pages": [integers]}.

    Strict JSON: a repeated key or a bare NaN is invalid. Each output is parsed once, in a projection of its own.
    """
    parsed = df.withColumn("_v", F.try_parse_json(raw))
    fields = parsed.withColumns({"_keys": F.try_variant_get("_v", "$", "map<string,variant>"), "_kind": F.schema_of_variant("_v")})
    split = fields.withColumns({"_a": F.col("_keys")["answer_pre"], "_p": F.col("_keys")["evidence_pages"]})
    typed = split.withColumns({"_ak": F.schema_of_variant("_a"), "_pk": F.schema_of_variant("_p")}).withColumns(
        {
            "_answer": F.when(F.col("_ak") == "STRING", F.try_variant_get("_a", "$", "string")),
            "_whole": F.coalesce(F.col("_pk").isin("ARRAY<BIGINT>", "ARRAY<VOID>"), F.lit(False)),
            "_list": F.coalesce(F.col("_pk").startswith("ARRAY"), F.lit(False)),
        }
    )
    ready = typed.withColumns({"_pages": F.when(F.col("_whole"), F.try_variant_get("_p", "$", "array<bigint>")), "_bare": F.regexp_replace(text(F.col("_answer")), r"(?U)^\s+|\s+$", "")})
    answer, pages, bare, is_list = F.col("_answer"), F.col("_pages"), F.col("_bare"), F.col("_list")
    refusal = answer == UNANSWERABLE
    both = answer.isNotNull() & is_list
    empty = is_list & (F.coalesce(F.size(pages), F.lit(1)) == 0)
    found = F.when(F.col("_v").isNull(), F.array(F.lit("invalid_json"))).when(~F.col("_kind").startswith("OBJECT"), F.array(F.lit("wrong_object_type"))).otherwise(
        codes(
            rule(F.array_sort(F.map_keys("_keys")) != F.array(F.lit("answer_pre"), F.lit("evidence_pages")), "wrong_fields"),
            rule(answer.isNull(), "answer_type"),
            rule(answer.isNotNull() & (bare == ""), "empty_answer"),
            rule(~is_list, "pages_type"),
            rule(is_list & ~F.col("_whole"), "page_type"),
            rule(F.exists(pages, lambda p: p <= 0), "page_nonpositive"),
            rule(F.exists(pages, lambda p: p > page_count), "page_out_of_range"),
            rule(both & refusal & ~empty, "refusal_with_pages"),
            rule(both & ~refusal & empty, "answer_without_evidence"),
            rule((~refusal & (F.lower(bare) == UNANSWERABLE.lower())) | answer.isin(*NONCANONICAL), "noncanonical_refusal"),
        )
    )
    return ready.withColumn(out, found).drop(*[c for c in ready.columns if c.startswith("_") and c not in df.columns])


def prediction_rules(answer: Column, pages: Column, maximum: int, allowed: Column) -> Column:
    """Codes of a parsed prediction: pages positive, few enough, among the allowed; refusal if and only if none."""
    distinct = F.array_distinct(pages)
    return codes(
        rule(F.trim(text(answer)) == "", "empty_answer"),
        rule(F.exists(pages, lambda p: p <= 0), "page_nonpositive"),
        rule(F.size(distinct) > maximum, "too_many_pages"),
        rule(F.size(F.array_except(pages, allowed)) > 0, "page_not_allowed"),
        rule((answer == UNANSWERABLE) & (F.size(pages) > 0), "refusal_with_pages"),
        rule((answer != UNANSWERABLE) & (F.size(pages) == 0), "answer_without_evidence"),
    )


def normalisation_flags(raw_pages: Column, raw: Column) -> Column:
    """What canonical storage changes: outer blanks, repeated pages, unsorted pages."""
    return codes(
        rule(raw != F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), "outer_whitespace"),
        rule(F.size(raw_pages) != F.size(F.array_distinct(raw_pages)), "evidence_pages_deduplicated"),
        rule(raw_pages != F.array_sort(raw_pages), "evidence_pages_sorted"),
    )


def review_codes(decision: Column, confidence: Column, reason: Column, corrected: Column, criteria: Column) -> Column:
    return codes(
        rule(~F.coalesce(decision.isin("KEEP", "FIX", "DROP"), F.lit(False)), "invalid_decision"),
        rule(F.coalesce(F.exists(F.map_values(criteria), lambda c: c.isNull()), F.lit(True)), "invalid_criteria"),
        rule(~F.coalesce(confidence.between(0, 1), F.lit(False)), "invalid_confidence"),
        rule(F.trim(text(reason)) == "", "empty_reason"),
        rule((decision == "FIX") & (F.trim(text(corrected)) == ""), "fix_without_correction"),
    )


def strict_keep(decision: Column, confidence: Column, criteria: Column, unchanged: Column, least: float) -> Column:
    """Kept outright, or fixed without any change; sure enough; every criterion true."""
    fine = (decision == "KEEP") | ((decision == "FIX") & unchanged)
    return F.coalesce(fine & (confidence >= least) & F.forall(F.map_values(criteria), lambda c: F.coalesce(c, F.lit(False))), F.lit(False))


def secret_locations(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, line, kind) of secret-like strings: places only, never the strings."""
    lines = docs.select(key, F.posexplode(F.split(text(F.col(body)), "\n")).alias("at", "line"))
    kinds = codes(*[rule(F.col("line").rlike(p), name) for name, p in SECRETS])
    return lines.select(key, (F.col("at") + 1).alias("line_number"), F.explode_outer(kinds).alias("kind")).where("kind is not null")
