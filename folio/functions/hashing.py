"""Content hashes and identities derived from them."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text


def digest(c: Column) -> Column:
    return F.sha2(text(c), 256)


def stable_key(*parts: Column) -> Column:
    """Hash of parts that are kept apart; a null part counts as the text None."""
    return F.sha2(F.concat_ws("\n---\n", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256)


def content_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and 16 hex digits of the parts' hash; a text part's null counts as empty."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.array_join(F.array(*[text(p) for p in parts]), "\u0000"), 256), F.lit(16)))


def hash_choice(seed: Column, n: int) -> Column:
    """A choice of ``n`` that the seed's hash decides."""
    return F.conv(F.left(F.sha2(text(seed), 256), F.lit(2)), 16, 10).cast("int") % n


def ordered_fingerprint(ids: Column) -> Column:
    """Hash of a sorted collection of ids, one a line; aggregate."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(ids.cast("string"))), "\n"), 256)


def json_text(c: Column) -> Column:
    """JSON string of a text, other than ASCII as it is; a null is null."""
    return F.when(c.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1))


def object_hash(parts: dict[str, Column], spaced: bool = False) -> Column:
    """Hash of a JSON object of texts with sorted keys; ``spaced`` puts a blank after each colon and comma."""
    colon, comma = (": ", ", ") if spaced else (":", ",")
    pairs = [F.concat(F.lit(f'"{k}"{colon}'), json_text(parts[k])) for k in sorted(parts)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(comma, *pairs), F.lit("}")), 256)


def list_hash(*parts: Column) -> Column:
    """Hash of a compact JSON list of texts."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *[json_text(p) for p in parts]), F.lit("]")), 256)


def manifest_hash(key: Column, value: Column) -> Column:
    """Hash of the compact JSON list of all (key, value) text pairs in order; aggregate over a manifest of files."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct(key.cast("string").alias("k"), value.alias("v")))), lambda p: F.concat(F.lit("["), json_text(p["k"]), F.lit(","), json_text(p["v"]), F.lit("]")))
    return F.sha2(F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]")), 256)


def assignment_id(original: Column, dataset: Column) -> Column:
    """32 hex digits of the hash of both names."""
    return F.left(F.sha2(F.concat(text(original), F.lit(":"), text(dataset)), 256), F.lit(32))


def run_fingerprint(config: dict, files: dict[str, str]) -> str:
    """Hash of a run's settings and of the hashes of its files, in whatever order both are given."""
    payload = json.dumps({"config": config, "files": files}, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(payload.encode()).hexdigest()
