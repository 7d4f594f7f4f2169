"""Readers: JSON of any top-level shape, nested datasets, submissions, ledgers, inventories."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import valid_text
from folio.operators.guards import bind_predictions, last_wins, require_unique

# Keys under which tools wrap a dataset, and names of an item's unit and id.
WRAPPERS = ("data", "results", "items", "records")
UNIT_KEYS = ("paper_id", "paper", "unit_id", "doc_id")
ID_KEYS = ("qa_id", "id")


def _values(batches):
    """Whole files to their top-level JSON values: one, one a line, or one after another."""
    decoder = json.JSONDecoder()
    for batch in batches:
        out = []
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text, at, n = text.removeprefix("﻿"), 0, 0
            while at < len(text):
                if text[at].isspace():
                    at += 1
                    continue
                start = at
                _, at = decoder.raw_decode(text, at)
                out.append((path, n, text[start:at]))
                n += 1
            if not n:
                raise ValueError(f"no JSON value in {path}")
        paths, places, values = zip(*out, strict=True) if out else ((), (), ())
        yield pa.record_batch({"path": pa.array(paths, pa.string()), "place": pa.array(places, pa.int64()), "value": pa.array(values, pa.string())})


def read_json_values(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, value) of every top-level JSON value of the files; an empty or broken file fails the job."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return files.mapInArrow(_values, "path string, place long, value string")


def read_json_or(spark: SparkSession, path: str, default: str) -> DataFrame:
    """As ``read_json_values``; a path that does not exist gives the JSON text ``default`` as its only value."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return read_json_values(spark, path)
    return spark.createDataFrame([(path, 0, default)], "path string, place long, value string")


def paper_items(values: DataFrame) -> DataFrame:
    """(path, unit_id, unit) of the objects at the top level of each value, but for keys that start with two underscores."""
    parsed = values.select("path", F.parse_json("value").alias("v"))
    units = values.sparkSession.sql("select t.path, u.key as unit_id, u.value as unit from {t} as t, lateral variant_explode(t.v) as u", t=parsed)
    return units.where(~F.startswith("unit_id", F.lit("__")) & F.schema_of_variant("unit").startswith("OBJECT"))


def manifest_rows(values: DataFrame) -> DataFrame:
    """(id, row) of manifests, which are lists of rows with an id: the last row of each; a value that is no list fails the job."""
    parsed = values.select("path", "place", F.parse_json("value").alias("v"))
    no_list = F.raise_error(F.concat(F.lit("a manifest must be a list: "), F.col("path"))).cast("boolean")
    lists = parsed.where(F.when(F.schema_of_variant("v").startswith("ARRAY"), True).otherwise(no_list))
    rows = values.sparkSession.sql("select t.path, t.place, u.pos, u.value as row from {t} as t, lateral variant_explode(t.v) as u", t=lists)
    rows = rows.select(F.try_variant_get("row", "$.id", "string").alias("id"), F.to_json("row").alias("row"), F.struct("path", "place", "pos").alias("at"))
    return rows.groupBy("id").agg(F.max_by("row", "at").alias("row"))


def mapping_rows(spark: SparkSession, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """(official, custom_subclass, big_class) of a mapping from official categories to pairs."""
    return spark.createDataFrame([(k, *v) for k, v in mapping.items()], "official string, custom_subclass string, big_class string")


def processing_order(rows: DataFrame) -> DataFrame:
    """Rows (big_class, custom_subclass, official) with their place in the sorted order; a table of some hundred categories."""
    order = W.orderBy("big_class", "custom_subclass", "official")
    return rows.withColumn("place", F.row_number().over(order) - 1)


def category_search(category: Column, first: str | None = None, last: str | None = None) -> Column:
    """Search text of a category, within submission dates if they are given."""
    dates = f" AND submittedDate:[{first} TO {last}]" if first and last else ""
    return F.concat(F.lit("cat:"), category, F.lit(dates))


def tail_text(spark: SparkSession, path: str, most: int = 64_000) -> DataFrame:
    """(path, tail): the last bytes of each file as text, broken characters replaced. Each file is read whole."""
    files = spark.read.format("binaryFile").load(path)
    end = F.when(F.length("content") > most, F.substring("content", -most, most)).otherwise(F.col("content"))
    return files.select("path", valid_text(end).alias("tail"))


def dataset_items(values: DataFrame) -> DataFrame:
    """(path, unit_id, qa_id, unit, qa) of datasets ``{unit: {"QA": {id: item}}}``, wrapped or not; the last two variants.

    Units that are no objects or have no QA object are skipped; a unit that two values of a file have fails the job.
    """
    spark = values.sparkSession
    parsed = values.select("path", F.parse_json("value").alias("v"))
    inner = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "variant") for k in WRAPPERS])
    top = parsed.select("path", F.when(inner.isNotNull() & F.schema_of_variant(inner).startswith("OBJECT"), inner).otherwise(F.col("v")).alias("v"))
    units = spark.sql("select t.path, u.key as unit_id, u.value as unit from {t} as t, lateral variant_explode_outer(t.v) as u", t=top)
    units = units.where(F.schema_of_variant(F.try_variant_get("unit", "$.QA", "variant")).startswith("OBJECT"))
    units = require_unique(units.withColumn("unit_key", F.concat_ws("\n", "path", "unit_id")), "unit_key").drop("unit_key")
    items = spark.sql("select t.path, t.unit_id, t.unit, q.key as qa_id, q.value as qa from {t} as t, lateral variant_explode(try_variant_get(t.unit, '$.QA', 'variant')) as q", t=units)
    return items.where(F.schema_of_variant("qa").startswith("OBJECT")).select("path", "unit_id", "qa_id", "unit", "qa")


def flat_items(values: DataFrame) -> DataFrame:
    """(path, unit_id, qa_id, qa) of lists or lines of items; an item without an id gets its place."""
    spark = values.sparkSession
    parsed = values.select("path", "place", F.parse_json("value").alias("v"))
    is_list = F.schema_of_variant("v").startswith("ARRAY")
    single = parsed.where(~is_list).select("path", F.col("place").alias("pos"), F.col("v").alias("qa"))
    many = spark.sql("select t.path, cast(u.pos as bigint) as pos, u.value as qa from {t} as t, lateral variant_explode(t.v) as u", t=parsed.where(is_list))
    text = lambda keys, default: F.coalesce(*[F.try_variant_get("qa", f"$.{k}", "string") for k in keys], default)
    rows = single.union(many).where(F.schema_of_variant("qa").startswith("OBJECT"))
    return rows.select("path", text(UNIT_KEYS, F.lit("")).alias("unit_id"), text(ID_KEYS, F.col("pos").cast("string")).alias("qa_id"), "qa")


def read_submission(spark: SparkSession, path: str, gold: DataFrame, key: str = "qa_id") -> DataFrame:
    """Every gold row with the submitted answer and pages; duplicate or unknown ids fail the job."""
    rows = flat_items(read_json_values(spark, path))
    got = rows.select(F.col("qa_id").alias(key), F.try_variant_get("qa", "$.answer_pre", "string").alias("answer"), F.try_variant_get("qa", "$.evidence_pages", "array<int>").alias("pages"), F.lit("legal").alias("status"))
    return bind_predictions(gold, got, key)


def read_ledger(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """JSON lines by key; of repeated keys the last line wins."""
    lines = read_json_values(spark, path).select("path", "place", "value")
    fields = lines.select(*[F.get_json_object("value", f"$.{k}").alias(k) for k in keys], "path", "place", "value")
    return last_wins(fields, keys, F.col("path"), F.col("place"))


def escaped_json(c: Column) -> Column:
    """Variant of JSON text whose backslashes were not escaped; broken text is null."""
    return F.try_parse_json(F.replace(c, F.lit("\\"), F.lit("\\\\")))


def file_inventory(spark: SparkSession, path: str, pattern: str = "*", excluded: str | None = None) -> DataFrame:
    """(path, bytes, modified, sha256) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    kept = files.where(~F.col("path").rlike(excluded)) if excluded else files
    return kept.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def truthy_scores(rows: DataFrame, keys: list[str], model: str, value: str) -> DataFrame:
    """Long text scores to one map (model -> boolean) a key."""
    yes = F.lower(F.trim(F.col(value))).isin("1", "true", "yes")
    return rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(model), yes))).alias("scores"))
