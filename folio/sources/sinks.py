"""Writers. Spark's commit protocol makes each write atomic for its readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.guards import first_of_tiers


def write_jsonl(df: DataFrame, path: str, *order: str, files: int | None = None) -> None:
    """JSON lines in range order; ``files=1`` only for reports of a known size."""
    ordered = df.orderBy(*order) if order else df
    (ordered.coalesce(files) if files else ordered).write.mode("overwrite").json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    (df.coalesce(files) if files else df).write.mode("overwrite").option("header", True).csv(path)


def percent_columns(df: DataFrame, suffix: str = "_rate") -> DataFrame:
    """Report form: rates as percent with two decimals."""
    return df.select(*[F.concat(F.format_number(F.col(c) * 100, 2), F.lit("%")).alias(c) if c.endswith(suffix) else F.col(c) for c in df.columns])


def table_text(df: DataFrame) -> DataFrame:
    """Tab-separated lines of the rows."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("line"))


def merge_shards(shards: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of all shards by key; of a key in several the last shard's."""
    return first_of_tiers(dict(reversed(shards.items())), key).drop("tier")


def extra_fields(df: DataFrame, core: list[str]) -> DataFrame:
    """Core columns, and the others as one JSON text."""
    rest = [c for c in df.columns if c not in core]
    return df.select(*core, F.to_json(F.struct(*rest)).alias("extra") if rest else F.lit("{}").alias("extra"))
