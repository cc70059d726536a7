"""Source shapes to rows: delimited lines, nested JSON facts, struct-of-arrays, wide columns; and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import require_columns

FACT_SCHEMA = "facts map<string, struct<units: map<string, array<struct<start: date, end: date, val: double, form: string, filed: date>>>>>"


def read_csv(spark: SparkSession, path: str, schema: str, required: set[str]) -> DataFrame:
    """A headed CSV with a fixed schema, trimmed texts, and the columns it must have."""
    raw = spark.read.csv(path, header=True, schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return require_columns(raw, required)


def parsed_lines(lines: Column, schema: str) -> Column:
    """Delimited text in a column, as a struct."""
    return F.from_csv(lines, schema, {"mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})


def flatten_facts(df: DataFrame, document: str, concepts: Sequence[str], unit: str = "USD") -> DataFrame:
    """Concept, unit and entry of nested fact documents; entries without end or value are dropped."""
    doc = df.withColumn("_doc", F.from_json(document, FACT_SCHEMA))
    by_concept = doc.select(*df.columns, F.explode("_doc.facts").alias("concept", "body")).where(F.col("concept").isin(*concepts))
    by_unit = by_concept.select(*df.columns, "concept", F.explode("body.units").alias("unit", "entries")).where(F.col("unit") == unit)
    rows = by_unit.select(*df.columns, "concept", F.inline("entries"))
    return rows.where("end IS NOT NULL AND val IS NOT NULL").drop(document)


def unzip_arrays(df: DataFrame, keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Parallel arrays become rows."""
    return df.select(*keys, F.inline(F.arrays_zip(*arrays)))


def wide_to_map(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Positive values of wide columns as one map per key."""
    long = df.unpivot([key], list(columns), "name", "value").where("value > 0")
    return long.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("values"))


def scaled_statement(df: DataFrame, value: str, crore: bool) -> DataFrame:
    """Values in crore (1e7) or millions (1e6), for export."""
    return df.withColumn(value, F.col(value) / (1e7 if crore else 1e6))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
