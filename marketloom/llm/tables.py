"""Access to the tables that the queries of this subpackage read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset, a folder below /tmp serves on one machine (a local master); a cluster must name one.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        path = "file:///tmp/marketloom-checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of a run in the shared folder, once nothing reads it any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def own_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_result(df: DataFrame, into: str, result: Column) -> DataFrame:
    """``df`` with a last column ``into``; a column of that name that ``df`` has already is kept as ``_<name>``."""
    kept = [df[f"`{c}`"].alias(own_name(df, f"_{c}") if c.lower() == into.lower() else c) for c in df.columns]
    return df.select(*kept, result.alias(into))


def in_fold(doc_id: Column, parts: int, at: int) -> Column:
    """Whether crc32 of the id as text, modulo ``parts``, is ``at`` (null ids: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == at, F.lit(False))
