"""Readers for the parquet tables (SRC7): explicit column selection, pushdown left to Catalyst."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder; ``<dir>/<name>.parquet`` (file or folder)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def stored(spark: SparkSession, path: str, **options) -> DataFrame | None:
    """The table at ``path``, or None where nothing is stored yet; any other failure is raised."""
    try:
        return spark.read.options(**options).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def spread(df: DataFrame, key: str, min_partitions: int | None = None) -> DataFrame:
    """Hash-spread an under-partitioned scan before CPU-heavy per-row work (tokenising, chunking).

    Only when the scan yields fewer partitions than the cluster's parallelism (a small file with
    one row group). A large input already has more splits than cores, so no shuffle is added.
    Hash partitioning on the key is deterministic, so a retried task sees the same rows.
    """
    spark = df.sparkSession
    try:
        target = min_partitions or spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() >= target:
            return df
    except Exception:  # no RDD view (e.g. a remote session): leave the scan as it is
        return df
    return df.repartition(target, key)


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The documents table, projected first (column pruning reaches the scan), then spread."""
    d = table(spark, sf_dir, "documents")
    if cols:
        d = d.select(*cols)
    return spread(d, "doc_id") if "doc_id" in d.columns else d
