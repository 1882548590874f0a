"""SRC6: CSV with a header, read with an explicit schema (multi-line quoted fields allowed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Tasks that list the folders of a path; Spark's own number is a task a folder, up to 10,000.
LISTING_TASKS = 64
_PARALLELISM = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Quotes inside a field are doubled. Empty and missing values both read back as null (as pandas reads NaN)."""
    before = spark.conf.get(_PARALLELISM)
    spark.conf.set(_PARALLELISM, str(min(int(before), LISTING_TASKS)))
    try:  # the folders are listed here, not when the rows are read
        return (spark.read.schema(schema).option("header", True).option("multiLine", True)
                .option("escape", '"').csv(path))
    finally:
        spark.conf.set(_PARALLELISM, before)
