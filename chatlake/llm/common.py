"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.session import materialize, scratch_path, ship_package
from chatlake.sources.tables import table

__all__ = ["WORD", "SPACE", "materialize", "scratch_path", "new_path", "ship_package", "table", "ship", "text_or_empty"]

#: A word and a run of separators of the pipeline's contracts (ASCII white space only).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def text_or_empty(col: str | Column) -> Column:
    """A null text counts as the empty text everywhere in this subpackage."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")


def ship(df: DataFrame) -> DataFrame:
    """Make this package importable in the Python workers that will run a step on ``df``."""
    ship_package(df.sparkSession)
    return df
