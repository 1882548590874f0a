"""SRC8: the stop-word list as a small, fixed-size DataFrame (safe to broadcast)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_PATH = os.path.join(os.path.dirname(os.path.dirname(__file__)), "resources", "stopwords.txt")


def read_stopword_list(path: str | None = None) -> list[str]:
    """Words of a stop-word file: one per line, lines starting with '#' are comments."""
    with open(path or DEFAULT_PATH, encoding="utf-8") as f:
        return [ln.rstrip("\n") for ln in f if not ln.startswith("#")]


def stopwords_df(spark: SparkSession, words=None, path: str | None = None) -> DataFrame:
    """Distinct stop words as a one-column (``term``) DataFrame.

    ``words`` may be a list or an existing DataFrame with a ``term`` column; by default the
    shipped list is used. Union of several lists (SET1) is done with ``union().distinct()``.
    """
    if isinstance(words, DataFrame):
        return words.select("term").distinct()
    if words is None:
        words = read_stopword_list(path)
    # A local relation of literals (made distinct on the driver, the list is fixed and small):
    # no Python-side RDD, so no Python worker is started to scan it.
    return spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in dict.fromkeys(words)])).alias("term"))


def union_stopwords(*lists: DataFrame) -> DataFrame:
    """SET1: union of stop-word lists, made distinct."""
    out = lists[0].select("term")
    for other in lists[1:]:
        out = out.union(other.select("term"))
    return out.distinct()


# Extra words the exploration notebook adds to its list before counting words.
NOTEBOOK_EXTRA = ["https", "http", "com", "спасибо", "пожалуйста", "это", "вообще", "вроде"]
