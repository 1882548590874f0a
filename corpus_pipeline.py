"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Toxic documents go; of equal texts one row stays; of every group of near-duplicates one document stays; the sources are mixed to
their target weights (a document once for each pass that takes it); the mix is encoded by byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given. Columns a stage doesn't need pass through
under other names, so they may be called like its results. Defined results, besides those of the operators: documents
without an id are judged by their texts and are never dropped as near-duplicates; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm import bpe, exact_dedup, minhash, mixing, toxicity
from chatlake.llm.common import new_path, ship, table
from chatlake.llm.queries import bpe_path, toxicity_model

NEEDED = ("doc_id", "text", "source")
TOXIC = 0.3


def _aside(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns that no stage reads under names that no stage uses."""
    return docs.toDF(*(c if c in NEEDED else f"__column_{i}" for i, c in enumerate(docs.columns)))


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c if c in NEEDED else f"__column_{i}").alias(c) for i, c in enumerate(docs.columns)))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores below ``TOXIC``."""
    rows = _aside(docs)
    scored = toxicity.score(rows, toxicity_model(spark, rows.select("doc_id", "text"), sf_dir), keep_text=True)
    return _back(scored.where(F.col("score") < TOXIC), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id."""
    return _back(exact_dedup.exact_dedup(_aside(docs)).where("kept"), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest doc_id."""
    rows = _aside(docs)
    judged = minhash.judge(rows.select("doc_id", "text"))
    go = judged.where("doc_id is not null and cls is not null and not kept").select("doc_id", F.col("cls").alias("__cls")).distinct()
    rows = ship(rows).withColumn("__cls", minhash.class_of(F.col("text")))  # rows that repeat a doc_id go by their own text
    return _back(rows.join(go, ["doc_id", "__cls"], "left_anti"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' documents, once for each pass that takes them, written in training order. The positions are not kept: the order
    is that of the stage's own files only, and the result of ``run`` has none."""
    return _back(mixing.curriculum(_aside(docs)), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and whether they decode to its text."""
    rows = docs.select("doc_id", "source", "text")
    done = bpe.encode(rows, bpe_path(), check=True)
    return done.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("minhash near-dedup", near), ("mixing", mix), ("bpe", encode)]

ORACLE_SQL = None  # a trained score, MinHash components and BPE have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name.replace(' ', '-')}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
