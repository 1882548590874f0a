"""Exact dedup with an extendible-hash index on shared files (DataFrame functions only).

Texts are equal when identical after each run of ASCII white space became one space; the key is a 64-bit hash of that form.

1. **Directory.** The distinct keys are counted by their first bits. While a cell of the directory holds more than ``capacity``
   keys, the directory doubles (one bit more); then buddy cells whose keys fit one bucket together share it, so a bucket of
   local depth d covers one d-bit prefix of the keys. Copies are one key, so they never overfill a bucket. Only keys that are all
   equal can't be split: they are one key.
2. **Owners.** Every row finds its bucket in the directory. Rows with equal (bucket, key, bytes) become one entry: the grouping combines
   copies before its exchange, so a text that a third of all rows repeat leaves each task once, and bytes decide, not hashes. Owner
   tasks take ranges of buckets, put the entries that share a key into a chain, by length and digest, and write them in key order.
3. **Lookup.** A row goes through the stored directory to its bucket, there to its key, and along the chain to the entry of its
   length and digest. A hot entry's rows sit on the left of a sort-merge join, which Spark splits at run time.

Defined results: a null text is the empty text; the smallest non-null id stays; rows without an id stay only where
their whole group has none; rows that repeat both id and text are one document and all carry ``kept`` true or all
false. An empty table gives an empty index and no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import SPACE, materialize, new_path, text_or_empty
from chatlake.session import broadcast_fits

CAPACITY = 4096
KEY_BITS = 64


def normalised(col: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(col), SPACE, " ")


def hash_key(norm: Column) -> Column:
    return F.xxhash64(norm)


def _prefix(key: str, depth: int) -> Column:
    """The first ``depth`` bits of a key."""
    return F.expr(f"shiftrightunsigned({key}, {KEY_BITS - depth})") if depth else F.lit(0).cast("long")


@dataclass(frozen=True)
class Index:
    """``directory``: cell (the first ``depth`` bits of a key) -> bucket, its local depth. ``entries``: bucket, depth, key, chain, n_bytes,
    text_sha256, keep_id, group_size; one row per distinct text."""

    directory: DataFrame
    depth: int
    entries: DataFrame


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(cell, bucket, local depth) over the distinct ``keys`` (key), and the global depth."""
    total = keys.count()
    depth = max(0, (max(1, -(-total // capacity)) - 1).bit_length())
    while True:
        cells = materialize(keys.groupBy(_prefix("key", depth).alias("cell")).agg(F.count(F.lit(1)).alias("n")), "cells")
        if depth == KEY_BITS or not (cells.agg(F.max("n")).first()[0] or 0) > capacity:
            break
        depth += 1  # the directory doubles
    cells = cells.withColumn("local", F.lit(depth))
    for d in range(depth - 1, -1, -1):  # buddies that fit together share a bucket; where none do, no shallower ones can
        parent = F.expr(f"shiftrightunsigned(cell, {depth - d})")
        fit = materialize(cells.groupBy(parent.alias("parent")).agg(F.sum("n").alias("sum")).where(F.col("sum") <= capacity).select("parent"), "buddies")
        if fit.isEmpty():
            break
        cells = cells.withColumn("at", parent).join(fit.hint("merge"), F.col("at") == F.col("parent"), "left")
        cells = materialize(cells.select("cell", "n", F.when(F.col("parent").isNotNull(), d).otherwise(F.col("local")).alias("local")), "cells")
    # the bucket is the smallest cell of its prefix: unique, and in key order
    shift = F.lit(depth) - F.col("local")
    bucket = F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.col("cell"), shift), shift)
    return cells.select("cell", bucket.alias("bucket"), "local"), depth


def addressed(rows: DataFrame, found: DataFrame, depth: int) -> DataFrame:
    """``rows`` (__key, ...) with ``__bucket`` and ``__local``, by way of the directory."""
    cells = found.select(F.col("cell").alias("__dcell"), F.col("bucket").alias("__bucket"), F.col("local").alias("__local"))
    cells = F.broadcast(cells) if broadcast_fits(found) else cells.hint("merge")
    return rows.withColumn("__cell", _prefix("__key", depth)).join(cells, F.col("__cell") == F.col("__dcell")).drop("__cell", "__dcell")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                path: str | None = None, key=hash_key) -> Index:
    """Write the index of ``docs`` to ``path`` (a new shared folder by default); ``key`` makes the 64-bit key of a normalised text."""
    spark = docs.sparkSession
    path = path or new_path(spark, "exact-index")
    norm = normalised(text_col)
    keys = materialize(docs.select(key(norm).alias("key")).distinct(), "keys")
    cells, depth = directory(keys, capacity)
    cells.write.parquet(f"{path}/directory")
    cells = spark.read.schema(cells.schema).parquet(f"{path}/directory")
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).select("id", "norm", key(F.col("norm")).alias("__key"))
    rows = addressed(rows, cells, depth)
    entries = rows.groupBy("__bucket", "__local", "__key", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entries = entries.select(F.col("__bucket").alias("bucket"), F.col("__local").alias("depth"), F.col("__key").alias("key"),
                             F.octet_length("norm").cast("long").alias("n_bytes"), F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    entries = materialize(entries, "entries")  # the owners' ranges are drawn from what is written
    owned = entries.repartitionByRange("bucket", "key")
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("n_bytes", "text_sha256"))
    owned.withColumn("chain", chain).sortWithinPartitions("bucket", "key", "chain").write.parquet(f"{path}/buckets")
    names = ["bucket", "depth", "key", "n_bytes", "text_sha256", "keep_id", "group_size"]
    return Index(cells, depth, spark.read.schema(owned.select(*names).withColumn("chain", F.lit(1)).schema).parquet(f"{path}/buckets"))


def annotate(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", key=hash_key) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 from ``index``; columns of these names are replaced."""
    added = ("keep_id", "group_size", "kept", "text_sha256")
    norm = normalised(text_col)
    rows = docs.withColumns({"__key": key(norm), "__sha": F.sha2(norm, 256), "__bytes": F.octet_length(norm).cast("long")})
    rows = addressed(rows.drop(*(c for c in added if c not in (id_col, text_col))), index.directory, index.depth)
    entries = index.entries.select(*(F.col(c).alias(f"__e_{c}") for c in ("bucket", "key", "n_bytes", "text_sha256", "keep_id", "group_size")))
    same = ((F.col("__bucket") == F.col("__e_bucket")) & (F.col("__key") == F.col("__e_key"))
            & (F.col("__bytes") == F.col("__e_n_bytes")) & (F.col("__sha") == F.col("__e_text_sha256")))
    joined = rows.join(entries.hint("merge"), same)
    joined = joined.withColumns({"keep_id": F.col("__e_keep_id"), "group_size": F.col("__e_group_size"),
                                 "kept": F.col(id_col).eqNullSafe(F.col("__e_keep_id")), "text_sha256": F.col("__sha")})
    return joined.drop("__key", "__sha", "__bytes", "__bucket", "__local", *(c for c in joined.columns if c.startswith("__e_")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Every row of ``docs`` with its group: keep_id, group_size, kept, text_sha256."""
    return annotate(docs, build_index(docs, id_col, text_col, capacity), id_col, text_col)
