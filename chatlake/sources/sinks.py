"""Sinks and the chunk store (SNK1-7).

The chunk store is parquet partitioned by (index_name, bucket), a namespace's rows in one hash bucket: the number of folders and of
files an append writes is bounded by the buckets, not by the users. A search and an append read only the buckets they
meet, an index is dropped as a folder, and a namespace is cleared by writing its one bucket anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.session import bounded_broadcast, materialize
from chatlake.sources.exports import MESSAGE_COLUMNS
from chatlake.sources.tables import stored

BUCKETS = 64
STORE_KEYS = ["index_name", "bucket", "namespace"]


def bucket_of(namespace: str | Column) -> Column:
    """The store's hash bucket of a namespace."""
    return F.pmod(F.xxhash64(namespace), F.lit(BUCKETS)).cast("int")


def _rebalanced(df: DataFrame, *cols: str) -> DataFrame:
    """Rows of a folder brought together before they are written; Spark splits a large folder's rows over tasks and merges small ones."""
    return df.hint("rebalance", *(F.col(c) for c in cols))


def _csv(writer):
    """CSV options shared by the writers: whitespace as is (Spark trims it by default), quotes doubled."""
    return (writer.option("header", True).option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).option("escape", '"'))


#: On a local disk (``file:`` only; other file systems do not read these settings) Hadoop starts a ``chmod`` process for each folder, file and
#: checksum file. The plain writer leaves no checksum file, which readers do not need, and so starts one process less.
LOCAL_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: A task writes about so many folders, whatever their bytes; a folder with more rows than this is left to Spark, which splits it over tasks.
FOLDERS_A_TASK = 100
LARGE_FOLDER = 200_000


def _by_folder(rows: DataFrame, col: str) -> DataFrame:
    """Rows of a folder brought together before they are written, by so many tasks as the number of folders asks for."""
    sizes = rows.groupBy(F.col(col).alias("_folder")).agg(F.count(F.lit(1)).alias("_rows"))
    large = F.col("_rows") > LARGE_FOLDER
    n, n_rows, n_large = sizes.agg(F.count(F.lit(1)), F.sum("_rows"), F.count_if(large)).first()
    tasks = max(n // FOLDERS_A_TASK, (n_rows or 0) // LARGE_FOLDER) + 1
    if not n_large:
        return rows.repartition(tasks, col)
    found, _ = bounded_broadcast(sizes.where(large), "large-folders")
    match = F.col(col).eqNullSafe(F.col("_folder"))
    return rows.join(found, match, "left_anti").repartition(tasks, col).unionByName(_rebalanced(rows.join(found, match, "left_semi"), col))


def _csv_folders(rows: DataFrame, col: str, path: str, **options) -> str:
    """One CSV folder per value of ``col``; there are as many folders as values, so that what a folder costs counts."""
    _csv(_by_folder(rows, col).write.mode("overwrite").partitionBy(col)).options(**LOCAL_FILES, **options).csv(path)
    return path


def index_stats(store: DataFrame) -> DataFrame:
    """SNK6-7: namespaces present in each index and their record counts (partial aggregate)."""
    return store.groupBy("index_name", "namespace").agg(F.count(F.lit(1)).alias("n_records"))


def list_indexes(store: DataFrame) -> DataFrame:
    """SNK7: the index names present in the store."""
    return store.select("index_name").distinct()


def clear_namespaces(store: DataFrame, index_names) -> DataFrame:
    """SNK5 (as a DataFrame): the store without any record of the given indexes."""
    return store.where(~F.col("index_name").isin(list(index_names)))


def _stamped(path: str, stamp: str | None) -> str:
    return f"{path}_{stamp}" if stamp else path


def stamp_of(spark: SparkSession, at: str) -> str:
    """The time label of a written name."""
    return spark.range(1).select(F.date_format(F.lit(at).cast("timestamp"), "yyyy-MM-dd_HH-mm-ss")).first()[0]


def write_messages_csv(msgs: DataFrame, path: str, partition_col: str = "chat_name", stamp: str | None = None) -> str:
    """SNK1: one CSV folder per chat, header, all fields quoted (Spark cannot quote only text); returns the (stamped) path."""
    cols = [c for c in MESSAGE_COLUMNS if c in msgs.columns]
    return _csv_folders(msgs.select(*cols, partition_col), partition_col, _stamped(path, stamp), quoteAll=True)


def write_text_date_csv(df: DataFrame, path: str) -> None:
    """SNK2: the composed ``text,date`` of an import."""
    _csv(df.select("text", "date").write.mode("overwrite")).csv(path)


def write_pending_notes_csv(notes: DataFrame, path: str, user_col: str = "telegram_id", stamp: str | None = None) -> str:
    """SNK3: un-indexed notes per user, ``message_id,text``, minimal quoting; returns the (stamped) path."""
    pending = (notes.where(~F.col("is_vectorized"))
               .select(user_col, F.col("telegram_message_id").alias("message_id"), "text"))
    return _csv_folders(pending, user_col, _stamped(path, stamp))


def touched_buckets(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The part of the store in the (index, bucket) folders that ``rows`` name: a partition filter of at most indexes x BUCKETS pairs."""
    pairs = rows.select("index_name", "bucket").distinct().collect()
    inside = F.lit(False)
    for index in {r[0] for r in pairs}:
        inside |= F.col("index_name").eqNullSafe(F.lit(index)) & F.col("bucket").isin([r[1] for r in pairs if r[0] == index])
    return store.where(inside)


def append_chunks(chunks: DataFrame, path: str) -> None:
    """SNK4: append chunks whose deterministic ``chunk_id`` is not stored yet (idempotent re-runs).

    The chunks are made once and written aside. Only the stored ids of the folders they go to are read; where the new
    ids measure small enough, they are broadcast and the stored side is not moved at all.
    """
    keys = [*STORE_KEYS, "chunk_id"]
    new = chunks.withColumn("bucket", bucket_of("namespace")).dropDuplicates(keys)  # the id is a digest of the chunk: equal ids are equal rows
    new = materialize(new, "new-chunks")
    old = stored(chunks.sparkSession, path)
    if old is not None:
        ids, _ = bounded_broadcast(new.select(*keys), "new-ids")
        known = touched_buckets(old, new).select(*keys).join(ids, keys, "left_semi")
        new = new.join(known, keys, "left_anti")
    _rebalanced(new, "index_name", "bucket").write.mode("append").partitionBy("index_name", "bucket").parquet(path)


def store_part(spark: SparkSession, path: str, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the store's rows in the folders that the queries (index_name, namespace) name, the queries with their bucket)."""
    q = materialize(queries.withColumn("bucket", bucket_of("namespace")), "search-keys")
    return touched_buckets(spark.read.parquet(path), q), q


def drop_index(spark: SparkSession, path: str, index_name: str) -> bool:
    """SNK5: all records of an index, by removing its folder; no other file is read or written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path, f"index_name={index_name}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear_namespace(spark: SparkSession, path: str, index_name: str, namespace: str) -> None:
    """SNK5: one namespace of an index: its bucket's folder is written anew without it, no other folder is touched."""
    bucket = spark.range(1).select(bucket_of(F.lit(namespace))).first()[0]
    part = spark.read.parquet(path).where((F.col("index_name") == index_name) & (F.col("bucket") == bucket))
    rest = materialize(part.where(~F.col("namespace").eqNullSafe(F.lit(namespace))), "bucket-rest")
    if rest.isEmpty():
        folder = spark._jvm.org.apache.hadoop.fs.Path(path, f"index_name={index_name}/bucket={bucket}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        return
    _rebalanced(rest, "index_name", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("index_name", "bucket").parquet(path)
