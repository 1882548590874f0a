"""The three user flows of SURVEY §3 as composed DataFrame jobs.

- ``import_chat_export``: export files -> messages -> keywords, composed text -> chunks -> store
- ``search_notes``: allowed query vectors -> store (one namespace each, partition-pruned) -> top-k -> dedupe
- ``index_pending_notes``: notes not yet in the store -> chunks -> store (one set-based job, no per-user loop)

The store is parquet partitioned by (index_name, bucket of the namespace) with columns
(namespace, user_id, telegram_message_id, date, chunk_idx, chunk, n_chars, chunk_id, embedding).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.functions.embed import embed_column
from chatlake.operators import accounts as acc
from chatlake.operators import chunks as ch
from chatlake.operators import messages as msg
from chatlake.operators import retrieval as rt
from chatlake.operators import tfidf
from chatlake.session import materialize, ship_package
from chatlake.sources import exports as ex
from chatlake.sources.sinks import append_chunks, bucket_of, store_part, touched_buckets
from chatlake.sources.stopwords import stopwords_df
from chatlake.sources.tables import stored


def _to_store(spark: SparkSession, docs: DataFrame, store_path: str, embed_fn) -> None:
    """docs: (user_id, telegram_message_id or null, text, date or null, namespace, index_name)."""
    c = ch.chunk_documents(docs, id_cols=("user_id", "telegram_message_id"),
                           keep_cols=("namespace", "index_name", "date"))
    origin = F.coalesce(F.col("telegram_message_id").cast("string"), F.col("date"))
    c = c.withColumn("chunk_id", ch.chunk_id("namespace", origin, "chunk_idx", "chunk"))
    if embed_fn is not None:
        ship_package(spark)
        c = c.withColumn("embedding", embed_column("chunk", embed_fn))
    append_chunks(c, store_path)


def import_chat_export(spark: SparkSession, path: str, telegram_id: int, store_path: str, embed_fn=None,
                       index_name: str | None = None, max_messages: int | None = None):
    """Import one user's export(s): returns (messages, rejects, keywords) and appends the chunks.

    Imported chunks carry a date and no source (the reference's metadata for imports, Q1).
    """
    msgs, rejects = ex.parse_exports(spark, path, max_messages=max_messages)
    msgs = materialize(msgs, "import-messages")  # parsed once for the keywords and the chunks
    keywords = tfidf.top_terms(tfidf.keyword_weights(
        msgs.select(F.concat_ws(":", "file", "chat_idx", "pos").alias("doc_id"), F.col("msg_content").alias("text")),
        stopwords=stopwords_df(spark)), k=100)
    composed = msg.compose_index_text(msgs)
    tid = F.lit(telegram_id).cast("bigint")
    docs = composed.select(tid.alias("user_id"), F.lit(None).cast("bigint").alias("telegram_message_id"),
                           "text", "date", acc.namespace(tid).alias("namespace"),
                           (F.lit(index_name) if index_name else acc.shard(tid)).alias("index_name"))
    _to_store(spark, docs, store_path, embed_fn)
    return msgs, rejects, keywords


def index_pending_notes(spark: SparkSession, notes: DataFrame, users: DataFrame, store_path: str,
                        embed_fn=None) -> None:
    """Notes (user_id, telegram_message_id, text) not yet in the store are chunked and appended.

    Users need (user_id, telegram_id, index_name?); a user without an index gets the sticky shard.
    """
    u = users.select("user_id", acc.namespace("telegram_id").alias("namespace"),
                     acc.shard("telegram_id", "index_name" if "index_name" in users.columns else None)
                     .alias("index_name"))
    docs = (notes.where(acc.note_text("text").isNotNull()).join(u, "user_id")
            .select("user_id", "telegram_message_id", "text", F.lit(None).cast("string").alias("date"),
                    "namespace", "index_name"))
    store = stored(spark, store_path)
    if store is not None:  # notes whose chunks are stored, read from the folders of these notes only
        docs = docs.withColumn("bucket", bucket_of("namespace"))
        done = touched_buckets(store, docs).select("bucket", "namespace", "telegram_message_id").distinct()
        docs = docs.join(done, ["bucket", "namespace", "telegram_message_id"], "left_anti").drop("bucket")
    _to_store(spark, docs, store_path, embed_fn)


def allowed_queries(queries: DataFrame, users: DataFrame) -> DataFrame:
    """The queries whose users (telegram_id, access, within_limits) may search now; the rest, and unknown users', are answered without a search."""
    may = users.where(F.col("access") & F.col("within_limits")).select("telegram_id").distinct()
    return queries.join(may, "telegram_id", "left_semi")


def count_searches(users: DataFrame, searched: DataFrame) -> DataFrame:
    """AGG16: ``users`` with ``queries_count`` raised by the searches made (telegram_id), which are counted before they meet the users."""
    made = searched.groupBy("telegram_id").agg(F.count(F.lit(1)).alias("_made"))
    rest = [c for c in users.columns if c != "queries_count"]
    old = F.coalesce("queries_count", F.lit(0)) if "queries_count" in users.columns else F.lit(0)
    return users.join(made, "telegram_id", "left").select(*rest, (old + F.coalesce("_made", F.lit(0))).cast("bigint").alias("queries_count"))


def search_notes(spark: SparkSession, queries: DataFrame, store_path: str, k: int = rt.TOP_K, threshold: float | None = rt.SCORE_THRESHOLD,
                 include_imported: bool = False, users: DataFrame | None = None) -> DataFrame:
    """Top-k hits per query inside the user's index and namespace, best hit per source (FLT10/WIN3).

    ``queries``: (query_id, telegram_id, qvec, index_name?); a user without an index has the sticky shard. With ``users`` (telegram_id, access,
    within_limits) only allowed queries are searched. Only the store's folders of these queries are read, and its vectors are scored in place
    (``retrieval.score``). Imported chunks (date only) are kept when ``include_imported`` (distinct by text, Q1).
    """
    if users is not None:
        queries = allowed_queries(queries, users)
    index = acc.shard("telegram_id", "index_name" if "index_name" in queries.columns else None)
    q = queries.select("query_id", "qvec", acc.namespace("telegram_id").alias("namespace"), index.alias("index_name"))
    store, q = store_part(spark, store_path, q)
    hits = rt.top_k(rt.score(q, store.withColumnRenamed("telegram_message_id", "source"), ["index_name", "bucket", "namespace"],
                             vec_col="embedding", id_col="chunk_id", keep=("source", "date", "chunk"), k=k, threshold=threshold),
                    k=k, threshold=threshold, id_col="chunk_id")
    noted = rt.best_per_source(hits, id_col="chunk_id")
    if not include_imported:
        return noted
    dated = hits.where(F.col("source").isNull() & F.col("date").isNotNull()).dropDuplicates(["query_id", "chunk"])
    return noted.unionByName(dated)
