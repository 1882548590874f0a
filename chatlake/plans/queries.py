"""Named queries over the driver tables: each is ``(spark, sf_dir) -> DataFrame``.

Table roles (see README): documents = messages/notes (source = chat or user),
conversations = chat rows, embeddings = vector index (label = namespace),
events = user message stream, orders = payments, customer = users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.operators import tfidf
from chatlake.sources.stopwords import stopwords_df
from chatlake.sources.tables import documents, table

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def user_of(source: str):
    """The user behind a note's source ``srcN``: N, or null where the source has another form."""
    return F.regexp_extract(source, "^src([0-9]+)$", 1).try_cast("bigint")


# ---------------------------------------------------------------- keywords (AGG1-5, LIM3, JN4)

@query
def keyword_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")  # tfidf partitions by doc itself
    w = tfidf.keyword_weights(docs, stopwords=stopwords_df(spark))
    return tfidf.top_terms(w, k=100)


@query
def keyword_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")  # tfidf partitions by doc itself
    w = tfidf.keyword_weights(docs, group_cols=["source"], stopwords=stopwords_df(spark))
    return tfidf.top_terms(w, k=100, group_cols=["source"])


@query
def keyword_notebook_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")  # tfidf partitions by doc itself
    w = tfidf.keyword_weights(docs, keep_colon=False, stopwords=None)
    return tfidf.top_terms(w, k=100)


@query
def vocab_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return tfidf.vocabulary_shape(docs, keep_colon=False)


# ---------------------------------------------------------------- word statistics (AGG6-11, STRF5, SRT3)

from chatlake.operators import messages as msg  # noqa: E402
from chatlake.operators import text_stats as ts  # noqa: E402
from chatlake.sources.stopwords import NOTEBOOK_EXTRA, union_stopwords  # noqa: E402


@query
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sw = union_stopwords(stopwords_df(spark), stopwords_df(spark, NOTEBOOK_EXTRA))
    return ts.term_counts(documents(spark, sf_dir, "doc_id", "text"), stopwords=sw)


@query
def sorted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.sorted_texts(documents(spark, sf_dir, "doc_id", "text"))


@query
def words_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "doc_id", "text")
    return ts.with_words_count(d).select("doc_id", "words_count")


@query
def words_mean_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.words_summary(documents(spark, sf_dir, "doc_id", "lang", "text"), group_cols=["lang"])


@query
def words_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.words_histogram(documents(spark, sf_dir, "doc_id", "text"))


@query
def corpus_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.corpus_chars(table(spark, sf_dir, "documents").select("text"))


@query
def conversation_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.concat_texts(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query
def messages_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"))
    return ts.rows_per_unit(ev, ["user_id", "day"]).withColumnRenamed("rows_per_unit", "n_messages")


# ---------------------------------------------------------------- chat rows (SRT1, LIM1, PRJ6, STRF10-11, SET5)

def _chat_messages(spark, sf_dir):
    return msg.conversation_messages(table(spark, sf_dir, "conversations"))


@query
def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msg.sort_messages(_chat_messages(spark, sf_dir))


@query
def last_n_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is a third of the messages, so it falls inside a chat."""
    m = _chat_messages(spark, sf_dir)
    return msg.sort_messages(msg.last_n_by_arrival(m, n=m.count() // 3, piece=4))


@query
def compose_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msg.compose_index_text(_chat_messages(spark, sf_dir))


@query
def render_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    composed = msg.compose_index_text(_chat_messages(spark, sf_dir))
    return msg.render_hits(composed.withColumnRenamed("chat_idx", "query_id"))


@query
def distinct_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msg.distinct_chats(_chat_messages(spark, sf_dir))


# ---------------------------------------------------------------- accounts

from chatlake.operators import accounts as acc  # noqa: E402
from chatlake.operators import modes  # noqa: E402

AS_OF_SUBSCRIPTION = "2001-01-01 00:00:00"
AS_OF_QUOTA = "2024-01-30 00:00:00"
# A parameter table: users with free access (any list of usernames works).
ALLOWLIST = ["Customer#000000001", "Customer#000000002", "Customer#000000003"]


def _users(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    inviter = F.expr("c_custkey div 10")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("telegram_id"),
                    F.col("c_name").alias("username"),
                    F.when(inviter != F.col("c_custkey"), inviter).alias("invited_by_id"))


def _payments(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    digit = F.substring("o_orderpriority", 1, 1)
    months = (F.when(digit == "1", 1).when(digit == "2", 3).when(digit == "3", 6).when(digit == "4", 12))
    return o.select(F.col("o_orderkey").alias("payment_id"), F.col("o_custkey").alias("user_id"),
                    F.col("o_orderdate").alias("paid_at"), months.alias("months"))


def _valid_payments(spark, sf_dir):
    return _payments(spark, sf_dir).join(acc.price_table(spark).select("months"), "months", "left_semi")


def _users_full(spark, sf_dir):
    """The users with their stored volume, a figure of the customer's balance (null for senders that are no customer)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.greatest("c_acctbal", F.lit(0.0)) / 45).alias("vector_storage_volume"))
    known = _users(spark, sf_dir).join(c, "user_id")
    senders = table(spark, sf_dir, "events").select(F.col("user_id"), F.col("user_id").alias("telegram_id"), F.lit("there").alias("username"))
    return acc.insert_if_absent(known, senders.where("user_id is not null").distinct(), key="telegram_id")


def _events_as_messages(spark, sf_dir):
    """Events as messages: a command (null: plain text), the plan a payment is for, and what the guards of the mode machine ask for.

    signup = /start, view = /search, purchase = a payment (for a gift where k is 9), click = plain text, error = one of the other commands by k, the last digit of
    the event's number.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", (F.get_json_object("props", "$.k").cast("int") % 10).alias("k"))
    of = lambda t: F.col("event_type") == t
    rest = F.element_at(F.array(*(F.lit(c) for c in ("/import", "/import", "/subscribe", "/subscribe", "/note", "/chat", "/chat", "/chat", "reset", "/help"))),
                        F.col("k") + 1)
    cmd = F.when(of("signup"), "/start").when(of("view"), "/search").when(of("purchase"), "payment").when(of("error"), rest)
    plan = F.element_at(F.array(*(F.lit(m) for m in (1, 3, 6, 12))), F.col("k") % 4 + 1)
    return e.select("event_id", "ts", "user_id", cmd.alias("command"), F.when(of("purchase") & (F.col("k") != 9), plan).alias("months"),
                    (F.col("k") != 9).alias("paid"), (of("click") & F.col("k").isin(1, 3, 6)).alias("valid_choice"), (F.col("value") >= 30).alias("has_hits"))


def _guarded_messages(spark, sf_dir):
    notes = table(spark, sf_dir, "documents").select(user_of("source").alias("user_id")).where("user_id is not null")
    allow = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in ALLOWLIST])).alias("username"))
    return modes.with_guards(_events_as_messages(spark, sf_dir), _users_full(spark, sf_dir), notes, allow)


@query
def subscription_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.subscription_end(_valid_payments(spark, sf_dir))


@query
def subscription_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.running_subscription_end(_valid_payments(spark, sf_dir))


@query
def active_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = acc.subscription_end(_valid_payments(spark, sf_dir))
    allow = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in ALLOWLIST])).alias("username"))
    return acc.with_access(_users(spark, sf_dir), ends, AS_OF_SUBSCRIPTION, allow).select(
        "user_id", "username", "subscription_end_date", "active", "access")


@query
def referral_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = acc.subscription_end(_valid_payments(spark, sf_dir))
    return acc.referral_counts(_users(spark, sf_dir), ends)


@query
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming = (table(spark, sf_dir, "events").select("user_id").distinct()
                .select("user_id", F.col("user_id").alias("telegram_id"),
                        acc.F.lit("there").alias("username")))
    return acc.insert_if_absent(_users(spark, sf_dir), incoming, key="telegram_id")


@query
def search_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "view")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("queries_count"))


@query
def quota_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return acc.trailing_24h(e)


@query
def quota_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.quota_as_of(_users_full(spark, sf_dir), table(spark, sf_dir, "events").select("user_id", "ts"), AS_OF_QUOTA)


@query
def mode_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.route(_guarded_messages(spark, sf_dir)).select(
        "event_id", "user_id", "ts", "command", "mode_before", "mode_after")


@query
def inviter_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN2: a signup is a /start; its deep link names the inviter 200 k, k the last digit of the event's number (no link where it is 5)."""
    k = F.get_json_object("props", "$.k").cast("int") % 10
    starts = table(spark, sf_dir, "events").where(F.col("event_type") == "signup").select(
        F.col("user_id").alias("telegram_id"), F.when(k != 5, (k * 200).cast("bigint")).alias("inviter"), "ts", "event_id")
    return acc.assign_inviters(_users_full(spark, sf_dir), starts).select("user_id", "telegram_id", "username", "invited_by_id")


@query
def payload_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _payments(spark, sf_dir).select(
        "payment_id", F.concat(F.lit("subscribe_"), F.coalesce(F.col("months").cast("string"), F.lit("x")))
        .alias("payload"))
    goal, months = acc.payload_split("payload")
    return p.select("payment_id", "payload", goal.alias("goal"), months.alias("months_num"))


@query
def event_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DTF2: the events' times written in eight ISO forms, and texts that are none, read back."""
    from chatlake.functions.text import iso_datetime
    e = table(spark, sf_dir, "events")
    forms = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd", "yyyyMMdd'T'HHmmss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH",
             "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'-03:30'")
    text = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        text = F.when(F.col("event_id") % 8 == k, F.date_format("ts", form)).otherwise(text)
    e = e.select("event_id", F.when(F.col("event_type") == "error", F.col("props")).otherwise(text).alias("event_text"))
    parsed = iso_datetime("event_text")
    return e.select("event_id", "event_text", parsed["at"].alias("event_at"), parsed["offset"].alias("utc_offset"))


@query
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.expr("try_parse_json(props)")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"),
        F.expr("variant_get(try_parse_json(props), '$.k', 'variant') IS NOT NULL").alias("has_k"),
        F.when(F.expr("schema_of_variant(try_parse_json(props))").startswith("OBJECT"), "OBJECT")
        .when(F.expr("schema_of_variant(try_parse_json(props))").startswith("ARRAY"), "ARRAY")
        .when(v.isNotNull(), "SCALAR").alias("kind"))


@query
def first_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.first_per_group(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")


@query
def price_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.priced_choices(_payments(spark, sf_dir), _users(spark, sf_dir), acc.price_table(spark))


@query
def choice_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.rejected_choices(_payments(spark, sf_dir), acc.price_table(spark)).select("payment_id", "user_id")


@query
def subscription_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    plus = F.col("o_orderdate") + F.make_dt_interval(days=F.lit(acc.DAYS_PER_MONTH))
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd_HH-mm-ss").alias("paid_label"),
                    F.date_format(plus, "yyyy-MM-dd_HH-mm-ss").alias("end_label"))


@query
def note_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chatlake.functions.text import name_or_default, preview
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    notes = (d.where(acc.note_text("text").isNotNull())
             .select(F.col("doc_id").alias("telegram_message_id"),
                     user_of("source").alias("user_id"), "text"))
    u = _users(spark, sf_dir)
    return (notes.join(u, "user_id")
            .select("user_id", acc.namespace("telegram_id").alias("namespace"),
                    name_or_default("username").alias("username"),
                    F.col("text").alias("page_content"),
                    F.col("telegram_message_id").cast("string").alias("source"),
                    preview("text").alias("preview")))


@query
def note_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT5: messages as notes: every fourth is a photo whose text is its caption, every seventh of the rest is empty; empty ones are no notes."""
    c = table(spark, sf_dir, "conversations")
    photo = F.col("turn") % 4 == 3
    said = F.when(photo, F.when(F.col("turn") % 8 == 3, "")).when((F.col("conv_id") + F.col("turn")) % 7 == 0, "").otherwise(F.col("text"))
    rows = c.select("conv_id", "turn", said.alias("said"), F.when(photo, F.col("text")).alias("caption"))
    return rows.select("conv_id", "turn", acc.note_text("said", "caption").alias("note")).where("note is not null")


@query
def users_with_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "documents").select(user_of("source").alias("user_id"))
    return acc.users_with_notes(_users(spark, sf_dir), notes).select("user_id", "username")


@query
def pending_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


# ---------------------------------------------------------------- chunking and retrieval

from chatlake.operators import chunks as ch  # noqa: E402
from chatlake.operators import retrieval as rt  # noqa: E402


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding", "label", acc.namespace("label").alias("namespace"),
                    acc.shard("label").alias("index_name"))


def _centroid_queries(vectors):
    return rt.centroids(vectors, "namespace").withColumn("query_id", F.col("namespace"))


def _hits(spark, sf_dir, k, threshold):
    v = _vectors(spark, sf_dir)
    return rt.top_k(rt.score(_centroid_queries(v), v, "namespace", k=k, threshold=threshold), k=k, threshold=threshold)


def _with_note(spark, sf_dir, hits):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source",
                                                     F.col("text").alias("page_content"))
    return rt.with_documents(hits, docs, "vec_id")


@query
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "doc_id", "text")
    return ch.chunk_documents(d, separator="\n")


@query
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hits(spark, sf_dir, rt.TOP_K, rt.SCORE_THRESHOLD)
    return h.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query
def hits_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _with_note(spark, sf_dir, _hits(spark, sf_dir, rt.TOP_K, rt.SCORE_THRESHOLD))
    return rt.best_per_source(h).select("query_id", "source", "vec_id", F.round("score", 6).alias("score"))


@query
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _with_note(spark, sf_dir, _hits(spark, sf_dir, rt.RETRIEVER_K, None))
    return rt.assemble_context(h)


@query
def context_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _with_note(spark, sf_dir, _hits(spark, sf_dir, rt.RETRIEVER_K, None))
    answer = F.concat(F.lit("Answer to "), F.col("query_id"))  # the model's answer is a column given to the operator
    return rt.assemble_context(h, tail=rt.CONTEXT_TAIL, answer=answer)


@query
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chatlake.sources.sinks import index_stats as stats
    return stats(_vectors(spark, sf_dir))


@query
def index_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7: the indexes that hold vectors."""
    from chatlake.sources.sinks import list_indexes
    return list_indexes(_vectors(spark, sf_dir))


def letter_counts(texts):
    """An embedding that SQL can repeat: how often each of eight letters occurs."""
    import numpy as np

    return [np.array([t.count(c) for c in "aeinorst"], np.float32) for t in texts]


@query
def note_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD5: every note embedded in Arrow batches."""
    from chatlake.functions.embed import embed_column
    from chatlake.session import ship_package
    ship_package(spark)
    d = documents(spark, sf_dir, "doc_id", "text").where("text is not null")
    return d.select("doc_id", embed_column("text", letter_counts).cast("array<bigint>").alias("v"))


@query
def gated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches of the users behind the namespaces, made only with access and within the limits: hits per user, and the raised search counter.

    A user is the namespace's label; access is a paid month or the allow-list, the limits are those of ``quota_asof``.
    """
    from chatlake.plans.flows import allowed_queries, count_searches
    v = _vectors(spark, sf_dir)
    known = _users_full(spark, sf_dir)
    allow = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in ALLOWLIST])).alias("username"))
    access = acc.with_access(known, acc.subscription_end(_valid_payments(spark, sf_dir)), AS_OF_SUBSCRIPTION, allow).select("user_id", "telegram_id", "access")
    limits = acc.quota_as_of(known, table(spark, sf_dir, "events").select("user_id", "ts"), AS_OF_QUOTA).select("user_id", "within_limits")
    made = table(spark, sf_dir, "events").where(F.col("event_type") == "view").groupBy("user_id").agg(F.count(F.lit(1)).alias("queries_count"))
    users = access.join(limits, "user_id").join(made, "user_id", "left")
    asked = _centroid_queries(v).withColumn("telegram_id", F.regexp_extract("namespace", "^user_([0-9]+)_notes$", 1).try_cast("bigint"))
    allowed = allowed_queries(asked, users)
    hits = rt.top_k(rt.score(allowed, v, "namespace", k=rt.TOP_K, threshold=rt.SCORE_THRESHOLD), k=rt.TOP_K, threshold=rt.SCORE_THRESHOLD)
    found = hits.groupBy("telegram_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))).alias("best"))
    users = count_searches(users, allowed).join(asked.select("telegram_id"), "telegram_id", "left_semi")
    return users.join(found, "telegram_id", "left").select("telegram_id", "access", "within_limits", "queries_count",
                                                           F.array_join(F.transform("best", lambda x: x["vec_id"].cast("string")), ",").alias("hits"))


@query
def index_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5: the vectors stored by index and bucket; one index dropped, one namespace of another cleared; what is left."""
    import uuid

    from chatlake.session import scratch_path
    from chatlake.sources import sinks
    path = scratch_path(spark, f"index_clear/{uuid.uuid4().hex}")
    v = _vectors(spark, sf_dir)
    sinks.append_chunks(v.select("index_name", "namespace", F.col("vec_id").cast("string").alias("chunk_id"), "embedding"), path)
    sinks.drop_index(spark, path, "index-1")
    sinks.clear_namespace(spark, path, "index-2", "user_1_notes")
    return sinks.index_stats(spark.read.parquet(path))


# ---------------------------------------------------------------- chat-export round trip (SRC1-5, PRJ1-5)

@query
def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark writes each conversation as a chat export (JSON lines, one export per line) into the
    shared checkpoint folder, then the export reader parses it back into message rows."""
    import uuid

    from chatlake.session import scratch_path
    from chatlake.sources import exports as ex
    conv = table(spark, sf_dir, "conversations")
    unix = F.lit(msg.BASE_EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60
    message = F.struct(
        F.col("turn").alias("id"),
        F.when(F.col("role") == "system", "service").otherwise("message").alias("type"),
        msg.iso_from_epoch(unix).alias("date"),
        unix.cast("string").alias("date_unixtime"),
        F.col("role").alias("from"),
        F.concat(F.lit("user"), F.col("conv_id").cast("string")).alias("from_id"),
        F.col("text").alias("text"))
    chats = ex.chat_exports(conv.select("conv_id", "turn", message.alias("m")), "conv_id", "turn", "m",
                            F.concat(F.lit("chat "), F.col("conv_id").cast("string")))
    out = scratch_path(spark, f"export_roundtrip/{uuid.uuid4().hex}")
    chats.write.mode("overwrite").json(out)
    msgs, _ = ex.parse_exports(spark, out + "/*.json", multi_line=False)
    return msgs.select("chat_name", *ex.MESSAGE_COLUMNS)


def _rich_exports(spark: SparkSession, sf_dir: str) -> str:
    """Exports written from the conversations in all three layouts, with every content branch, lists of typed parts, absent and null
    keys, and lines without a layout; returns their folder.

    kind = (7 conv_id + turn) mod 9: text, part list, sticker, media without a file, file, photo with a caption list, poll, location,
    service. conv_id mod 3: one chat, ``chats`` (its second chat has no name), ``left_chats``; conv_id mod 11 = 10: no layout.
    """
    import uuid

    from chatlake.session import scratch_path
    from chatlake.sources import exports as ex
    c = table(spark, sf_dir, "conversations").withColumn("kind", (F.col("conv_id") * 7 + F.col("turn")) % 9)
    unix = F.lit(msg.BASE_EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60
    only = lambda k, v: F.when(F.col("kind") == k, v)
    fields = F.struct(
        F.col("turn").alias("id"), F.when(F.col("kind") == 8, "service").otherwise("message").alias("type"),
        msg.iso_from_epoch(unix).alias("date"), unix.cast("string").alias("date_unixtime"),
        F.when(F.col("conv_id") % 4 != 0, F.col("role")).alias("from"), F.concat(F.lit("user"), F.col("conv_id").cast("string")).alias("from_id"),
        F.when(F.col("turn") % 2 == 1, "someone").alias("forwarded_from"),
        F.when(F.col("turn") % 3 == 2, F.col("turn") - 1).alias("reply_to_message_id"),
        F.when(F.col("kind") == 2, "sticker").when(F.col("kind") == 3, "video_file").alias("media_type"),
        F.when(F.col("kind") == 2, "s.webp").when(F.col("kind") == 4, "doc.pdf").alias("file"), only(5, F.lit("p.jpg")).alias("photo"),
        only(6, F.struct(F.col("turn").alias("total_voters"))).alias("poll"),
        only(7, F.struct(F.lit(1.5).alias("latitude"), F.lit(2.25).alias("longitude"))).alias("location_information"))
    said = F.to_json(F.struct("text"), {"ignoreNullFields": "false"})
    said = F.substring(said, F.lit(9), F.length(said) - 9)  # the JSON of the text alone
    parts = F.concat(F.lit('["see ",{"type":"link","text":'), said, F.lit('},{"type":"mention","text":"@a"},{"type":"plain"},5]'))
    text = F.when(F.col("kind").isin(1, 5), parts).otherwise(said)
    base = F.to_json(fields)
    c = c.withColumn("json", F.concat(F.substring(base, F.lit(1), F.length(base) - 1), F.lit(',"text":'), text, F.lit("}")))
    pieces = ex.chat_pieces(c, "conv_id", "turn", "json", F.concat(F.lit("chat "), F.col("conv_id").cast("string")))
    two = F.struct(F.array(F.struct("name", "messages"), F.struct(F.lit(None).cast("string").alias("name"), "messages")).alias("list"))
    layout = F.when(F.col("conv_id") % 11 == 10, "none").otherwise(F.element_at(F.array(F.lit("single"), F.lit("chats"), F.lit("left_chats")), (F.col("conv_id") % 3 + 1).cast("int")))
    given = lambda k, v: F.when(layout == k, v)
    out = scratch_path(spark, f"export_rich/{uuid.uuid4().hex}")
    pieces = pieces.where((layout != "none") | layout.isNull() | (F.col("first_pos") == 0))  # one line of a chat without a layout
    pieces.select(F.col("conv_id").alias("id"), "first_pos", given("single", F.col("name")).alias("name"), given("single", F.col("messages")).alias("messages"),
                  given("chats", two).alias("chats"), given("left_chats", two).alias("left_chats")).write.json(out)
    return out


@query
def export_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chatlake.sources import exports as ex
    msgs, _ = ex.parse_exports(spark, _rich_exports(spark, sf_dir) + "/*.json", multi_line=False)
    return msgs.select("chat_name", *ex.MESSAGE_COLUMNS)


@query
def export_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chatlake.sources import exports as ex
    _, bad = ex.split_rejects(ex.read_exports(spark, _rich_exports(spark, sf_dir) + "/*.json", multi_line=False))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query
def import_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordinary import (most messages not forwarded) from export to stored chunks, read back from the store."""
    import uuid

    from chatlake.session import scratch_path
    from chatlake.sources import exports as ex
    from chatlake.sources.sinks import append_chunks
    msgs, _ = ex.parse_exports(spark, _rich_exports(spark, sf_dir) + "/*.json", multi_line=False)
    tid = F.lit(42).cast("bigint")
    docs = msg.compose_index_text(msgs).select("chat_idx", "pos", "text", "date", acc.namespace(tid).alias("namespace"), acc.shard(tid).alias("index_name"))
    c = ch.chunk_documents(docs, id_cols=("chat_idx", "pos"), separator="\n", keep_cols=("namespace", "index_name", "date"))
    c = c.withColumn("chunk_id", ch.chunk_id("namespace", F.concat_ws(":", "chat_idx", "pos"), "chunk_idx", "chunk"))
    path = scratch_path(spark, f"import_chunks/{uuid.uuid4().hex}")
    append_chunks(c, path)
    return spark.read.parquet(path).select("namespace", "date", "chunk_idx", "chunk", "n_chars")


@query
def messages_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1: one CSV folder per chat, read back (empty and missing values are both null)."""
    import uuid

    from chatlake.session import scratch_path
    from chatlake.sources.csv import read_csv
    from chatlake.sources.sinks import stamp_of, write_messages_csv
    path = scratch_path(spark, f"messages_csv/{uuid.uuid4().hex}")
    m = _chat_messages(spark, sf_dir).select("chat_name", "msg_id", "sender", "date", "msg_content")
    path = write_messages_csv(m, path, stamp=stamp_of(spark, AS_OF_QUOTA))
    return read_csv(spark, path, "msg_id bigint, sender string, date string, msg_content string, chat_name string")


@query
def notes_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: notes not indexed yet (no label), one CSV folder per user, read back."""
    import uuid

    from chatlake.session import scratch_path
    from chatlake.sources.csv import read_csv
    from chatlake.sources.sinks import stamp_of, write_pending_notes_csv
    path = scratch_path(spark, f"notes_csv/{uuid.uuid4().hex}")
    d = table(spark, sf_dir, "documents").select(user_of("source").alias("telegram_id"), F.col("doc_id").alias("telegram_message_id"), "text")
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("telegram_message_id"), F.lit(True).alias("is_vectorized")).distinct()
    notes = d.join(done, "telegram_message_id", "left").withColumn("is_vectorized", F.coalesce("is_vectorized", F.lit(False)))
    path = write_pending_notes_csv(notes, path, stamp=stamp_of(spark, AS_OF_QUOTA))
    return read_csv(spark, path, "message_id bigint, text string, telegram_id bigint")


# ---------------------------------------------------------------- streaming (STR2-5): run to completion, read back

def _stream_of(spark, sf_dir, name):
    from chatlake.streaming.streams import table_stream
    return table_stream(spark, f"{sf_dir}/{name}.parquet", table(spark, sf_dir, name).schema)


@query
def stream_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR1 + SRC4-5: the rich exports ingested as a stream, a few files per micro-batch, consumed files removed; a text file beside them is left alone."""
    import uuid

    from chatlake.session import scratch_path
    from chatlake.sources import exports as ex
    from chatlake.streaming import streams as st
    out = scratch_path(spark, f"stream_exports/{uuid.uuid4().hex}")
    folder = _rich_exports(spark, sf_dir)
    table(spark, sf_dir, "conversations").select("text").write.mode("append").text(folder)
    st.ingest_exports(spark, folder, out, multi_line=False, max_files=4, clean_source="delete")
    return spark.read.parquet(out).select("chat_name", *ex.MESSAGE_COLUMNS)


@query
def stream_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4: senders (telegram id 20 x user id, so about half are customers); every third has no username, every fifth no first name."""
    import uuid

    from chatlake.session import scratch_path
    from chatlake.streaming import streams as st
    path = scratch_path(spark, f"stream_users/{uuid.uuid4().hex}")
    known = _users(spark, sf_dir).select("user_id", "telegram_id", "username", F.lit("").alias("first_name"), F.lit("").alias("last_name"))
    st.write_users(known, path)
    tid = F.col("user_id") * 20
    name = lambda text, every: F.when(F.col("user_id") % every != 0, F.concat(F.lit(text), tid.cast("string")))
    senders = _stream_of(spark, sf_dir, "events").select(tid.alias("user_id"), tid.alias("telegram_id"), name("user", 3).alias("username"),
                                                         name("First ", 5).alias("first_name"), F.lit(None).cast("string").alias("last_name"))
    st.upsert_users_stream(spark, senders, path)
    return spark.read.parquet(path).drop("bucket")


@query
def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from chatlake.session import scratch_path
    from chatlake.streaming import streams as st
    path = scratch_path(spark, f"stream_quota/{uuid.uuid4().hex}")
    ev = _stream_of(spark, sf_dir, "events").select("user_id", "ts")
    st.run_update_table(spark, st.hourly_counts(ev), path)
    return st.daily_quota(st.latest_rows(spark, path, ["user_id", "slice"]))


@query
def stream_quota_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from chatlake.session import scratch_path
    from chatlake.streaming import streams as st
    path = scratch_path(spark, f"stream_quota_exact/{uuid.uuid4().hex}")
    ev = _stream_of(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    st.trailing_quota_batches(spark, ev, path, path + "_state")
    return spark.read.parquet(path).select("event_id", "user_id", "ts", "prior_24h", "within_quota")


@query
def stream_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from chatlake.session import scratch_path
    from chatlake.streaming import streams as st
    path = scratch_path(spark, f"stream_modes/{uuid.uuid4().hex}")
    guarded = _guarded_messages(spark, sf_dir)  # the stream's source: messages with their guards, as the job before it leaves them
    guarded.write.parquet(f"{path}_messages")
    st.route_modes_stream(spark, st.file_stream(spark, f"{path}_messages", guarded.schema, glob="*.parquet"), path)
    return spark.read.parquet(path).select("event_id", "user_id", "ts", "command", "mode_before", "mode_after")


@query
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from chatlake.session import scratch_path
    from chatlake.streaming import streams as st
    path = scratch_path(spark, f"stream_index/{uuid.uuid4().hex}")
    d = _stream_of(spark, sf_dir, "documents")
    user = user_of("source")
    notes = d.select(user.alias("user_id"), F.col("doc_id").alias("telegram_message_id"), "text",
                     acc.namespace(user).alias("namespace"),
                     acc.shard(user).alias("index_name"))
    st.index_notes_stream(spark, notes, path, separator="\n")
    return spark.read.parquet(path).select(F.col("telegram_message_id").alias("doc_id"), "namespace", "index_name",
                                           "chunk_idx", "chunk", "n_chars")


# ---------------------------------------------------------------- sinks round trips (SRC6, SNK2, SNK4, PRJ7, PRJ9)

@query
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed chat texts written as ``text,date`` CSV to the shared folder and read back."""
    import uuid

    from chatlake.session import scratch_path
    from chatlake.sources.csv import read_csv
    from chatlake.sources.sinks import write_text_date_csv
    path = scratch_path(spark, f"csv_roundtrip/{uuid.uuid4().hex}")
    write_text_date_csv(msg.compose_index_text(_chat_messages(spark, sf_dir)), path)
    return read_csv(spark, path, "text string, date string")


@query
def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes -> chunks -> partitioned store, appended twice: the second run adds nothing."""
    import uuid

    from chatlake.session import scratch_path
    from chatlake.sources.sinks import append_chunks
    path = scratch_path(spark, f"chunk_store/{uuid.uuid4().hex}")
    d = documents(spark, sf_dir, "doc_id", "source", "text")
    user = user_of("source")
    notes = d.select(user.alias("user_id"), F.col("doc_id").alias("telegram_message_id"), "text",
                     acc.namespace(user).alias("namespace"), acc.shard(user).alias("index_name"))
    c = ch.chunk_documents(notes, id_cols=("user_id", "telegram_message_id"), separator="\n",
                           keep_cols=("namespace", "index_name"))
    c = c.withColumn("chunk_id", ch.chunk_id("namespace", "telegram_message_id", "chunk_idx", "chunk"))
    append_chunks(c, path)
    append_chunks(c, path)
    return spark.read.parquet(path).select(F.col("telegram_message_id").alias("doc_id"), "namespace", "index_name",
                                           "chunk_idx", "chunk", "n_chars")
