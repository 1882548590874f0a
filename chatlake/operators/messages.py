"""Message-table operators (PRJ6-7, FLT2, STRF6, STRF10-11, DTF1, SRT1, LIM1-2, SET4-5).

A message table has the parsed-export columns: chat_name, chat_idx, pos, msg_id, sender,
sender_id, date (ISO text), date_unixtime, msg_type, msg_content, forwarded_from, ...
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.text import newline_to_space

# The labels used when composing and rendering an indexed message.
FROM_CHAT = "\nFrom the chat: "
SENDER = "\n\nSender: "
FORWARDED = "\nForwarded from: "
DATE_LABEL = "\n\nDate: "
SPLIT_MARK = "From the chat: "

BASE_EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC: start of the synthetic chat clock


def iso_from_epoch(seconds) -> "F.Column":
    """ISO local date-time text of epoch seconds, independent of the session time zone."""
    ntz = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return F.date_format(ntz, "yyyy-MM-dd'T'HH:mm:ss")


def conversation_messages(conv: DataFrame) -> DataFrame:
    """Chat rows from a conversations table (conv_id, turn, role, text).

    conv_id is the chat (arrival index), turn the arrival position and message id, role the
    sender; system turns have no sender. The message clock is conv_id hours + turn minutes.
    """
    unix = F.lit(BASE_EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60
    return conv.select(
        F.concat(F.lit("chat "), F.col("conv_id").cast("string")).alias("chat_name"),
        F.col("conv_id").alias("chat_idx"),
        F.col("turn").alias("pos"),
        F.col("turn").alias("msg_id"),
        F.when(F.col("role") != "system", F.col("role")).alias("sender"),
        iso_from_epoch(unix).alias("date"),
        unix.alias("date_unixtime"),
        F.lit("text").alias("msg_type"),
        newline_to_space("text").alias("msg_content"),
        F.lit("").alias("forwarded_from"),
    )


def sort_messages(msgs: DataFrame) -> DataFrame:
    """SRT1: chronological order; arrival order breaks ties (a range-partitioned global sort)."""
    return msgs.orderBy(F.col("date_unixtime").cast("bigint").asc_nulls_first(), "chat_idx", "pos")


def last_n_by_arrival(msgs: DataFrame, n: int = 50000, per: list | None = None, chat: str = "chat_idx", pos: str = "pos", piece: int = 4096) -> DataFrame:
    """LIM1-2: keep the last ``n`` messages by arrival (chat, position), of all messages or of each group ``per`` (e.g. an import file).

    Messages are counted by piece of ``piece`` positions (a partial aggregate); running sums of these counts from the end name the piece
    in which the limit falls. Later pieces stay whole by a filter, only that one piece of a group is numbered, so no task sorts more than
    a piece. Positions need not be unique; of messages at one place the limit takes any.
    """
    per = list(per or [])
    place = F.floor(F.col(pos) / piece)
    keys = [f"__key{i}" for i in range(len(per))]
    counts = msgs.groupBy(*(F.col(c).alias(k) for c, k in zip(per, keys)), F.col(chat).alias("__chat"), place.alias("__piece")).agg(F.count(F.lit(1)).alias("__size"))
    order = [F.desc_nulls_last("__chat"), F.desc_nulls_last("__piece")]
    upto = F.sum("__size").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # what is left of the limit for each piece that has a part in it; whole pieces have at least their size left
    sums = counts.withColumn("__left", F.lit(n) - upto + F.col("__size")).where("__left > 0")
    on = F.col(chat).eqNullSafe(F.col("__chat")) & place.eqNullSafe(F.col("__piece"))
    for c, k in zip(per, keys):
        on &= F.col(c).eqNullSafe(F.col(k))
    kept = msgs.join(sums, on)
    whole = kept.where("__left >= __size").select(*msgs.columns)
    row = F.row_number().over(Window.partitionBy(*per, chat, "__piece").orderBy(F.desc_nulls_last(pos)))
    cut = kept.where("__left < __size").withColumn("__row", row).where("__row <= __left").select(*msgs.columns)
    return whole.unionAll(cut)


def compose_index_text(msgs: DataFrame, null_as: str | None = None) -> DataFrame:
    """PRJ6-7 + FLT2: content + chat + sender + forward origin; null when any part is null.

    ``null_as`` replaces null parts instead (the default keeps the dropping behaviour).
    """
    def part(c):
        return F.coalesce(F.col(c), F.lit(null_as)) if null_as is not None else F.col(c)

    text = F.concat(part("msg_content"), F.lit(FROM_CHAT), part("chat_name"), F.lit(SENDER),
                    part("sender"), F.lit(FORWARDED), part("forwarded_from"))
    return msgs.select("chat_idx", "pos", text.alias("text"), "date").where(F.col("text").isNotNull())


def render_hits(hits: DataFrame, key_cols=("query_id",)) -> DataFrame:
    """STRF10-11 + DTF1 + SET4: text + date line, distinct per key, split into body and origin.

    A text without the chat marker renders with a null origin instead of failing.
    """
    s = F.concat(F.col("text"), F.lit(DATE_LABEL), F.split_part(F.col("date"), F.lit("T"), F.lit(1)))
    parts = F.split(F.col("_s"), SPLIT_MARK)
    body, origin = F.get(parts, 0), F.get(parts, 1)
    return (hits.where(F.col("date").isNotNull())
            .select(*key_cols, s.alias("_s")).dropDuplicates([*key_cols, "_s"])
            .select(*key_cols, body.alias("body"), origin.alias("origin"),
                    F.concat(F.lit("```\n"), body, F.lit("```"),
                             F.coalesce(F.concat(F.lit(SPLIT_MARK), origin), F.lit(""))).alias("rendered")))


def distinct_chats(msgs: DataFrame) -> DataFrame:
    """SET5: the distinct chats of an import."""
    return msgs.select("chat_idx", "chat_name").distinct()
