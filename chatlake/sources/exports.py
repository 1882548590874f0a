"""Chat-export JSON reader (SRC1-5, SRC2 explode, PRJ1-5, FLT1, JSN1-3, ARR1, STRF6, STRF8, LIM1, SRT1).

Exports are polymorphic JSON (text is a string *or* a list of strings and typed parts), so every
message is a VARIANT of its own: key presence, JSON null and list-vs-string stay distinguishable,
which a string-typed read loses. The frame around the messages is read by a schema, so no VARIANT
(at most 128 MiB) ever holds a whole export.

Scale: a multi-line JSON file is read by one task. ``write_message_lines`` is the first job
for large exports: it writes one message per line (with chat name and arrival position), so
everything after it reads in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Part types that set the entity flags, media types whose content is the file
# in the older command-line dialect, the default chat name and the message row type.
MENTION_TYPES = ("mention", "mention_name")
CLI_FILE_TYPES = ("animation", "video_file", "video_message", "voice_message", "audio_file")
UNKNOWN_CHAT = "Unknown Chat"
MESSAGE_TYPE = "message"
_CHAT = "name: variant, id: variant, messages: array<variant>"
EXPORT_SCHEMA = (f"{_CHAT.replace(':', '')}, first_pos int, chats struct<list: array<struct<{_CHAT}>>>, "
                 f"left_chats struct<list: array<struct<{_CHAT}>>>, broken string")

MESSAGE_COLUMNS = ["msg_id", "sender", "sender_id", "reply_to_msg_id", "date", "date_unixtime", "msg_type",
                   "msg_content", "forwarded_from", "action", "has_mention", "has_email", "has_phone",
                   "has_hashtag", "is_bot_command"]


def _get(v: Column, path: str, typ: str) -> Column:
    return F.try_variant_get(v, path, typ)


def _has(v: Column, path: str) -> Column:
    """JSN2: key present (a JSON null counts as present)."""
    return F.variant_get(v, path, "variant").isNotNull()


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column, path: str) -> Column:
    """A string field: an absent key is the empty text, a JSON null stays null."""
    return F.when(_has(v, path), _get(v, path, "string")).otherwise(F.lit(""))


def _reader(reader, multi_line: bool = True):
    return (reader.format("json").schema(EXPORT_SCHEMA).option("multiLine", multi_line)
            .option("columnNameOfCorruptRecord", "broken").option("pathGlobFilter", "*.json"))


def _frame(df: DataFrame, multi_line: bool) -> DataFrame:
    """(file, line, export columns). ``line`` tells the exports of a JSON-lines file apart: the export's
    own id, else a hash of its name and messages (lines that say the same are one export); null for whole files."""
    key = F.xxhash64(F.to_json("name"), F.to_json("messages"), F.to_json("chats"), F.to_json("left_chats"))
    own = F.when(F.col("id").isNotNull(), F.try_variant_get("id", "$", "bigint"))
    line = F.lit(None).cast("long") if multi_line else F.coalesce(own, key)
    return df.select(F.col("_metadata.file_path").alias("file"), line.alias("line"), "name", "messages", "chats",
                     "left_chats", "first_pos", "broken")


def read_exports(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """SRC1 + SRC4: every ``*.json`` under ``path``, one row per export, its messages one VARIANT each.

    ``multi_line=False`` reads JSON-lines files where each line is one export (one task per split).
    """
    return _frame(_reader(spark.read, multi_line).load(path), multi_line)


def stream_exports(spark: SparkSession, folder: str, options: dict, multi_line: bool = True) -> DataFrame:
    """The same as a stream of files."""
    r = _reader(spark.readStream, multi_line)
    for k, v in options.items():
        r = r.option(k, v)
    return _frame(r.load(folder), multi_line)


def layout() -> Column:
    """Which of the three layouts an export has; 'unknown' otherwise."""
    return (F.when(F.col("chats.list").isNotNull(), "chats")
            .when(F.col("left_chats.list").isNotNull(), "left_chats")
            .when(F.col("name").isNotNull() & F.col("messages").isNotNull(), "single")
            .otherwise("unknown"))


def with_layout(raw: DataFrame) -> DataFrame:
    """``raw`` with its layout, or 'invalid' where the JSON is broken (nothing of it is used)."""
    return raw.withColumn("layout", F.when(F.col("broken").isNotNull(), "invalid").otherwise(layout()))


def rejects_of(tagged: DataFrame) -> DataFrame:
    """SRC3: (file, reason) of what has no layout."""
    return (tagged.where(F.col("layout").isin("invalid", "unknown"))
            .select("file", F.when(F.col("layout") == "invalid", "invalid JSON")
                    .otherwise("unrecognised layout").alias("reason")))


def split_rejects(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC3: (recognised files, rejects with a reason) instead of raising."""
    tagged = with_layout(raw)
    return tagged.where(~F.col("layout").isin("invalid", "unknown")), rejects_of(tagged)


def explode_chats(files: DataFrame, include_left: bool = False) -> DataFrame:
    """SRC2: one row per chat (file, chat_idx, chat_name, messages). ``chats`` wins over ``left_chats``
    (Q16); ``include_left`` also takes the left chats of a file that has both. A chat's number counts
    inside its file; in JSON lines it is the line's key (a hash of key and number for a line's further chats),
    so (file, chat_idx, pos) stays unique; lines that hold pieces of one chat give ``first_pos`` (see ``chat_exports``)."""
    chats, left = F.col("chats.list"), F.col("left_chats.list")
    single = F.array(F.struct("name", F.lit(None).cast("variant").alias("id"), "messages"))
    arr = (F.when(F.col("layout") == "chats", F.concat(chats, F.coalesce(left, F.array())) if include_left else chats)
           .when(F.col("layout") == "left_chats", left)
           .otherwise(single))
    rows = files.select("file", "line", "first_pos", F.posexplode(arr).alias("at", "chat"))
    # the default applies to a missing key only; a JSON null name stays null
    name = F.when(F.col("chat.name").isNotNull(), F.try_variant_get("chat.name", "$", "string")).otherwise(F.lit(UNKNOWN_CHAT))
    number = (F.when(F.col("line").isNull(), F.col("at").cast("long")).when(F.col("at") == 0, F.col("line"))
              .otherwise(F.xxhash64("line", "at")))
    return rows.select("file", number.alias("chat_idx"), name.alias("chat_name"),
                       F.coalesce("first_pos", F.lit(0)).alias("first_pos"), F.col("chat.messages").alias("messages"))


def explode_messages(chats: DataFrame) -> DataFrame:
    """SRC2: one row per message, arrival order kept as (chat_idx, pos)."""
    rows = chats.select("file", "chat_idx", "chat_name", "first_pos", F.posexplode("messages").alias("pos", "m"))
    return rows.withColumn("pos", F.col("first_pos") + F.col("pos")).drop("first_pos")


def _flatten_parts(parts: Column) -> Column:
    """ARR1 / PRJ4: strings as is, typed parts by their text, anything else contributes nothing."""
    def piece(p):
        k = _kind(p)
        return (F.when(k == "STRING", _get(p, "$", "string"))
                .when(k.startswith("OBJECT"), F.coalesce(_get(p, "$.text", "string"), F.lit("")))
                .otherwise(F.lit("")))
    return F.array_join(F.transform(parts, piece), "")


def _any_part(parts: Column, types) -> Column:
    return F.coalesce(F.exists(parts, lambda p: _get(p, "$.type", "string").isin(*types)), F.lit(False))


def project_messages(msgs: DataFrame, dialect: str = "polars") -> DataFrame:
    """PRJ1-5 + FLT1: the 15 message columns (plus file, chat_idx, pos, chat_name).

    Content precedence: text; media -> file (or '?'); plain file; then photo, poll voters or
    'lat,lon' override it. A text list is flattened and sets the flags; a link part makes the
    type 'link'. ``dialect='cli'`` applies the older rules: a sticker takes its file only with
    an emoji, other media keep the text unless they are file types, and missing keys reject.
    """
    m = F.col("m")
    text_v = F.variant_get(m, "$.text", "variant")
    media = _get(m, "$.media_type", "string")
    file_ = _get(m, "$.file", "string")
    if dialect == "cli":
        media_content = (F.when(media == "sticker", F.when(_has(m, "$.sticker_emoji"), file_).otherwise(F.lit("?")))
                         .when(media.isin(*CLI_FILE_TYPES), file_))
    else:
        media_content = F.coalesce(file_, F.lit("?"))
    lat = F.coalesce(_get(m, "$.location_information.latitude", "string"), F.lit(""))
    lon = F.coalesce(_get(m, "$.location_information.longitude", "string"), F.lit(""))
    # which branch holds is a matter of key presence; a JSON null inside it is an empty content
    override_type = (F.when(_has(m, "$.photo"), "photo").when(_has(m, "$.poll"), "poll")
                     .when(_has(m, "$.location_information"), "location"))
    override = (F.when(_has(m, "$.photo"), _get(m, "$.photo", "string"))
                .when(_has(m, "$.poll"), F.coalesce(_get(m, "$.poll.total_voters", "string"), F.lit("0")))
                .when(_has(m, "$.location_information"), F.concat(lat, F.lit(","), lon)))
    media_type = F.when(_has(m, "$.media_type"), media).when(_has(m, "$.file"), F.lit("file"))
    from_media = F.when(_has(m, "$.media_type"), media_content).when(_has(m, "$.file"), file_)

    parts = F.when(_kind(text_v).startswith("ARRAY"), _get(m, "$.text", "array<variant>"))
    # the text list is only read when nothing replaced the content
    has_media = _has(m, "$.media_type") | _has(m, "$.file")
    uses_text = override_type.isNull() & (from_media.isNull() if dialect == "cli" else ~has_media)
    text_content = F.when(parts.isNotNull(), _flatten_parts(parts)).otherwise(_get(m, "$.text", "string"))
    content = F.coalesce(F.when(override_type.isNotNull(), override).when(uses_text, text_content).otherwise(from_media), F.lit(""))
    list_parts = F.when(uses_text, parts)
    msg_type = (F.when(list_parts.isNotNull() & _any_part(list_parts, ["link"]), F.lit("link"))
                .otherwise(F.coalesce(override_type, media_type, F.lit("text"))))

    def flag(types):
        return F.when(list_parts.isNotNull(), _any_part(list_parts, types)).otherwise(F.lit(False)).cast("int")

    out = msgs.where(_get(m, "$.type", "string") == MESSAGE_TYPE).select(
        "file", "chat_idx", "chat_name", "pos",
        _get(m, "$.id", "bigint").alias("msg_id"),
        _text(m, "$.from").alias("sender"),
        _text(m, "$.from_id").alias("sender_id"),
        _get(m, "$.reply_to_message_id", "bigint").alias("reply_to_msg_id"),
        _text(m, "$.date").alias("date"),
        _get(m, "$.date_unixtime", "bigint").alias("date_unixtime"),
        msg_type.alias("msg_type"),
        F.translate(content, "\n", " ").alias("msg_content"),
        _text(m, "$.forwarded_from").alias("forwarded_from"),
        _text(m, "$.action").alias("action"),
        flag(MENTION_TYPES).alias("has_mention"),
        flag(["email"]).alias("has_email"),
        flag(["phone"]).alias("has_phone"),
        flag(["hashtag"]).alias("has_hashtag"),
        flag(["bot_command"]).alias("is_bot_command"),
        *([] if dialect != "cli" else [
            (~(_has(m, "$.id") & _has(m, "$.from") & _has(m, "$.from_id") & _has(m, "$.date")
               & _has(m, "$.date_unixtime"))
             | (_has(m, "$.media_type") & ~_has(m, "$.file")
                & (media.isin(*CLI_FILE_TYPES) | ((media == "sticker") & _has(m, "$.sticker_emoji"))))
             | (_has(m, "$.poll") & ~_has(m, "$.poll.total_voters"))
             | (_has(m, "$.location_information") & ~(_has(m, "$.location_information.latitude")
                                                       & _has(m, "$.location_information.longitude"))))
            .alias("_missing_key")]),
    )
    if dialect == "cli":
        out = out.where(~F.col("_missing_key")).drop("_missing_key")
    return out


def keep_last(msgs: DataFrame, n: int, per=("file",)) -> DataFrame:
    """LIM1: the last ``n`` messages of each export by arrival."""
    from chatlake.operators.messages import last_n_by_arrival
    return last_n_by_arrival(msgs, n, [c for c in per if c in msgs.columns])


def sort_chronologically(msgs: DataFrame) -> DataFrame:
    """SRT1: by epoch seconds (numeric, Q17), then arrival order."""
    return msgs.orderBy(F.col("date_unixtime").asc_nulls_first(), "file", "chat_idx", "pos")


def parse_exports(spark: SparkSession, path: str, dialect: str = "polars", max_messages: int | None = None,
                  include_left: bool = False, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """The whole import: (messages, rejects). Files without any message are rejected too.

    Every message is kept; ``max_messages`` keeps only the last ones of each export (LIM1). In JSON lines that is each (file, id):
    pieces of one chat that lie in several files count as several exports there.
    """
    good, bad = split_rejects(read_exports(spark, path, multi_line))
    msgs = project_messages(explode_messages(explode_chats(good, include_left)), dialect)
    if dialect != "cli" and max_messages:
        msgs = keep_last(msgs, max_messages, per=["file"] if multi_line else ["file", "chat_idx"])
    empty = good.select("file").join(msgs.select("file").distinct(), "file", "left_anti") \
        .select("file", F.lit("no messages").alias("reason"))
    return sort_chronologically(msgs), bad.unionByName(empty)


def write_message_lines(spark: SparkSession, path: str, out: str, include_left: bool = False) -> None:
    """Pre-split big exports: one JSON line per message with its chat and arrival position."""
    good, _ = split_rejects(read_exports(spark, path))
    m = explode_messages(explode_chats(good, include_left))
    (m.select("file", "chat_idx", "chat_name", "pos", F.to_json("m").alias("message"))
     .write.mode("overwrite").json(out))


def read_message_lines(spark: SparkSession, path: str) -> DataFrame:
    """Read what ``write_message_lines`` wrote, ready for ``project_messages`` (parallel read)."""
    return (spark.read.schema("file string, chat_idx long, chat_name string, pos int, message string").json(path)
            .withColumn("m", F.parse_json("message")).drop("message"))


def chat_pieces(msgs: DataFrame, chat_col: str, order_col: str, json_col: str, name: Column, piece_size: int = 1024) -> DataFrame:
    """(chat, ``name``, ``first_pos``, ``messages`` array<variant>): each chat's messages, given as JSON texts, in order, in rows of
    ``piece_size`` positions. Only a piece's count and name meet the other pieces of its chat, so no value grows with a hot chat."""
    rows = msgs.select(F.col(chat_col).alias("_chat"), F.floor(F.col(order_col) / piece_size).alias("_piece"),
                       F.col(order_col).alias("_order"), F.col(json_col).alias("_j"), name.alias("_name"))
    pieces = rows.groupBy("_chat", "_piece").agg(F.array_sort(F.collect_list(F.struct("_order", "_j"))).alias("_all")).alias("p")
    w = Window.partitionBy("_chat")
    before = F.sum("_n").over(w.orderBy(F.col("_piece").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy("_chat", "_piece").agg(F.count(F.lit(1)).alias("_n"), F.min("_name").alias("_name"))
    counts = counts.select("_chat", "_piece", F.min("_name").over(w).alias("name"), F.coalesce(before, F.lit(0)).cast("int").alias("first_pos")).alias("c")
    both = pieces.join(counts, F.expr("p._chat <=> c._chat and p._piece <=> c._piece"))
    return both.select(F.col("p._chat").alias(chat_col), "name", "first_pos", F.transform("_all", lambda x: F.parse_json(x["_j"])).alias("messages"))


def chat_exports(msgs: DataFrame, chat_col: str, order_col: str, message_col: str, name: Column,
                 piece_size: int = 1024) -> DataFrame:
    """Build single-chat exports ``(name, id, first_pos, messages)`` from message structs (JSON writer ready).

    A chat is one or more export lines of the same id and name, one for each ``piece_size`` positions, so a hot chat is not
    sorted, serialised or held by one task. ``first_pos`` is the position of a line's first message; every message is a VARIANT
    of its own.
    """
    lines = msgs.withColumn("_json", F.to_json(F.col(message_col), {"ignoreNullFields": "false"}))
    return chat_pieces(lines, chat_col, order_col, "_json", name, piece_size).where(F.col(chat_col).isNotNull()).select(
        "name", F.col(chat_col).alias("id"), "first_pos", "messages")
