"""Chat formatting with typed content parts (DataFrame functions only).

A turn's content is a list of parts (``type, text, ref, width, height, seconds, pages``). A visitor per type turns a part
into its marker and body: text keeps its words behind ``<text>``; an image, audio or document becomes a placeholder, its
reference goes to the attachments with its place in the conversation, and the number of tokens it will expand to is
counted. A turn is ``<turn>role<body>parts</turn>``.

Control strings inside roles and texts are escaped like quoted "From " lines: a backslash goes between the first
character and the rest of a control string, and behind backslashes that already stand there; reading removes one. Control
strings hold their first character nowhere else, so none can arise where a text meets a marker.

Conversations are built in pieces of ``PIECE`` turn numbers, so that no step but the last digest holds a long
conversation at once: ``format_pieces`` gives the pieces with the loss mask (the spans, in code points, of the trained
roles' texts), ``read_pieces`` reads a piece's turns and masked texts back, ``assemble`` joins the pieces of a conversation.

Defined results: a null role or text is empty; a null list of parts has none; a part of an unknown type is a ``<part>``
placeholder of no tokens; missing sizes count as 0; rows are ordered by turn (null first), then role, then content, so
equal rows stay and their order doesn't matter; rows without a conversation id are one conversation; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 256
TRAINED = ("assistant",)
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
MARKERS = ("text", "image", "audio", "document", "part")
#: Whatever may not stand in a text as it is: the template's own strings and those of common chat templates.
_REST = rf"/?turn>|body>|(?:{'|'.join(MARKERS)})>|/?s>|/?INST\]"
_CONTROL = rf"([<\[])(\\*)({_REST})"
_ESCAPED = rf"([<\[])\\(\\*)({_REST})"
PATCH, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 14, 25, 512


def escape(col: Column) -> Column:
    return F.regexp_replace(col, _CONTROL, r"$1\\$2$3")


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, _ESCAPED, "$1$2$3")


def _size(part: Column, name: str) -> Column:
    return F.greatest(F.coalesce(part[name], F.lit(0)), F.lit(0))


def visit(part: Column) -> Column:
    """A part's marker and body, its expanded tokens, and the reference of an attachment (null for text)."""
    kind = F.lower(part["type"])
    marker = F.when(kind.isin("text", "image", "audio", "document"), kind).otherwise("part")
    tokens = {"image": F.ceil(_size(part, "width") / PATCH) * F.ceil(_size(part, "height") / PATCH),
              "audio": F.ceil(_size(part, "seconds") * TOKENS_PER_SECOND), "document": _size(part, "pages") * TOKENS_PER_PAGE}
    expanded = F.coalesce(*(F.when(kind == k, v.cast("long")) for k, v in tokens.items()), F.lit(0).cast("long"))
    words = F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.lit(""))
    attachment = F.when(marker != "text", F.struct(marker.alias("type"), part["ref"].alias("ref"), expanded.alias("tokens")))
    return F.struct(marker.alias("marker"), F.concat(F.lit("<"), marker, F.lit(">"), words).alias("body"),
                    F.char_length(words).alias("words"), expanded.alias("tokens"), attachment.alias("attachment"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null.alias("ref"), null.alias("width"), null.alias("height"),
                            null.alias("seconds"), null.alias("pages"))).cast(PARTS)


def _running(values: Column) -> Column:
    """Sums of all values before each place of a short list."""
    return F.transform(values, lambda _, i: F.aggregate(F.slice(values, 1, i), F.lit(0), lambda a, b: a + b))


def format_pieces(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  parts_col: str = "parts", trained=TRAINED) -> DataFrame:
    """One row per piece: conv, piece, n_turns, text, loss (array of start, end in the piece), attachments, chars, tokens."""
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = chats.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"),
                        F.transform(F.coalesce(F.col(parts_col).cast(PARTS), F.array().cast(PARTS)), visit).alias("parts"))
    head = F.concat(F.lit("<turn>"), escape(F.col("role")), F.lit("<body>"))
    rows = rows.withColumns({"head": head, "piece": F.floor(F.col("turn") / PIECE)})
    rows = rows.withColumn("line", F.concat("head", F.array_join(F.transform("parts", lambda p: p["body"]), ""), F.lit("</turn>")))
    before = _running(F.transform("parts", lambda p: F.char_length(p["body"])))
    ends = F.transform(F.arrays_zip(F.col("parts").alias("p"), before.alias("b")),
                       lambda x: F.char_length("head") + x["b"] + F.char_length(x["p"]["body"]))
    spans = F.transform(F.arrays_zip(F.col("parts").alias("p"), ends.alias("e")), lambda x: F.struct(
        x["p"]["marker"].alias("marker"), (x["e"] - x["p"]["words"]).cast("long").alias("start"), x["e"].cast("long").alias("end")))
    spans = F.transform(F.filter(spans, lambda x: (x["marker"] == "text") & F.col("role").isin(*trained)),
                        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    attachments = F.filter(F.transform("parts", lambda p: p["attachment"]), lambda a: a.isNotNull())
    tokens = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["tokens"])
    rows = rows.select("conv", "piece", "turn", "role", "line", spans.alias("spans"), attachments.alias("attachments"), tokens.alias("tokens"))
    order = Window.partitionBy("conv", "piece").orderBy("turn", "role", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.char_length("line").cast("long")
    rows = rows.withColumn("at", F.sum(length).over(order) - length)
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "line", "at", "spans", "attachments")))
    pieces = rows.groupBy("conv", "piece").agg(turns.alias("turns"), F.sum("tokens").alias("tokens"), F.sum(length).alias("chars"))
    moved = F.flatten(F.transform("turns", lambda t: F.transform(t["spans"], lambda s: F.struct(
        (s["start"] + t["at"]).alias("start"), (s["end"] + t["at"]).alias("end")))))
    return pieces.select("conv", "piece", F.size("turns").cast("long").alias("n_turns"),
                         F.array_join(F.transform("turns", lambda t: t["line"]), "").alias("text"), moved.alias("loss"),
                         F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"), "chars", "tokens")


def assemble(pieces: DataFrame) -> DataFrame:
    """One row per conversation: text, loss spans, attachments with their place in order, chars, tokens."""
    order = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pieces.withColumn("at", F.sum("chars").over(order) - F.col("chars"))
    loss = F.transform("loss", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), (s["end"] + F.col("at")).alias("end")))
    parts = F.sort_array(F.collect_list(F.struct("piece", "text", loss.alias("loss"), "attachments")))
    chats = placed.groupBy("conv").agg(parts.alias("p"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"),
                                       F.sum("n_turns").alias("n_turns"))
    attachments = F.transform(F.flatten(F.transform("p", lambda x: x["attachments"])), lambda a, i: F.struct(
        i.alias("place"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    return chats.select("conv", "n_turns", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"),
                        F.flatten(F.transform("p", lambda x: x["loss"])).alias("loss"), attachments.alias("attachments"), "chars", "tokens")


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text), the text parts unescaped and joined."""
    def turn(t: Column) -> Column:
        fields = F.split(t, "<body>", 2)
        words = F.filter(F.split(fields[1], "<(?=(?:text|image|audio|document|part)>)", -1), lambda p: p.startswith("text>"))
        return F.struct(unescape(F.substring(fields[0], F.lit(len("<turn>") + 1), F.char_length(fields[0]))).alias("role"),
                        F.array_join(F.transform(words, lambda p: unescape(F.substring(p, F.lit(len("text>") + 1), F.char_length(p)))), "")
                        .alias("text"))
    lines = F.split(text, "</turn>", -1)
    return F.transform(F.slice(lines, 1, F.size(lines) - 1), turn)


def read_loss(text: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(loss, lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
