"""Golden tests of the export reader on small hand-written exports (written to a temp folder)."""

import json

import pytest

from chatlake.sources import exports as ex


def _msg(i, **kw):
    m = {"id": i, "type": "message", "date": f"2024-01-01T10:{i:02d}:00", "date_unixtime": str(1704103200 + 60 * i),
         "from": "Ann", "from_id": "user1", "text": f"m{i}"}
    m.update(kw)
    return {k: v for k, v in m.items() if v is not _DROP}


_DROP = object()


def _write(folder, name, obj, bom=False):
    data = json.dumps(obj, ensure_ascii=False)
    with open(folder / name, "w", encoding="utf-8") as f:
        f.write(("﻿" if bom else "") + data)


@pytest.fixture()
def exports(tmp_path):
    branches = [
        _msg(1, text="plain\ntext"),
        _msg(2, text=["go ", {"type": "link", "text": "http://a"}, " ", {"type": "mention", "text": "@b"},
                      {"type": "email", "text": "e@x"}, {"type": "phone", "text": "+1"},
                      {"type": "hashtag", "text": "#t"}, {"type": "bot_command", "text": "/start"}]),
        _msg(3, media_type="sticker", sticker_emoji="😀", file="s.webp", text=""),
        _msg(4, media_type="sticker", text=""),
        _msg(5, media_type="voice_message", file="v.ogg", text=""),
        _msg(6, media_type="video_file", text="keep"),
        _msg(7, file="doc.pdf", text=""),
        _msg(8, photo="p.jpg", text=["caption ", {"type": "link", "text": "http://c"}]),
        _msg(9, poll={"question": "q", "total_voters": 7}, text=""),
        _msg(10, poll={"question": "q"}, text=""),
        _msg(11, location_information={"latitude": 55.5, "longitude": 37.25}, text=""),
        _msg(12, location_information={}, text=""),
        {"id": 13, "type": "service", "date": "2024-01-01T10:13:00", "date_unixtime": "1704103980", "action": "x"},
        _msg(14, **{"from": None}, text=None),
        _msg(15, **{"from": _DROP, "text": _DROP}),
        _msg(16, text='["a"]'),
        _msg(17, text=["a", {"type": "plain", "text": "b"}, 5, {"type": "link"}]),
    ]
    _write(tmp_path, "single.json", {"name": "Branches", "type": "personal_chat", "messages": branches})
    _write(tmp_path, "both.json", {"chats": {"list": [{"name": "C1", "messages": [_msg(1)]},
                                                      {"messages": [_msg(2)]},
                                                      {"name": None, "messages": [_msg(5)]}]},
                                   "left_chats": {"list": [{"name": "L1", "messages": [_msg(3)]}]}})
    _write(tmp_path, "left.json", {"left_chats": {"list": [{"name": "L2", "messages": [_msg(4)]}]}}, bom=True)
    _write(tmp_path, "unknown.json", {"foo": 1})
    _write(tmp_path, "empty.json", {"name": "E", "messages": [{"id": 1, "type": "service"}]})
    (tmp_path / "notes.txt").write_text("not an export")
    return tmp_path


def _rows(df):
    return {(r.file.rsplit("/", 1)[-1], r.chat_name, r.msg_id): r for r in df.collect()}


def test_branches_polars_dialect(spark, exports):
    msgs, rejects = ex.parse_exports(spark, str(exports))
    rows = {k[2]: v for k, v in _rows(msgs).items() if k[0] == "single.json"}
    t = {i: (r.msg_type, r.msg_content) for i, r in rows.items()}
    assert t[1] == ("text", "plain text")
    assert t[2] == ("link", "go http://a @be@x+1#t/start")
    r2 = rows[2]
    assert (r2.has_mention, r2.has_email, r2.has_phone, r2.has_hashtag, r2.is_bot_command) == (1, 1, 1, 1, 1)
    assert t[3] == ("sticker", "s.webp") and t[4] == ("sticker", "?")
    assert t[5] == ("voice_message", "v.ogg") and t[6] == ("video_file", "?")
    assert t[7] == ("file", "doc.pdf")
    assert t[8] == ("photo", "p.jpg") and rows[8].has_mention == 0  # caption and flags are lost (Q18)
    assert t[9] == ("poll", "7") and t[10] == ("poll", "0")
    assert t[11] == ("location", "55.5,37.25") and t[12] == ("location", ",")
    assert 13 not in rows  # service rows are skipped
    assert rows[14].sender is None and t[14] == ("text", "")  # JSON null text -> '' (Q15)
    assert rows[15].sender == '' and t[15] == ("text", "")
    assert t[16] == ("text", '["a"]')  # a string that looks like a list stays a string
    assert t[17] == ("link", "ab")
    assert rows[1].date_unixtime == 1704103260 and rows[1].date == "2024-01-01T10:01:00"


def test_layouts_and_rejects(spark, exports):
    msgs, rejects = ex.parse_exports(spark, str(exports))
    keys = set(_rows(msgs))
    assert ("both.json", "C1", 1) in keys and ("both.json", "Unknown Chat", 2) in keys
    assert ("both.json", None, 5) in keys  # a JSON null name is not replaced
    assert not any(k[0] == "both.json" and k[1] == "L1" for k in keys)  # chats win (Q16)
    assert ("left.json", "L2", 4) in keys  # BOM accepted
    rej = {r.file.rsplit("/", 1)[-1]: r.reason for r in rejects.collect()}
    assert rej == {"unknown.json": "unrecognised layout", "empty.json": "no messages"}
    m2, _ = ex.parse_exports(spark, str(exports), include_left=True)
    assert ("both.json", "L1", 3) in set(_rows(m2))


def test_cli_dialect(spark, exports):
    msgs, _ = ex.parse_exports(spark, str(exports), dialect="cli")
    t = {k[2]: (r.msg_type, r.msg_content) for k, r in _rows(msgs).items() if k[0] == "single.json"}
    assert t[3] == ("sticker", "s.webp") and t[4] == ("sticker", "?")
    assert t[5] == ("voice_message", "v.ogg")
    assert 6 not in t  # a file-type media row without its file is a missing key
    assert 10 not in t and 12 not in t and 15 not in t  # missing keys are rejected, not parsed


def test_keep_last_n_by_arrival_then_sort(spark, tmp_path):
    # arrival order differs from time order
    times = [50, 10, 40, 20, 60, 30]
    ms = [_msg(i + 1, date_unixtime=str(1704103200 + t)) for i, t in enumerate(times)]
    _write(tmp_path, "six.json", {"name": "Six", "messages": ms})
    msgs, _ = ex.parse_exports(spark, str(tmp_path), max_messages=4)
    got = [r.msg_id for r in msgs.collect()]
    assert got == [4, 6, 3, 5]  # last four arrivals (3,4,5,6) sorted by time


def test_message_lines_roundtrip(spark, exports, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("lines") / "msgs")
    ex.write_message_lines(spark, str(exports), out)
    lines = ex.read_message_lines(spark, out)
    a = ex.project_messages(lines).drop("file").collect()
    b = ex.project_messages(ex.explode_messages(ex.explode_chats(ex.split_rejects(
        ex.read_exports(spark, str(exports)))[0]))).drop("file").collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


def test_chat_export_built_in_pieces_round_trips(spark, tmp_path):
    # 2500 messages span three pieces of 1024: the export keeps them whole and in order
    from pyspark.sql import functions as F
    n = 2500
    m = spark.range(n).select(F.lit(7).alias("chat"), F.col("id").alias("turn"),
                              F.struct(F.col("id").alias("id"), F.lit("message").alias("type"),
                                       F.col("id").cast("string").alias("date_unixtime"),
                                       F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).alias("m"))
    out = str(tmp_path / "exp")
    ex.chat_exports(m, "chat", "turn", "m", F.lit("big chat"), piece_size=1024).write.json(out)
    msgs, _ = ex.parse_exports(spark, out + "/*.json", multi_line=False)
    rows = msgs.select("chat_name", "msg_id", "msg_content").orderBy("msg_id").collect()
    assert len(rows) == n and {r.chat_name for r in rows} == {"big chat"}
    assert [r.msg_id for r in rows] == list(range(n)) and rows[-1].msg_content == f"t{n - 1}"


def test_json_lines_keys_are_unique(spark, tmp_path):
    lines = [{"name": "A", "messages": [_msg(1), _msg(2)]}, {"name": "A", "messages": [_msg(3)]}, {"id": 1, "chats": {"list": [
        {"name": "A", "messages": [_msg(4)]}, {"messages": [_msg(5)]}]}}, {"id": 2, "name": "A", "messages": [_msg(6)]}]
    (tmp_path / "l.json").write_text("\n".join(json.dumps(x) for x in lines))
    msgs, _ = ex.parse_exports(spark, str(tmp_path), multi_line=False)
    assert msgs.count() == 6 == msgs.select("file", "chat_idx", "pos").distinct().count()


def test_null_photo_hides_the_media_file(spark, tmp_path):
    _write(tmp_path, "p.json", {"name": "P", "messages": [_msg(1, photo=None, media_type="sticker", file="s.webp")]})
    r = ex.parse_exports(spark, str(tmp_path))[0].first()
    assert (r.msg_type, r.msg_content, r.forwarded_from, r.action) == ("photo", "", "", "")


def test_an_export_above_the_variant_limit_keeps_all_messages(spark, tmp_path):
    text = "x" * 1_400_000
    with open(tmp_path / "big.json", "w") as f:  # about 140 MB
        f.write('{"name": "Big", "messages": [')
        f.write(",".join(json.dumps(_msg(k, text=text)) for k in range(100)))
        f.write("]}")
    msgs, rejects = ex.parse_exports(spark, str(tmp_path))
    assert msgs.select("msg_id").count() == 100 and rejects.count() == 0


def _long_chat(spark, n, text):
    from pyspark.sql import functions as F
    return spark.range(n).select(F.lit(7).alias("chat"), F.col("id").alias("turn"),
                                 F.struct(F.col("id").alias("id"), F.lit("message").alias("type"), F.col("id").cast("string").alias("date_unixtime"),
                                          text.alias("text")).alias("m"))


def test_a_written_chat_above_the_variant_limit_keeps_all_messages(spark, tmp_path):
    from pyspark.sql import functions as F
    out = str(tmp_path / "exp")
    chats = ex.chat_exports(_long_chat(spark, 100, F.lit("x" * 1_400_000)), "chat", "turn", "m", F.lit("big"), piece_size=16)  # about 140 MB
    chats.write.json(out)
    msgs, _ = ex.parse_exports(spark, out + "/*.json", multi_line=False)
    assert sorted(r.msg_id for r in msgs.select("msg_id").collect()) == list(range(100))


def test_pieces_of_a_written_chat_keep_one_number_and_positions(spark, tmp_path):
    from pyspark.sql import functions as F
    twice = _long_chat(spark, 300, F.lit("t")).unionAll(_long_chat(spark, 300, F.lit("u")))  # repeated positions
    out = str(tmp_path / "exp")
    chats = ex.chat_exports(twice, "chat", "turn", "m", F.lit("long"), piece_size=100)
    assert chats.count() == 3
    chats.write.json(out)
    msgs, _ = ex.parse_exports(spark, out + "/*.json", multi_line=False)
    rows = msgs.collect()
    assert {r.chat_idx for r in rows} == {7} and sorted(r.pos for r in rows) == list(range(600))
    assert [r.msg_id for r in sorted(rows, key=lambda r: r.pos)] == [k // 2 for k in range(600)]


def test_rich_exports_of_a_long_chat(spark, tmp_path):
    """Chats of 2500 turns in every layout are written in pieces; a chat without a layout is rejected once."""
    from chatlake.plans import queries as Q
    from pyspark.sql import functions as F
    conv = spark.range(4 * 2500).select(F.element_at(F.array(*map(F.lit, (0, 1, 2, 10))), (F.col("id") % 4 + 1).cast("int")).cast("long").alias("conv_id"),
                                        F.floor(F.col("id") / 4).alias("turn"), F.lit("user").alias("role"), F.lit("hello").alias("text"))
    conv.write.parquet(str(tmp_path / "conversations.parquet"))
    folder = Q._rich_exports(spark, str(tmp_path))
    raw = ex.read_exports(spark, folder + "/*.json", multi_line=False)
    assert raw.agg(F.max(F.size("messages"))).first()[0] == 1024
    assert raw.agg(F.max(F.size(F.col("chats.list")[0]["messages"]))).first()[0] == 1024
    msgs, bad = ex.parse_exports(spark, folder + "/*.json", multi_line=False)
    assert bad.count() == 1
    n = sum((7 * c + t) % 9 != 8 for c in (0, 1, 1, 2, 2) for t in range(2500))
    assert msgs.count() == n == msgs.select("chat_idx", "pos").distinct().count()
