"""The guarded mode machine, its prefix scan and the guards, each against a plain walk."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlake.operators import accounts as acc
from chatlake.operators import modes, scan

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)
SCHEMA = ("event_id long, user_id long, ts timestamp, command string, subscribed boolean, within_limits boolean, has_notes boolean, "
          "has_hits boolean, valid_choice boolean, paid boolean")


def plain_step(mode, cmd, sub, within, notes, hits, choice, paid):
    if cmd in ("/start", "/note"):
        return "notes"
    if cmd == "/chat":
        return "chat"
    if cmd == "/subscribe":
        return "subscription_choice"
    if cmd == "/import":
        return "wait_for_json" if sub else mode
    if cmd == "/search":
        return "search" if within and notes else mode
    if cmd == "reset":
        return None
    if cmd in ("/help", "/link", "/update"):
        return mode
    if mode == "subscription_choice":
        return "wait_for_payment" if choice and cmd != "payment" else mode
    if cmd == "payment":
        return "notes" if paid else mode
    if mode == "chat" and sub and not within:
        return None
    if mode == "search" and sub and (not within or hits):
        return None
    return mode


def plain_route(rows, initial=None):
    out, state = {}, dict(initial or {})
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or T0, r[0])):
        before = state.get(r[1])
        state[r[1]] = plain_step(before, r[3], *(bool(x) for x in r[4:]))
        out[r[0]] = (before, state[r[1]])
    return out


def messages(n, seed=1, hot=0.5):
    rnd = random.Random(seed)
    cmds = ["/start", "/note", "/chat", "/subscribe", "/import", "/search", "/help", "payment", "reset", None, None, None, None, "hello", ""]
    flag = lambda: rnd.choice([True, False, None])
    return [(i, rnd.choice([7, None]) if rnd.random() < hot else rnd.randrange(20), rnd.choice([None, *[T0 + dt.timedelta(minutes=rnd.randrange(3000))] * 9]),
             rnd.choice(cmds), *(flag() for _ in range(6))) for i in range(n)]


def test_routing_equals_a_plain_walk(spark):
    rows = messages(1500)
    got = modes.route(spark.createDataFrame(rows, SCHEMA))
    assert {r.event_id: (r.mode_before, r.mode_after) for r in got.collect()} == plain_route(rows) and got.count() == 1500
    assert got.columns[:10] == [c.split()[0] for c in SCHEMA.split(", ")]


def test_initial_modes_of_users_with_and_without_an_id(spark):
    rows = messages(200, seed=2)
    known = {7: "chat", None: "search", 3: "subscription_choice", 99: "notes"}
    initial = spark.createDataFrame(list(known.items()), "user_id long, mode string")
    got = modes.route(spark.createDataFrame(rows, SCHEMA), initial=initial).collect()
    assert {r.event_id: (r.mode_before, r.mode_after) for r in got} == plain_route(rows, known)


def test_a_hot_user_spans_partitions(spark):
    """One user with nearly all messages, dealt over many range partitions: the same modes, and more than one task has the user."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = messages(4000, seed=3, hot=0.9)
        df = spark.createDataFrame(rows, SCHEMA)
        placed = df.repartitionByRange("user_id", "ts", "event_id").withColumn("p", F.spark_partition_id())
        assert placed.where("user_id = 7").select("p").distinct().count() > 2
        assert {r.event_id: (r.mode_before, r.mode_after) for r in modes.route(df).collect()} == plain_route(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_every_transition_without_guard_columns(spark):
    cmds = ["/start", None, "/subscribe", "x", "payment", "/note", "/chat", None, "reset", None, "/search", "q", "/import"]
    ev = spark.createDataFrame([(i, 1, T0 + dt.timedelta(hours=i), c) for i, c in enumerate(cmds)], "event_id long, user_id long, ts timestamp, command string")
    got = [r.mode_after for r in modes.route(ev).orderBy("event_id").collect()]
    assert got == ["notes", "notes", "subscription_choice", "subscription_choice", "subscription_choice", "notes", "chat", "chat", None, None, "search", "search",
                   "wait_for_json"]
    assert modes.route(ev.where("false")).count() == 0


def test_composition_by_doubling_equals_one_by_one():
    rng = np.random.default_rng(4)
    f, run = rng.integers(0, 7, (500, 7)), np.sort(rng.integers(0, 9, 500))
    got, state = scan.compose_runs(f, run), None
    for i in range(500):
        state = f[i] if i == 0 or run[i] != run[i - 1] else f[i][state]
        assert (got[i] == state).all()


def test_guards_hold_when_the_message_arrives(spark):
    day = lambda d: T0 + dt.timedelta(days=d)
    rows = [(1, 1, day(0), None), (2, 1, day(1), 1), (3, 1, day(1), None), (4, 1, day(32), None), (5, 1, day(33), 1), (6, 1, day(34), None), (7, 2, day(0), None),
            (8, 3, day(0), None), (9, None, day(0), None), (10, 4, None, None)]
    rows += [(100 + k, 2, day(5) + dt.timedelta(minutes=k), None) for k in range(4)]
    m = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, months int")
    users = spark.createDataFrame([(1, "a", 0.0), (2, "free", 1.0), (3, "c", 201.0)], "user_id long, username string, vector_storage_volume double")
    notes = spark.createDataFrame([(1,), (1,), (4,)], "user_id long")
    allow = spark.createDataFrame([("free",)], "username string")
    out = modes.with_guards(m, users, notes, allow, limit=2)
    got = {r.event_id: (r.subscribed, r.within_limits, r.has_notes) for r in out.collect()}
    assert set(out.columns) == {*m.columns, "subscribed", "within_limits", "has_notes"} and len(got) == len(rows)
    # two months paid from day 1: the second month extends the old end, day 61
    assert [got[k][0] for k in (1, 2, 3, 4, 5, 6)] == [False, False, True, False, False, True]
    assert got[7] == (True, True, False) and got[8] == (False, False, False) and got[9] == (False, True, False) and got[10] == (False, True, True)
    assert [got[100 + k][1] for k in range(4)] == [True, True, True, False]


@pytest.mark.parametrize("slices", [24, 1, 7200])
def test_trailing_count_by_slices_equals_pairwise_counting(spark, slices):
    from chatlake.operators.windows import trailing_count
    rnd = random.Random(slices)
    step = [0, 1, 3_600_000_000, 86_400_000_000 - 1, 86_400_000_000, 12_345_678]
    rows, t = [], 1_700_000_000_000_000
    for i in range(300):
        t += rnd.choice(step[:2] * 3 + step)
        rows.append((i, rnd.choice([1, 1, 2, None]), None if rnd.random() < 0.05 else t))
    df = spark.createDataFrame(rows, "id long, k long, us long").withColumn("ts", F.timestamp_micros("us")).withColumn("at", F.lit("mine"))
    got = {r.id: r.n for r in trailing_count(df, ["k"], "ts", 86_400_000_000, "n", slices).collect()}
    assert got == {i: sum(k2 == k and (u is None and u2 is None or None not in (u, u2) and u - 86_400_000_000 <= u2 <= u) for _, k2, u2 in rows) for i, k, u in rows}
