import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from chatlake.operators import accounts as acc
from chatlake.operators.windows import carry_forward, running_sum, trailing_count

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)


def test_subscription_lapse_and_renew(spark):
    pays = spark.createDataFrame([
        (1, 10, dt.datetime(2024, 1, 1), 1),
        (2, 10, dt.datetime(2024, 6, 1), 3),  # after the first period lapsed: extends from the old end (Q6)
        (3, 11, dt.datetime(2024, 2, 1), 12),
    ], "payment_id long, user_id long, paid_at timestamp, months int")
    ends = {r.user_id: r.subscription_end_date for r in acc.subscription_end(pays).collect()}
    assert ends[10] == dt.datetime(2024, 1, 1) + dt.timedelta(days=120)
    assert ends[11] == dt.datetime(2024, 2, 1) + dt.timedelta(days=360)
    run = {r.payment_id: r.end_after for r in acc.running_subscription_end(pays).collect()}
    assert run == {1: dt.datetime(2024, 1, 31), 2: dt.datetime(2024, 4, 30), 3: dt.datetime(2024, 2, 1) + dt.timedelta(days=360)}
    users = spark.createDataFrame([(10, "a", None), (11, "b", None), (12, "", None), (13, "free", None)],
                                  "user_id long, username string, invited_by_id long")
    allow = spark.createDataFrame([("free",)], "username string")
    got = {r.user_id: (r.active, r.access) for r in
           acc.with_access(users, acc.subscription_end(pays), "2024-05-01 00:00:00", allow).collect()}
    assert got == {10: (False, False), 11: (True, True), 12: (False, False), 13: (False, True)}


def test_quota_edges(spark):
    # prior messages in [t - 24h, t]: one exactly 24 h old counts; the 31st message is still allowed
    rows = [(i, 1, T0 + dt.timedelta(minutes=i)) for i in range(32)]
    rows.append((100, 1, T0 + dt.timedelta(days=1)))  # exactly 24 h after message 0
    ev = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    got = {r.event_id: (r.prior_24h, r.within_quota) for r in acc.trailing_24h(ev).collect()}
    assert got[29] == (29, True) and got[30] == (30, True) and got[31] == (31, False)
    assert got[100] == (32, False)
    users = spark.createDataFrame([(1, 0.0), (2, 200.0), (3, 200.5), (4, None)], "user_id long, vector_storage_volume double")
    q = {r.user_id: (r.n_24h, r.within_limits) for r in acc.quota_as_of(users, ev, "2024-01-11 12:00:00").collect()}
    assert q == {1: (33, False), 2: (0, True), 3: (0, False), 4: (0, True)}


def test_prices_and_rejects(spark):
    pays = spark.createDataFrame([(1, 10, T0, 1), (2, 11, T0, 12), (3, 10, T0, 2)],
                                 "payment_id long, user_id long, paid_at timestamp, months int")
    users = spark.createDataFrame([(10, "a", None), (11, "b", 10)], "user_id long, username string, invited_by_id long")
    got = {r.payment_id: float(r.amount_minor) for r in acc.priced_choices(pays, users, acc.price_table(spark)).collect()}
    assert got == {1: 64000.0, 2: 480 * 12 * 0.8 * 100}
    assert [r.payment_id for r in acc.rejected_choices(pays, acc.price_table(spark)).collect()] == [3]


def test_referrals_and_insert_if_absent(spark):
    users = spark.createDataFrame([(1, 1, "a", None), (2, 2, "b", 1), (3, 3, "c", 1), (4, 4, "d", 2)],
                                  "user_id long, telegram_id long, username string, invited_by_id long")
    ends = spark.createDataFrame([(2, T0)], "user_id long, subscription_end_date timestamp")
    got = {r.user_id: (r.invited_total, r.invited_paid) for r in acc.referral_counts(users, ends).collect()}
    assert got == {1: (2, 1), 2: (1, 0), 3: (0, 0), 4: (0, 0)}
    inc = spark.createDataFrame([(2, 2, "there"), (9, 9, "there"), (9, 9, "there")],
                                "user_id long, telegram_id long, username string")
    out = {r.telegram_id: r.username for r in acc.insert_if_absent(users, inc).collect()}
    assert out == {1: "a", 2: "b", 3: "c", 4: "d", 9: "there"}


def test_skew_split_windows_equal_plain_windows(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):  # one hot key with most rows, spread over days
        k = 0 if rng.random() < 0.6 else rng.randint(1, 5)
        rows.append((i, k, T0 + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 6)), rng.randint(1, 5),
                     rng.choice([None, None, "x", "y", ""])))
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp, v long, m string")
    day = F.to_date("ts")
    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = df.select("id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rs"),
                      F.last("m", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("cf"),
                      F.count(F.lit(1)).over(Window.partitionBy("k").orderBy(F.unix_micros("ts"))
                                             .rangeBetween(-acc.DAY_MICROS, 0)).alias("tc"))
    a = running_sum(df, ["k"], ["ts", "id"], "v", day, "rs").select("id", "rs")
    b = carry_forward(df, ["k"], ["ts", "id"], "m", day, "cf", include_current=False).select("id", "cf")
    c = trailing_count(df, ["k"], "ts", acc.DAY_MICROS, "tc").select("id", "tc")
    split = a.join(b, "id").join(c, "id")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.select("id", "rs", "cf", "tc").collect()))


def test_payload_and_namespace(spark):
    df = spark.createDataFrame([("subscribe_3",), ("subscribe_x",)], "p string")
    g, m = acc.payload_split("p")
    assert [tuple(r) for r in df.select(g, m).collect()] == [("subscribe", 3), ("subscribe", None)]
    one = spark.createDataFrame([(42,)], "t long")
    r = one.select(acc.namespace("t").alias("ns"), acc.shard("t").alias("ix")).first()
    assert (r.ns, r.ix) == ("user_42_notes", "index-1")


def test_rows_without_key_or_time_stay(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1, 12)
    pay = spark.createDataFrame([(1, 1, t, 1), (2, None, t, 3), (3, 1, None, 6)], "payment_id long, user_id long, paid_at timestamp, months int")
    assert acc.running_subscription_end(pay).count() == 3
    ev = spark.createDataFrame([(1, 1, t, "/start"), (2, None, t, "/chat"), (3, 1, None, "x")], "event_id long, user_id long, ts timestamp, command string")
    got = {r.event_id: r.prior_24h for r in acc.trailing_24h(ev.unionAll(ev.where("event_id = 3"))).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_insert_if_absent_is_deterministic(spark):
    users = spark.createDataFrame([(1, "a")], "telegram_id long, username string")
    new = spark.createDataFrame([(2, "z"), (2, "b"), (1, "other")], "telegram_id long, username string")
    assert sorted(map(tuple, acc.insert_if_absent(users, new).collect())) == [(1, "a"), (2, "b")]


def test_the_last_known_inviter_wins(spark):
    users = spark.createDataFrame([(1, 101, None), (2, 102, 1), (3, 103, None), (4, 104, 2)], "user_id long, telegram_id long, invited_by_id long")
    starts = spark.createDataFrame([(101, 102, T0, 1), (101, 103, T0, 2), (101, 999, T0 + dt.timedelta(days=1), 3), (102, None, T0, 4), (103, 103, None, 5),
                                    (105, 101, T0, 6), (None, 101, T0, 7), (103, 101, T0, 8), (104, 998, T0, 9)],
                                   "telegram_id long, inviter long, ts timestamp, event_id long")
    got = {r.user_id: r.invited_by_id for r in acc.assign_inviters(users, starts).collect()}
    assert got == {1: 3, 2: 1, 3: 1, 4: 2}
    assert acc.assign_inviters(users, starts.where("false")).exceptAll(users).count() == 0
    assert acc.assign_inviters(users.where("false"), starts).count() == 0
