"""Accounts: subscriptions, access, quota, referrals, prices, shards (FLT5-8, FLT11, JN1-3, JN7,
AGG12-16, WIN1-2, WIN4, MTH1-2, STRF9, STRF12, DTF2-4).

Tables: users (user_id, telegram_id, username, invited_by_id), payments (payment_id, user_id,
paid_at, months), messages/events (user_id, ts, ...). ``as_of`` is always passed in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.operators.windows import running_sum, trailing_count
from chatlake.session import bounded_broadcast

# Monthly prices by plan length, the invite discount, minor units per unit,
# days per paid month, the quota limits. The shard (index) names are only defaults.
MONTHLY_PRICE = {1: 640, 3: 580, 6: 540, 12: 480}
INVITE_DISCOUNT = "0.8"
MINOR_UNITS = 100
DAYS_PER_MONTH = 30
INDEX_NAMES = ("index-1", "index-2", "index-3")
QUOTA_MESSAGES = 30
QUOTA_VOLUME = 200
DAY_MICROS = 86_400_000_000


def price_table(spark: SparkSession) -> DataFrame:
    """JN7: plan length -> monthly price (a fixed four-row table)."""
    # literal rows: a local relation, no Python-side RDD to scan
    rows = [F.struct(F.lit(m).alias("months"), F.lit(p).alias("monthly_price"))
            for m, p in sorted(MONTHLY_PRICE.items())]
    return spark.range(1).select(F.inline(F.array(*rows)))


def namespace(telegram_id) -> Column:
    """STRF9: per-user namespace name."""
    return F.format_string("user_%d_notes", F.col(telegram_id) if isinstance(telegram_id, str) else telegram_id)


def shard(telegram_id, current: str | None = None, names=INDEX_NAMES) -> Column:
    """MTH2: sticky shard: keep an assigned index, else a deterministic pick out of ``names``."""
    tid = F.col(telegram_id) if isinstance(telegram_id, str) else telegram_id
    pick = F.element_at(F.array(*[F.lit(n) for n in names]),
                        (F.pmod(tid, F.lit(len(names))) + 1).cast("int"))
    return F.coalesce(F.col(current), pick) if current else pick


def payload_split(payload) -> tuple[Column, Column]:
    """STRF12: ``goal_months`` -> (goal, months); a bad number gives null."""
    p = F.col(payload) if isinstance(payload, str) else payload
    return F.split_part(p, F.lit("_"), F.lit(1)), F.split_part(p, F.lit("_"), F.lit(2)).try_cast("int")


# ---------------------------------------------------------------- subscriptions

def subscription_end(payments: DataFrame) -> DataFrame:
    """AGG15: end = first payment + 30 days per paid month (extends from the old end, never reset).

    One partial aggregate per user: skew-safe.
    """
    days = F.col("total_months") * DAYS_PER_MONTH
    return (payments.groupBy("user_id")
            .agg(F.min("paid_at").alias("first_paid"), F.sum("months").alias("total_months"),
                 F.count(F.lit(1)).alias("n_payments"))
            .withColumn("subscription_end_date", F.col("first_paid") + F.make_dt_interval(days=days)))


def running_subscription_end(payments: DataFrame, bucket: Column | None = None) -> DataFrame:
    """WIN4: end date after each payment (first payment + 30 days x running months).

    The running sum is split by day (``running_sum``): a user with a third of all payments is
    windowed per (user, day), and only one summary row per day is windowed per user.
    """
    bucket = bucket if bucket is not None else F.to_date("paid_at")
    order = ["paid_at", "payment_id"]
    r = running_sum(payments, ["user_id"], order, "months", bucket, "running_months", first_of="paid_at")
    return (r.withColumn("end_after", F.col("first_paid_at")
                         + F.make_dt_interval(days=F.col("running_months") * DAYS_PER_MONTH))
            .drop("first_paid_at"))


def with_access(users: DataFrame, ends: DataFrame, as_of: str, allowlist: DataFrame | None = None) -> DataFrame:
    """FLT6-7: active = end set and end >= as_of; access = active or username on the allow-list."""
    u = users.join(ends.select("user_id", "subscription_end_date"), "user_id", "left")
    active = F.coalesce(F.col("subscription_end_date") >= F.lit(as_of).cast("timestamp"), F.lit(False))
    u = u.withColumn("active", active)
    if allowlist is None:
        return u.withColumn("access", F.col("active"))
    allow = allowlist.select(F.col("username").alias("_allowed")).distinct()
    return (u.join(allow, u["username"] == allow["_allowed"], "left")
            .withColumn("access", F.col("active") | F.col("_allowed").isNotNull()).drop("_allowed"))


# ---------------------------------------------------------------- users and referrals

def referral_counts(users: DataFrame, ends: DataFrame) -> DataFrame:
    """JN2 + AGG12: per user, invited users and those of them with a subscription end set.

    Invitees are aggregated per inviter first (partial aggregate), then joined to the users,
    so a hot inviter never meets a skewed join.
    """
    inv = (users.where(F.col("invited_by_id").isNotNull()).select("user_id", "invited_by_id")
           .join(ends.select("user_id", "subscription_end_date"), "user_id", "left")
           .groupBy(F.col("invited_by_id").alias("user_id"))
           .agg(F.count(F.lit(1)).alias("invited_total"),
                F.count("subscription_end_date").alias("invited_paid")))
    return (users.select("user_id").join(inv, "user_id", "left")
            .select("user_id", F.coalesce("invited_total", F.lit(0)).alias("invited_total"),
                    F.coalesce("invited_paid", F.lit(0)).alias("invited_paid")))


def insert_if_absent(users: DataFrame, incoming: DataFrame, key: str = "telegram_id") -> DataFrame:
    """JN3: add incoming users whose key is new (defaults apply to them only); existing rows untouched.

    Of several incoming rows with one key the smallest (column by column) is added, so a rerun adds the same.
    """
    rest = [c for c in incoming.columns if c != key]
    one = incoming.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*")
    new = one.select(*incoming.columns).join(users.select(key), key, "left_anti")
    return users.unionByName(new, allowMissingColumns=True)


def assign_inviters(users: DataFrame, starts: DataFrame, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """JN2: ``users`` after the deep links in ``starts`` (telegram_id, inviter, ts, event_id): the last link that names a user wins.

    A link without an inviter, or whose inviter is no user, changes nothing; a user may name themselves. Links are first reduced to
    their last time per (user, inviter), so neither a user's nor an inviter's many links meet in one task; the known inviters are
    broadcast only if they measure small enough.
    """
    links = (starts.where(F.col("inviter").isNotNull() & F.col("telegram_id").isNotNull()).groupBy("telegram_id", "inviter")
             .agg(F.max(F.struct(ts, tie)).alias("_at")))
    named = links.select("inviter").distinct()
    known, _ = bounded_broadcast(users.select(F.col("telegram_id").alias("inviter"), F.col("user_id").alias("_by")).dropDuplicates(["inviter"])
                                 .join(named, "inviter", "left_semi"), "inviters")
    last = links.join(known, "inviter").groupBy("telegram_id").agg(F.max_by("_by", "_at").alias("_by"))
    return (users.join(last, "telegram_id", "left").withColumn("invited_by_id", F.coalesce("_by", "invited_by_id"))
            .select(*users.columns))


# ---------------------------------------------------------------- quota

def trailing_24h(messages: DataFrame, key: str = "user_id", ts: str = "ts",
                 limit: int = QUOTA_MESSAGES) -> DataFrame:
    """WIN1 + FLT8: messages of the user in the 24 hours before each message (itself excluded)."""
    t = trailing_count(messages, [key], ts, DAY_MICROS, "_n")
    return (t.withColumn("prior_24h", F.col("_n") - 1).drop("_n")
            .withColumn("within_quota", F.col("prior_24h") <= limit))


def quota_as_of(users: DataFrame, messages: DataFrame, as_of: str, key: str = "user_id", ts: str = "ts",
                volume: str = "vector_storage_volume") -> DataFrame:
    """AGG13 + FLT8: every user's messages in [as_of - 1 day, as_of], and whether count and stored volume are within the limits.

    Users without messages have none; a null volume is none. Messages are counted by a partial aggregate before they meet the users.
    """
    t, end = F.col(ts).cast("timestamp"), F.lit(as_of).cast("timestamp")
    counts = messages.where((t >= end - F.expr("INTERVAL 1 DAY")) & (t <= end)).groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    n, vol = F.coalesce("_n", F.lit(0)), F.coalesce(F.col(volume), F.lit(0.0))
    return (users.select(key, vol.alias(volume)).join(counts, F.col(key).eqNullSafe(F.col("_k")), "left")
            .select(key, n.alias("n_24h"), ((n <= QUOTA_MESSAGES) & (F.col(volume) <= QUOTA_VOLUME)).alias("within_limits")))


# ---------------------------------------------------------------- prices

def priced_choices(payments: DataFrame, users: DataFrame, prices: DataFrame) -> DataFrame:
    """FLT11 + JN7 + MTH1: valid plan choices with their amount in minor units.

    price = monthly x months, x 0.8 when the user was invited, x 100 (DECIMAL arithmetic).
    How the price table is joined is left to its size.
    """
    p = payments.join(prices.dropDuplicates(["months"]), "months")
    invited = users.select("user_id", F.col("invited_by_id").isNotNull().alias("invited"))
    base = (F.col("monthly_price") * F.col("months")).cast("decimal(12,2)")
    amount = F.when(F.col("invited"), base * F.lit(INVITE_DISCOUNT).cast("decimal(3,2)")).otherwise(base)
    return (p.join(invited, "user_id", "left")
            .select("payment_id", "user_id", "months", F.coalesce("invited", F.lit(False)).alias("invited"),
                    F.round(amount * MINOR_UNITS, 2).cast("decimal(14,2)").alias("amount_minor")))


def rejected_choices(payments: DataFrame, prices: DataFrame) -> DataFrame:
    """FLT11 (rejects): payments whose choice is not a known plan."""
    return payments.join(prices.select("months"), "months", "left_anti")


# ---------------------------------------------------------------- notes

def users_with_notes(users: DataFrame, notes: DataFrame, key: str = "user_id") -> DataFrame:
    """AGG14: users that have at least one note (a semi join, no note is fetched)."""
    # distinct keys first (map-side): a user with a third of all notes becomes one row
    return users.join(notes.select(key).distinct(), key, "left_semi")


def note_text(text: str = "text", caption: str | None = None) -> Column:
    """FLT5: the note text, else the caption; empty strings count as missing (null = rejected)."""
    t = F.nullif(F.col(text), F.lit(""))
    return F.coalesce(t, F.nullif(F.col(caption), F.lit(""))) if caption else t


def first_per_group(df: DataFrame, group: str, order: str) -> DataFrame:
    """WIN2 + AGG14: first item of each group and the group size (one partial aggregate)."""
    return df.groupBy(group).agg(F.min(order).alias(f"first_{order}"), F.count(F.lit(1)).alias("n_items"))
