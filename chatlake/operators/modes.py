"""WIN5 / STR3: the mode in which each message is handled, as a machine with guards.

A message changes its user's mode depending on the mode itself and on what holds when it arrives: an active subscription, the
limits, stored notes, hits, a valid plan choice. Every message therefore becomes a function over the modes, and the running
composition of these functions (``operators/scan.py``) gives the mode before each message without walking a user's history in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.operators import accounts as acc
from chatlake.operators import scan
from chatlake.operators.windows import running_sum

# The modes (a mode's number is its place; no mode is null) and the commands.
MODES = (None, "notes", "chat", "search", "subscription_choice", "wait_for_payment", "wait_for_json")
NEUTRAL_COMMANDS = ("/help", "/link", "/update")
#: What a message may carry, and what holds where a column is absent; a null counts as false.
GUARDS = {"subscribed": True, "within_limits": True, "has_notes": True, "has_hits": False, "valid_choice": False, "paid": True}


def number(mode: Column) -> Column:
    """The number of a mode; null and unknown names are no mode."""
    out = F.lit(0)
    for n, name in enumerate(MODES[1:], 1):
        out = F.when(mode == name, n).otherwise(out)
    return out


def name(state: Column) -> Column:
    return F.element_at(F.array(*(F.lit(m).cast("string") for m in MODES)), state + 1)


def transition(messages: DataFrame, command: str = "command") -> Column:
    """Each message's function over the modes.

    A command wins over the mode: ``/start`` and ``/note`` lead to notes, ``/chat`` to the chat, ``/subscribe`` to the plan choice, ``/import`` to
    waiting for a file with a subscription, ``/search`` to the search within the limits and with stored notes; the neutral ones change nothing
    and ``reset`` clears the mode. A payment (``paid``: for a subscription) leads to notes, but while a plan is being chosen every other message is taken as
    a choice. Any other message: a valid choice leads to waiting for the payment; over the limits a subscriber's chat or search ends; a search
    that found something ends.
    """
    g = {k: F.coalesce(F.col(k), F.lit(False)) if k in messages.columns else F.lit(v) for k, v in GUARDS.items()}
    cmd = F.coalesce(F.col(command), F.lit(""))
    images = []
    for n, mode in enumerate(MODES):
        stay, to = F.lit(n), lambda m: F.lit(MODES.index(m))
        other = {"subscription_choice": F.when(g["valid_choice"] & (cmd != "payment"), to("wait_for_payment")).otherwise(stay),
                 "chat": F.when(g["subscribed"] & ~g["within_limits"], to(None)).otherwise(stay),
                 "search": F.when(g["subscribed"] & (~g["within_limits"] | g["has_hits"]), to(None)).otherwise(stay)}.get(mode, stay)
        paid = other if mode == "subscription_choice" else F.when(g["paid"], to("notes")).otherwise(stay)
        images.append(F.when(cmd.isin("/start", "/note"), to("notes")).when(cmd == "/chat", to("chat")).when(cmd == "/subscribe", to("subscription_choice"))
                      .when(cmd == "/import", F.when(g["subscribed"], to("wait_for_json")).otherwise(stay))
                      .when(cmd == "/search", F.when(g["within_limits"] & g["has_notes"], to("search")).otherwise(stay))
                      .when(cmd == "reset", to(None)).when(cmd == "payment", paid).when(cmd.isin(*NEUTRAL_COMMANDS), stay).otherwise(other))
    return scan.pack(images)


def route(messages: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id", command: str = "command",
          initial: DataFrame | None = None) -> DataFrame:
    """``messages`` with ``mode_before`` and ``mode_after``.

    ``initial`` (key, mode) is the mode each user had before these messages; it enters as one row before the user's first message
    that leads to that mode from any other. Messages without a user are those of one user; messages without a time come first.
    """
    rows = messages.withColumns({"_fn": transition(messages, command), "_seed": F.lit(1)})
    if initial is not None:
        known = messages.select(F.col(key).alias("_key")).distinct()
        seeds = initial.join(known, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
        seeds = seeds.select(key, scan.pack([number(F.col("mode"))] * len(MODES)).alias("_fn"), F.lit(0).alias("_seed"))
        rows = rows.unionByName(seeds, allowMissingColumns=True)
    rows = scan.running_state(rows, key, ["_seed", ts, tie], "_fn", len(MODES), "_before").where("_seed = 1")
    return rows.withColumns({"mode_before": name(F.col("_before")), "mode_after": name(scan.apply(F.col("_fn"), F.col("_before")))}
                            ).drop("_fn", "_seed", "_before")


def with_guards(messages: DataFrame, users: DataFrame, notes: DataFrame, allowlist: DataFrame | None = None, key: str = "user_id", ts: str = "ts",
                tie: str = "event_id", limit: int = acc.QUOTA_MESSAGES) -> DataFrame:
    """``messages`` with ``subscribed``, ``within_limits`` and ``has_notes`` as they stand when each message arrives.

    ``months`` of a message is the plan it pays for (null: no payment); a subscription runs 30 days a paid month from the first payment,
    paid months count from the next message on. ``users`` (key, username, vector_storage_volume) and ``notes`` (key) say the rest;
    a user that is in neither has no volume and no notes.
    """
    m = acc.trailing_24h(messages, key, ts, limit)
    m = m.withColumns({"_months": F.coalesce("months", F.lit(0)), "_paid_at": F.when(F.col("months").isNotNull(), F.col(ts))})
    m = running_sum(m, [key], [ts, tie], "_months", F.to_date(F.col(ts)), "_total", first_of="_paid_at")
    end = F.col("first__paid_at") + F.make_dt_interval(days=((F.col("_total") - F.col("_months")) * acc.DAYS_PER_MONTH).cast("int"))
    m = m.withColumn("_active", (F.col("_total") > F.col("_months")) & (end >= F.col(ts)))
    facts = users.select(F.col(key).alias("_u"), "username", F.col("vector_storage_volume").alias("_volume"))
    if allowlist is not None:
        allowed = allowlist.select("username").distinct().withColumn("_free", F.lit(True))
        facts = facts.join(allowed, "username", "left")
    else:
        facts = facts.withColumn("_free", F.lit(False))
    facts = facts.join(notes.select(F.col(key).alias("_u")).distinct().withColumn("_noted", F.lit(True)), "_u", "full_outer")
    m = m.join(facts.select("_u", "_volume", "_free", "_noted"), F.col(key) == F.col("_u"), "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return m.withColumns({"subscribed": yes(F.col("_active")) | yes(F.col("_free")), "has_notes": yes(F.col("_noted")),
                          "within_limits": F.col("within_quota") & (F.coalesce("_volume", F.lit(0.0)) <= acc.QUOTA_VOLUME)}
                         ).drop("prior_24h", "within_quota", "_months", "_paid_at", "_total", "first__paid_at", "_active", "_u", "_volume", "_free", "_noted")
