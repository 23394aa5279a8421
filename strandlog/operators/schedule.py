"""Timers and reminders as functions of event time: expiries, series, cancellation, flattening, idle sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions import hashing as h
from strandlog.functions.scalars import ticks_ceil
from strandlog.operators.fold import KeyedFold
from strandlog.operators.logs import placed


def one_shot(now_tick: Column, delay: Column, tick: int) -> Column:
    """The tick whose processing fires the timer."""
    return now_tick + ticks_ceil(delay, tick)


def series(rows: DataFrame, first: Column, period: Column, horizon: Column) -> DataFrame:
    """``fire``: every firing up to the horizon, each a period after the one before, without drift; also how an overdue
    reminder catches up, from what was scheduled. Rows with no period fire once."""
    fires = F.when(first <= horizon, F.when(period > 0, F.sequence(first, horizon, period)).otherwise(F.array(first)))
    return rows.withColumn("fire", F.explode(fires))


def periodic_timer(kind: str, arms: str, cancels: str, period: int) -> KeyedFold:
    """A timer in a key's state: rows of the one kind arm it anew, of the other cancel it. ``fired`` counts the firings that
    came due up to each row, each a period after the one before, without drift."""

    def step(due: int | None, row: dict) -> tuple:
        fired = 0 if due is None or row["us"] < due else (row["us"] - due) // period + 1
        if row[kind] == arms:
            due = row["us"] + period
        elif row[kind] == cancels:
            due = None
        elif due is not None:
            due += fired * period
        return due, {"seq": row["seq"], "fired": fired}

    return KeyedFold(lambda: None, step, "seq long, fired long", reads=["us", "seq", kind])


def without_cancelled(fires: DataFrame, cancels: DataFrame, key: list[str]) -> DataFrame:
    """Firings of timers of the same generation that weren't cancelled before. cancels: key, generation, cancel_at."""
    first = cancels.groupBy(*key, "generation").agg(F.min("cancel_at").alias("cancel_at"))
    rows = fires.join(first, [*key, "generation"], "left")
    return rows.filter(F.col("cancel_at").isNull() | (F.col("cancel_at") >= F.col("fire"))).drop("cancel_at")


def due_bucket(due: Column, width: int) -> Column:
    return F.floor(due / width).cast("long")


def drain_rank(rows: DataFrame, actor_hash: str, name_hash: str, out: str = "rank") -> DataFrame:
    """``rank`` sorts ready reminders in an order that spreads actors and names."""

    def rank() -> Column:
        return h.unsigned(h.splitmix64(F.col(actor_hash).bitwiseXOR(F.col(name_hash) * F.lit(h.signed(h.GOLDEN)).cast("long"))))

    return h.wrapped(rows, **{out: rank})


def flatten_wave(rows: DataFrame, wave: list[str], rank: list[str], per_tick: int) -> DataFrame:
    """``tick``: in which tick each reminder of a wave that is due at once fires, at most ``per_tick`` in each."""
    return placed(rows, wave, rank, "_place").withColumn("tick", F.floor((F.col("_place") - 1) / per_tick).cast("long")).drop("_place")


def grants(gaps: list[int], per_bucket: int, credit: int) -> list[int]:
    """Reminders that each tick of a cadence may fire while some are waiting: tokens for the buckets since the tick before,
    never more than ``credit``. All that is granted is then spent, so the grants repeat with the cadence."""
    return [min(credit, per_bucket * gap) for gap in gaps]


def paced_wave(rows: DataFrame, wave: list[str], rank: list[str], granted: list[int]) -> DataFrame:
    """``tick`` as in ``flatten_wave`` where ticks come in a cadence with a grant for each."""
    whole, upto = sum(granted), F.lit(0)
    place = F.pmod(F.col("_place") - 1, F.lit(whole))
    for k in range(len(granted) - 1, -1, -1):
        upto = F.when(place >= sum(granted[:k]), F.greatest(upto, F.lit(k))).otherwise(upto)
    tick = F.floor((F.col("_place") - 1) / whole) * len(granted) + upto
    return placed(rows, wave, rank, "_place").withColumn("tick", tick.cast("long")).drop("_place")


def confirm(store: DataFrame, fired: DataFrame, key: list[str]) -> DataFrame:
    """The store after a tick: of the reminders that fired and were confirmed, periodic ones are due a period after they
    were scheduled and others are gone; all that didn't fire, or whose confirmation was lost, stay as they were, so they fire
    again as the same (key, due). store: key, due, period; fired: key, confirmed."""
    done = fired.filter("confirmed").select(*key, F.lit(True).alias("_done"))
    rows = store.join(done, key, "left")
    moved = F.when(F.col("_done"), F.col("due") + F.col("period")).otherwise(F.col("due"))
    return rows.filter(F.col("_done").isNull() | (F.col("period") > 0)).withColumn("due", moved).drop("_done")


def idle_sessions(rows: DataFrame, key: list[str], at: str, order: list[str], timeout: int) -> DataFrame:
    """``session``: an activation ends once nothing has come for longer than the timeout."""
    w = Window.partitionBy(*key).orderBy(*order)
    fresh = F.coalesce(F.col(at) - F.lag(at).over(w) > timeout, F.lit(True)).cast("long")
    total = F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_fresh", fresh).withColumn("session", total - 1).drop("_fresh")


def confirmed(fires: DataFrame, key: list[str]) -> DataFrame:
    """Firings repeated after a crash count once: (actor, name, scheduled) is their key."""
    return fires.dropDuplicates(key)
