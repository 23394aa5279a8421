"""Overload control and supervision as folds over event time: admission, breakers, budgets, hysteresis, membership.

Time is a column, never the clock, so the same log always gives the same decisions. All states are a few numbers."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.operators.fold import KeyedFold, arrow_schema, ordered_fold

EPSILON = 1e-9
#: Rows of a served order that are sent on at once.
CHUNK = 1 << 16


class Bucket:
    """Starts full; the first call only anchors its clock, and a clock that doesn't advance refills nothing."""

    __slots__ = ("cap", "rate", "tokens", "last")

    def __init__(self, cap: float, rate: float):
        self.cap, self.rate, self.tokens, self.last = cap, rate, cap, None

    def take(self, us: int, cost: float = 1.0) -> bool:
        if self.last is None:
            self.last = us
        elif us > self.last:
            self.tokens = min(self.cap, self.tokens + float((us - self.last) * 1000) * 1e-9 * self.rate)
            self.last = us
        if self.tokens + EPSILON >= cost:
            self.tokens -= cost
            return True
        return False


class Limiter(Protocol):
    """Any admission rule; ``take`` sees the rows of a key in order."""

    def take(self, us: int, cost: float = 1.0) -> bool: ...


def limited(make: Callable[[], Limiter] | None) -> KeyedFold:
    """Admission by a limiter of one's own, made anew for each key; without one everything is accepted."""

    def step(limiter: Limiter | None, row: dict) -> tuple:
        return limiter, {"seq": row["seq"], "admitted": limiter is None or limiter.take(row["us"])}

    return KeyedFold(make or (lambda: None), step, "seq long, admitted boolean")


def single_producer(rows: DataFrame, key: list[str], order: list[str], producer: str = "producer") -> DataFrame:
    """``outcome`` of binding a stream's producer: the first of a key is bound, any other is refused as unavailable."""
    first = F.first(producer).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("outcome", F.when(F.col(producer) == first, "bound").otherwise("unavailable"))


def token_bucket(cap: float, per_second: float, cost: str | None = None) -> KeyedFold:
    def step(bucket: Bucket, row: dict) -> tuple:
        return bucket, {"seq": row["seq"], "admitted": bucket.take(row["us"], float(row[cost]) if cost else 1.0)}

    return KeyedFold(lambda: Bucket(cap, per_second), step, "seq long, admitted boolean", reads=["us", "seq", *([cost] if cost else [])])


def fair_share(weights: dict[str, float], total_rate: float, total_burst: float, key: str = "kind") -> KeyedFold:
    """Each configured key gets its share of rate and burst; run it on the rows of those keys, as others always pass."""
    if len(weights) > 16 or any(w <= 0 for w in weights.values()):
        raise ValueError("at most 16 keys, and weights above zero")
    whole = sum(weights.values())

    def step(bucket: Bucket | None, row: dict) -> tuple:
        if bucket is None:
            share = weights[row[key]] / whole
            bucket = Bucket(total_burst * share, total_rate * share)
        return bucket, {"seq": row["seq"], "admitted": bucket.take(row["us"])}

    return KeyedFold(lambda: None, step, "seq long, admitted boolean", reads=[key, "us", "seq"])


def circuit_breaker(threshold: int, open_us: int) -> KeyedFold:
    """Rows are sends whose result follows at once: ``failed`` says which. Consecutive failures open the circuit, sends
    are shed until ``open_us`` has passed, then one probe closes or re-opens it."""
    threshold = max(1, threshold)

    def step(state: tuple[str, int, int], row: dict) -> tuple:
        name, fails, opened = state
        us, failed = row["us"], row["failed"]
        if name == "open" and us - opened < open_us:
            return state, {"seq": row["seq"], "sent": False, "circuit": "open"}
        if name == "open":  # this send is the probe
            state = ("open", fails, us) if failed else ("closed", 0, 0)
        elif failed:
            state = ("open", fails + 1, us) if fails + 1 >= threshold else ("closed", fails + 1, 0)
        else:
            state = ("closed", 0, 0)
        return state, {"seq": row["seq"], "sent": True, "circuit": state[0]}

    return KeyedFold(lambda: ("closed", 0, 0), step, "seq long, sent boolean, circuit string", reads=["us", "seq", "failed"])


def congestion_gate(cap: float, per_second: float) -> KeyedFold:
    """Rows with ``until_us`` mark the peer congested until then; others are admitted freely unless it is, and then
    through a bucket."""

    def step(state: tuple[int, Bucket], row: dict) -> tuple:
        until, bucket = state
        if row["until_us"] is not None:
            return (row["until_us"], bucket), None
        return state, {"seq": row["seq"], "admitted": row["us"] >= until or bucket.take(row["us"])}

    return KeyedFold(lambda: (0, Bucket(cap, per_second)), step, "seq long, admitted boolean", reads=["us", "seq", "until_us"])


def congestion_edge(high: int, low: int, refresh_us: int, total: str = "amount") -> KeyedFold:
    """Fires when the total reaches ``high``, again at each refresh while it stays there; re-arms below ``low``."""

    def step(state: tuple[bool, int], row: dict) -> tuple:
        active, following = state
        fired = False
        if row[total] >= high:
            if not active or row["us"] >= following:
                fired, active, following = True, True, row["us"] + refresh_us
        elif row[total] < low:
            active = False
        return (active, following), {"seq": row["seq"], "fired": fired}

    return KeyedFold(lambda: (False, 0), step, "seq long, fired boolean", reads=["us", "seq", total])


def restart_budget(most: int, window_us: int) -> KeyedFold:
    """A budget that starts anew when more than the window has passed since its first charge; all charges count."""

    def step(state: tuple[int | None, int], row: dict) -> tuple:
        start, count = state
        if window_us > 0 and (start is None or row["us"] - start > window_us):
            start, count = row["us"], 0
        return (start, count + 1), {"seq": row["seq"], "allowed": count + 1 <= most}

    return KeyedFold(lambda: (None, 0), step, "seq long, allowed boolean", reads=["us", "seq"])


def _source(most: int, window_us: int, state: tuple[int | None, int], us: int) -> tuple[tuple[int | None, int], bool]:
    start, count = state
    if start is None or (window_us > 0 and us - start >= window_us):
        start, count = us, 0
    if count >= most:
        return (start, count), False
    return (start, count + 1), True


def source_cap(most: int, window_us: int) -> KeyedFold:
    """As ``restart_budget``, but it starts anew when the window has just passed, and rejected rows don't count."""

    def step(state: tuple, row: dict) -> tuple:
        state, ok = _source(most, window_us, state, row["us"])
        return state, {"seq": row["seq"], "allowed": ok}

    return KeyedFold(lambda: (None, 0), step, "seq long, allowed boolean", reads=["us", "seq"])


def escalation_guard(
    rows: DataFrame, supervisor: list[str], source: list[str], order: list[str], cap: float, per_second: float, most: int, window_us: int, ttl_us: int
) -> DataFrame:
    """supervisor, source, seq, ``admitted``, ``deadline_us`` of each escalation (columns us, seq): a bucket over all of a
    supervisor's sources comes first, and its token is spent even if the source's own cap then rejects. A rate, cap or
    time to live of 0 switches that part off; without a time to live, and for what is shed, the deadline is 0.

    Two folds: one down each supervisor with a bucket as its state, one down each of its sources with a count, so no
    state grows with the sources."""
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in dict.fromkeys([*source, *order, "us", "seq"]))

    def first(bucket: Bucket, row: dict) -> tuple:
        return bucket, {c: row[c] for c in dict.fromkeys([*source, *order, "us", "seq"])} | {"_taken": per_second <= 0 or bucket.take(row["us"])}

    def second(state: tuple, row: dict) -> tuple:
        ok = row["_taken"]
        if ok and most > 0:
            state, ok = _source(most, window_us, state, row["us"])
        return state, {"seq": row["seq"], "admitted": ok, "deadline_us": row["us"] + ttl_us if ok and ttl_us > 0 else 0}

    taken = ordered_fold(rows, supervisor, order, KeyedFold(lambda: Bucket(cap, per_second), first, f"{fields}, _taken boolean"))
    return ordered_fold(
        taken, [*supervisor, *source], order, KeyedFold(lambda: (None, 0), second, "seq long, admitted boolean, deadline_us long")
    )


def retry(times: int, most: int, window_us: int) -> KeyedFold:
    """A message that fails ``fails`` times runs again up to ``times`` times, each charged to the restart budget; with
    the budget gone it is escalated, with its runs gone dead-lettered."""

    def step(state: tuple[int | None, int], row: dict) -> tuple:
        start, count = state
        runs = min(row["fails"], times)
        if runs and (start is None or row["us"] - start > window_us):
            start, count = row["us"], 0
        if not runs:
            outcome = "handled"
        elif count + runs > most:
            outcome, count = "escalated", count + max(0, most - count) + 1
        else:
            outcome, count = ("recovered" if row["fails"] <= times else "dead_letter"), count + runs
        return (start, count), {"seq": row["seq"], "outcome": outcome}

    return KeyedFold(lambda: (None, 0), step, "seq long, outcome string", reads=["us", "seq", "fails"])


def stabilise(settle_us: int, digest: str = "digest") -> KeyedFold:
    """Commits a changed digest once it has been seen unchanged for the settle time; a flap back cancels. The first row
    is the roster committed at the start."""

    def step(state: tuple | None, row: dict) -> tuple:
        d, us = row[digest], row["us"]
        if state is None:
            return (d, None, 0), {"seq": row["seq"], "committed": False}
        committed, pending, since = state
        if d == committed:
            return (committed, None, 0), {"seq": row["seq"], "committed": False}
        if pending is None or d != pending:
            return (committed, d, us), {"seq": row["seq"], "committed": False}
        if us - since >= settle_us:
            return (d, None, 0), {"seq": row["seq"], "committed": True}
        return state, {"seq": row["seq"], "committed": False}

    return KeyedFold(lambda: None, step, "seq long, committed boolean", reads=["us", "seq", digest])


def membership() -> KeyedFold:
    """State of a node after all rumours in order: alive wins on a higher incarnation only, suspect also on an equal one
    over alive, dead on an equal or higher one; and dead is final."""

    def step(state: tuple[str, int] | None, row: dict) -> tuple:
        status, inc = row["status"], row["incarnation"]
        if state is None:
            return (status, inc), None
        old, cur = state
        if old == "dead":
            return state, None
        wins = inc > cur or (inc == cur and (status == "dead" or (status == "suspect" and old == "alive")))
        return ((status, inc) if wins else state), None

    return KeyedFold(
        lambda: None, step, "status string, incarnation long", lambda s: {"status": s[0], "incarnation": s[1]}, ["status", "incarnation"]
    )


def refutation() -> KeyedFold:
    """What a node makes of rumours about itself: one that says it isn't alive, at its own incarnation or a later one, is
    answered by the next incarnation, and nothing else changes it."""

    def step(own: int, row: dict) -> tuple:
        refutes = row["status"] != "alive" and row["incarnation"] >= own
        own = row["incarnation"] + 1 if refutes else own
        return own, {"seq": row["seq"], "refuted": refutes, "own": own}

    return KeyedFold(lambda: 0, step, "seq long, refuted boolean, own long", reads=["seq", "status", "incarnation"])


def credit_channel(capacity: int, service_us: int) -> KeyedFold:
    """A lossless stream with ``capacity`` credits: a frame that finds none left stalls its producer until the consumer, who
    takes ``service_us`` a frame, has finished one. ``pushed_us`` and ``done_us`` of each frame, and whether it stalled.
    The state is the time at which each of the last ``capacity`` frames is done."""

    def step(state: tuple[int, list[int]], row: dict) -> tuple:
        last, done = state
        ready = max(row["us"], last)
        pushed = max(ready, done[0]) if len(done) == capacity else ready
        end = max(pushed, done[-1] if done else 0) + service_us
        out = {"seq": row["seq"], "pushed_us": pushed, "done_us": end, "stalled": pushed > ready}
        return (pushed, [*done[-capacity + 1 :], end] if capacity > 1 else [end]), out

    return KeyedFold(lambda: (0, []), step, "seq long, pushed_us long, done_us long, stalled boolean", reads=["us", "seq"])


def _by_band(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*key, "band").orderBy(*order)).cast("long")
    return rows.withColumn("_i", place - 1)


def rotating_reserve(rows: DataFrame, key: list[str], order: list[str], bands: int, every: int) -> DataFrame:
    """``place`` in which a key's messages of ``bands`` priorities (column ``band``) are served when all wait at once: the top
    band, but each ``every``-th turn the next band in rotation.

    The turns depend on how many wait in each band alone, so they are run from one row of counts for each key, as a
    stream of (band, place in it, place), and joined to the messages."""
    keys = [rows.schema[k] for k in key]
    schema = T.StructType([*keys, *T.StructType.fromDDL("band int, _i long, place long").fields])

    def turns(left: list[int]) -> Iterator[tuple[int, int, int]]:
        total, cursor, heads = sum(left), 0, [0] * bands
        for place in range(1, total + 1):
            waiting = [b for b in range(bands) if heads[b] < left[b]]
            band = waiting[0]
            if place % every == 0:
                band = min(waiting, key=lambda b: (b - cursor) % bands)
                cursor = (band + 1) % bands
            yield band, heads[band], place
            heads[band] += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(schema)
        for batch in batches:
            for row in batch.to_pylist():
                served, own = turns([row[f"_n{b}"] for b in range(bands)]), [row[k] for k in key]
                while part := list(itertools.islice(served, CHUNK)):
                    columns = [[x] * len(part) for x in own] + [list(c) for c in zip(*part, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    counts = rows.groupBy(*key).agg(*[F.count(F.when(F.col("band") == b, 1)).alias(f"_n{b}") for b in range(bands)])
    return _by_band(rows, key, order).join(counts.mapInArrow(run, schema), [*key, "band", "_i"]).drop("_i")


def deficit_round_robin(rows: DataFrame, key: list[str], order: list[str], weights: list[int]) -> DataFrame:
    """As ``rotating_reserve`` by deficits: a band is served while it has credit, which each visit raises by its weight. A
    visit costs one, and weights are at least one, so a band that has its turn keeps it until it is empty: the order is
    band after band."""
    if min(weights) < 1:
        raise ValueError("weights of at least one")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("band", *order)).cast("long")
    return rows.filter(F.col("band") < len(weights)).withColumn("place", place)


def two_choices(slots: int, salt: int = 0) -> KeyedFold:
    """Slot of each message of a pool that doesn't drain meanwhile: the emptier of two hashed slots, the first on a tie."""
    from strandlog.functions.hashing import py_splitmix64

    def step(state: tuple[int, list[int]], row: dict) -> tuple:
        t, depth = state
        r = py_splitmix64((t + salt) & ((1 << 64) - 1))
        a, b = r % slots, (r >> 32) % slots
        slot = a if depth[a] <= depth[b] else b
        depth[slot] += 1
        return (t + 1, depth), {"seq": row["seq"], "slot": slot}

    return KeyedFold(lambda: (0, [0] * slots), step, "seq long, slot long", reads=["seq"])
