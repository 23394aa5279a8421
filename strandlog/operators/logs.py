"""Append-only logs: order within a key, duplicates, fences, appends, snapshots, bounded rings, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.model import cut
from strandlog.operators.fold import KeyedFold, ordered_fold


def _w(key: list[str], order: list[str | Column]) -> Window:
    return Window.partitionBy(*key).orderBy(*order)


def _before(key: list[str], order: list[str | Column]) -> Window:
    return _w(key, order).rowsBetween(Window.unboundedPreceding, -1)


def fifo_position(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``pos``: the row's place in its key's queue, from 1."""
    return rows.withColumn("pos", F.row_number().over(_w(key, order)).cast("long"))


def placed(rows: DataFrame, key: list[str], order: list[str], out: str = "pos", value: Column | None = None) -> DataFrame:
    """As ``fifo_position``, or as ``running_total`` of a ``value``, for few keys with very many rows: rows are dealt into
    ranges of (key, order) and written, each range's rows are ranked or summed by themselves, and what lies in earlier
    ranges of the key is added. Only one number for each key and range is ranked in one place. Rows that agree in key and
    order lie in one range."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_v", F.lit(1).cast("long") if value is None else value.cast("long"))
    dealt = cut(dealt.repartitionByRange(n, *key, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    each = dealt.groupBy(*[F.col(k).alias(f"_{k}") for k in key], F.col("_range").alias("_r")).agg(F.sum("_v").alias("_n"))
    earlier = Window.partitionBy(*[f"_{k}" for k in key]).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    before = each.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    same = [dealt[k].eqNullSafe(before[f"_{k}"]) for k in key] + [dealt["_range"] == before["_r"]]
    within = F.sum("_v").over(Window.partitionBy(*key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(out, within).join(before, same).withColumn(out, F.col(out) + F.col("_before")).select(*rows.columns, out)


def running_total(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """``total``: the key's sum up to and including this row, which is what an ask at this row would return."""
    w = _w(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total", F.sum(value).over(w))


def scan_from(rows: DataFrame, start: Column | int, seq: str = "seq") -> DataFrame:
    """Events with seq >= start; the filter reaches the files."""
    return rows.filter(F.col(seq) >= start)


def mark_duplicates(rows: DataFrame, key: list[str], order: list[str], seq: str = "seq") -> DataFrame:
    """``accepted``: seq exceeds all that the key had before; a key's first row always passes."""
    high = F.max(seq).over(_before(key, order))
    return rows.withColumn("accepted", high.isNull() | (F.col(seq) > high))


def mark_stale(rows: DataFrame, key: list[str], order: list[str], seq: str = "seq") -> DataFrame:
    """As ``mark_duplicates`` for datagrams: the high mark starts at 0, so seq 0 never passes."""
    high = F.max(seq).over(_before(key, order))
    return rows.withColumn("accepted", F.col(seq) > F.coalesce(high, F.lit(0)))


def reply_gaps(rows: DataFrame, key: list[str], order: list[str], seq: str = "seq") -> DataFrame:
    """``accepted`` and ``gap`` of a reply stream: next starts at 0, a row at or beyond it is accepted, beyond it shows a
    gap, and next becomes seq + 1."""
    following = F.coalesce(F.max(seq).over(_before(key, order)) + 1, F.lit(0))
    accepted = F.col(seq) >= following
    return rows.withColumn("accepted", accepted).withColumn("gap", accepted & (F.col(seq) > following))


def credit_advances(rows: DataFrame, key: list[str], order: list[str], tail: str) -> DataFrame:
    """``advanced``: the remote tail strictly exceeds the largest so far (0 at first)."""
    high = F.coalesce(F.max(tail).over(_before(key, order)), F.lit(0))
    return rows.withColumn("advanced", F.col(tail) > F.greatest(high, F.lit(0)))


def fence(rows: DataFrame, key: list[str], order: list[str], token: str = "token") -> DataFrame:
    """Rows whose token is no less than any token before it."""
    high = F.max(token).over(_w(key, order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_high", high).filter(F.col(token) >= F.col("_high")).drop("_high")


def atomic_append(batches: DataFrame, key: list[str], batch: str, seq: str = "seq", token: str = "token") -> DataFrame:
    """key, batch, outcome (appended, fenced or out_of_order), last_seq: batches of rows in order of ``batch``. A batch
    needs a token no less than the owner's and seqs that increase strictly, also beyond the last appended one; it is
    appended whole or not at all."""
    w = _w([*key, batch], [F.col("pos")])
    rows = batches.withColumn("_up", F.coalesce(F.col(seq) > F.lag(seq).over(w), F.lit(True)))
    whole = rows.groupBy(*key, batch).agg(
        F.bool_and("_up").alias("up"), F.min_by(seq, "pos").alias("first"), F.max(seq).alias("last"), F.max(token).alias("tok")
    )

    def step(state: tuple[int, int], row: dict) -> tuple:
        owner, last = state
        if row["tok"] < owner:
            outcome = "fenced"
        elif not row["up"] or row["first"] <= last:
            outcome = "out_of_order"
        else:
            outcome, owner, last = "appended", row["tok"], row["last"]
        if outcome != "fenced":
            owner = max(owner, row["tok"])
        return (owner, last), {"batch": row[batch], "outcome": outcome, "last_seq": last}

    fold = KeyedFold(lambda: (0, -1), step, "batch long, outcome string, last_seq long")
    return ordered_fold(whole, key, [batch], fold)


def latest_snapshot(rows: DataFrame, key: list[str], order: list[str], last_seq: Column, through: str = "through_seq") -> DataFrame:
    """The last valid snapshot of each key: one that claims more than the log holds is rejected."""
    fields = [c for c in rows.columns if c not in key]
    valid = rows.filter(F.col(through) <= last_seq)
    latest = F.max_by(F.struct(*fields), F.struct(*order)).alias("_s")
    return valid.groupBy(*key).agg(latest).select(*key, *[F.col(f"_s.{f}").alias(f) for f in fields])


def replay(events: DataFrame, key: list[str], value: str = "amount", seq: str = "seq") -> DataFrame:
    """State of an event-sourced ledger: balance, how many events were applied, the last seq."""
    return events.groupBy(*key).agg(
        F.sum(value).alias("balance"), F.count("*").alias("applied"), F.max(seq).alias("last_seq")
    )


def snapshot_and_tail(snapshots: DataFrame, events: DataFrame, key: list[str], value: str = "amount", seq: str = "seq") -> DataFrame:
    """The same state from a snapshot (balance, applied, through_seq) and the events after it."""
    tail = events.join(snapshots.select(*key, "through_seq"), key, "left").filter(
        F.col("through_seq").isNull() | (F.col(seq) > F.col("through_seq"))
    )
    after = replay(tail, key, value, seq).select(
        *key, F.col("balance").alias("_b"), F.col("applied").alias("_n"), F.col("last_seq").alias("_l")
    )
    zero = F.lit(0).cast("long")
    return snapshots.join(after, key, "full").select(
        *key,
        (F.coalesce("balance", zero) + F.coalesce("_b", zero)).alias("balance"),
        (F.coalesce("applied", zero) + F.coalesce("_n", zero)).alias("applied"),
        F.coalesce("_l", "through_seq").alias("last_seq"),
    )


def upsert_latest(rows: DataFrame, key: list[str], arrival: list[str], removed: str = "removed") -> DataFrame:
    """Last write of each key, unless that removes it; also the compaction of such a log."""
    fields = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*fields), F.struct(*arrival)).alias("_s")
    out = rows.groupBy(*key).agg(last).filter(~F.col(f"_s.{removed}"))
    return out.select(*key, *[F.col(f"_s.{f}").alias(f) for f in fields if f != removed])


def ring(rows: DataFrame, key: list[str], order: list[str], cap: int) -> tuple[DataFrame, DataFrame]:
    """The last ``cap`` rows of each ring, and how many of its rows were dropped."""
    back = F.row_number().over(_w(key, [F.col(c).desc() for c in order]))
    kept = rows.withColumn("_r", back).filter(F.col("_r") <= cap).drop("_r")
    lost = rows.groupBy(*key).agg(F.greatest(F.count("*") - cap, F.lit(0)).cast("long").alias("dropped"))
    return kept, lost


def drain_batches(rows: DataFrame, key: list[str], order: list[str], budget: int) -> DataFrame:
    """``turn``: in which turn of at most ``budget`` messages a key's row is handled, from 0."""
    return fifo_position(rows, key, order).withColumn("turn", F.floor((F.col("pos") - 1) / budget).cast("long"))


def drop_newest(rows: DataFrame, key: list[str], order: list[str], bound: int) -> DataFrame:
    """Of a burst into a bounded queue, the first ``bound`` rows."""
    return fifo_position(rows, key, order).filter(F.col("pos") <= bound)


def drop_oldest(rows: DataFrame, key: list[str], order: list[str], bound: int) -> DataFrame:
    """Of a burst into a bounded queue, the last ``bound`` rows."""
    w = _w(key, [F.col(c).desc() for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= bound).drop("_r")


def fail_when_full(rows: DataFrame, key: list[str], order: list[str], bound: int) -> DataFrame:
    """``outcome`` of a burst into a bounded queue that neither drops nor waits: senders beyond the bound are told so."""
    full = F.col("pos") > bound
    return fifo_position(rows, key, order).withColumn("outcome", F.when(full, "overflow").otherwise("queued")).drop("pos")


def cancelled(queue: DataFrame, cancels: DataFrame, key: list[str]) -> DataFrame:
    """Messages that a cancel has taken out: it names the message's generation and comes before the message is claimed.
    queue: key, generation, claimed_at; cancels: key, generation, cancel_at."""
    first = cancels.groupBy(*key, "generation").agg(F.min("cancel_at").alias("_at"))
    return queue.join(first, [*key, "generation"]).filter(F.col("_at") < F.col("claimed_at")).drop("_at")


def persisted(rows: DataFrame, key: list[str], order: list[str], batch: int = 1) -> DataFrame:
    """``durable_at`` is the row whose handling makes a row durable: itself (``batch`` 1, before its reply is sent), or the
    last one of its batch, so that a crash loses at most the batch that is open. Rows of an open batch have none."""
    rows = fifo_position(rows, key, order).withColumn("_b", F.floor((F.col("pos") - 1) / batch))
    w = Window.partitionBy(*key, "_b")
    return rows.withColumn("durable_at", F.when(F.count("*").over(w) == batch, F.max("pos").over(w))).drop("_b")


def torn_tail(rows: DataFrame, key: list[str], order: list[str], good: Column) -> DataFrame:
    """Rows of a write-ahead log before its first bad frame."""
    w = _w(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_ok", F.min(good.cast("int")).over(w)).filter(F.col("_ok") == 1).drop("_ok")


def commit_batch(messages: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The records that handling each message commits, in one run of seqs for each key: its event, the watermark, an
    outbound record for each of ``outbound``, and the reply if it has one."""
    kinds = F.array_compact(
        F.concat(
            F.array(F.lit("event"), F.lit("watermark")),
            F.transform(F.sequence(F.lit(1), F.greatest(F.col("outbound"), F.lit(1))), lambda i: F.when(i <= F.col("outbound"), F.lit("outbox"))),
            F.array(F.when(F.col("replies"), F.lit("reply"))),
        )
    )
    rows = messages.select(*key, *order, F.posexplode(kinds).alias("place", "record"))
    seq = F.row_number().over(_w(key, [*order, "place"])).cast("long")
    return rows.withColumn("log_seq", seq).withColumn("place", F.col("place").cast("long"))


def outbound_ids(rows: DataFrame, seq: str, index: str) -> DataFrame:
    """``out_seq`` of the index-th message that handling message seq sends: room for 2^20 of them."""
    return rows.withColumn("out_seq", F.col(seq) * (1 << 20) + F.col(index) + 1)


def recover(records: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """State from a log of typed records: the watermark is the largest, the outbox all, the reply the last, and every
    other record is a domain event."""
    at = F.struct(*order)
    of = lambda kind: F.col("record") == kind
    return records.groupBy(*key).agg(
        F.max(F.when(of("watermark"), F.col("seq"))).alias("watermark"),
        F.count(F.when(of("outbox"), 1)).alias("outbox"),
        F.max_by("seq", F.when(of("reply"), at)).alias("reply_seq"),
        F.count(F.when(~F.col("record").isin("watermark", "outbox", "reply"), 1)).alias("events"),
    )
