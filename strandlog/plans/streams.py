"""Folds and windows as streams: each query runs its stream to the end of what is there and returns what the sink holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.model import DAY, LOG_SQL, event_log, micros, read, work_folder
from strandlog.operators import governance as g
from strandlog.operators.schedule import periodic_timer
from strandlog.plans.governance import ORACLES as _GOVERNANCE
from strandlog.plans.governance import fold_sql
from strandlog.streaming import dedup_stream, fold_stream, windowed_counts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEY, ORDER = ["actor"], ["us", "seq"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Slices of a log that arrive one after another.
SLICES = 3


def _run(rows: DataFrame, arrival: str, make: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What ``make`` makes of the rows as a stream. They arrive in slices of equal time by ``arrival``; after each one the
    stream is started anew from its checkpoint and runs to the end of what is there, so state, offsets and watermark go
    through as many restarts. A file sink's commits make each batch count once."""
    spark, folder = rows.sparkSession, work_folder(rows.sparkSession, name)
    first, last = rows.agg(F.min(arrival), F.max(arrival)).head()
    limits = [] if first is None else [first + (last - first) * k // SLICES for k in range(1, SLICES)]
    numbered = rows.withColumn("slice", sum((F.col(arrival) > limit).cast("int") for limit in limits) if limits else F.lit(0))
    numbered.write.partitionBy("slice").parquet(f"{folder}/arrived")
    stream, schema = None, rows.schema
    for k in range(SLICES):
        part = spark.read.parquet(f"{folder}/arrived").filter(F.col("slice") == k) if limits else rows
        part.select(*rows.columns).write.mode("append").parquet(f"{folder}/log")
        stream = make(spark.readStream.schema(schema).parquet(f"{folder}/log"))
        writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
        writer.trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query(_GOVERNANCE["ref_token_bucket"])
def ref_stream_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(event_log(spark, sf_dir), "us", lambda log: fold_stream(log, KEY, ORDER, g.token_bucket(5.0, 2e-5)), "bucket")


@query(_GOVERNANCE["ref_circuit_breaker"])
def ref_stream_circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).withColumn("failed", F.col("kind").isin("error", "click"))
    return _run(rows, "us", lambda log: fold_stream(log, KEY, ORDER, g.circuit_breaker(3, 2 * DAY)), "breaker")


_LATE = f"us + CASE WHEN seq % 11 = 0 THEN {DAY} ELSE 0 END"


@query(f"""WITH {LOG_SQL}, l AS (SELECT actor, seq, {_LATE} AS arrived FROM log UNION ALL SELECT actor, seq, us + {2 * DAY} FROM log WHERE seq % 7 = 0),
m AS (SELECT *, max(seq) OVER (PARTITION BY actor ORDER BY arrived, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM l)
SELECT actor, seq FROM m WHERE high IS NULL OR seq > high""")
def ref_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late and repeated deliveries through the stream's high-water marks."""
    again = F.when(F.col("seq") % 7 == 0, F.array(F.expr(_LATE), F.col("us") + 2 * DAY)).otherwise(F.array(F.expr(_LATE)))
    rows = event_log(spark, sf_dir).withColumn("arrived", F.explode(again))
    return _run(rows, "arrived", lambda log: dedup_stream(log, KEY, ["arrived", "seq"]), "dedup")


@query(
    fold_sql(
        "SELECT * FROM log", "NULL::BIGINT AS due, 0::BIGINT AS fired",
        f"CASE WHEN f.due IS NULL OR b.us < f.due THEN 0 ELSE (b.us - f.due) // {DAY // 2} + 1 END AS k, f.due AS d0",
        f"CASE WHEN kind = 'purchase' THEN us + {DAY // 2} WHEN kind = 'error' THEN NULL ELSE d0 + k * {DAY // 2} END, k",
        "actor, seq, fired",
    )
)
def ref_state_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A periodic timer in each actor's state, armed anew by a purchase and cancelled by an error; a row first fires what has
    come due before it."""
    return _run(event_log(spark, sf_dir), "us", lambda log: fold_stream(log, KEY, ORDER, periodic_timer("kind", "purchase", "error", DAY // 2)), "timers")


#: Deliveries of the log: each eleventh event comes nine days late.
_ARRIVALS = f"arrivals AS (SELECT event_type, ts, epoch_us(ts) AS us, epoch_us(ts) + CASE WHEN event_id % 11 = 0 THEN {9 * DAY} ELSE 0 END AS arrived FROM events)"


@query(f"""WITH {_ARRIVALS}, limits AS (SELECT list_transform(range(1, {SLICES}), lambda k: min(arrived) + (max(arrived) - min(arrived)) * k // {SLICES}) AS q FROM arrivals),
s AS (SELECT *, (arrived > q[1])::INT + (arrived > q[2])::INT AS slice, us // {DAY // 4} * {DAY // 4} AS start FROM arrivals, limits),
marks AS (SELECT slice, coalesce(max(max(us)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1000 * 1000 - {DAY} AS mark, max(max(us)) OVER () // 1000 * 1000 - {DAY} AS last FROM s GROUP BY slice)
SELECT event_type, start, count(*) AS n FROM s JOIN marks USING (slice) WHERE start + {DAY // 4} > mark AND start + {DAY // 4} <= last GROUP BY event_type, start""")
def platform_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each window and kind, in append mode: a window is given once the watermark, a day behind the latest event,
    has passed its end; rows that come for it afterwards are dropped, and windows that are still open at the end are kept
    back."""
    late = F.when(F.col("event_id") % 11 == 0, F.lit(9 * DAY)).otherwise(0)
    rows = read(spark, sf_dir, "events").select("event_type", "ts", (micros("ts") + late).alias("arrived"))
    counts = _run(rows, "arrived", lambda events: windowed_counts(events, "ts", "event_type", "6 hours", "1 day"), "windows")
    return counts.select("event_type", micros("cast(w.start as timestamp_ntz)").alias("start"), "n")
