"""The keyed log: rows of an append-only table, ordered within their key and unordered across keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of an envelope around a message; all optional but actor and seq.
ENVELOPE = "actor long, seq long, us long, kind string, amount long, deadline_us long, trace_id long, priority int"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> F.Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """actor, seq, us, kind, amount (hundredths, rounded down) from the table ``events``."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("actor"),
        F.col("event_id").alias("seq"),
        micros("ts").alias("us"),
        F.col("event_type").alias("kind"),
        F.floor(F.col("value") * 100).cast("long").alias("amount"),
    )


#: The same in DuckDB, as the first common table expression of a query.
LOG_SQL = (
    "log AS (SELECT user_id AS actor, event_id AS seq, epoch_us(ts) AS us, event_type AS kind, "
    "CAST(floor(value * 100) AS BIGINT) AS amount FROM events)"
)
DAY = 86_400_000_000


def delivered(log: DataFrame, every: int = 7) -> DataFrame:
    """A disordered log: each ``every``-th message is delivered again a day later, and each eleventh a day late.

    Delivery order is (arrived, seq, copy)."""
    first = log.withColumn("arrived", F.col("us") + F.when(F.col("seq") % 11 == 0, F.lit(DAY)).otherwise(0))
    again = log.filter(F.col("seq") % every == 0).withColumn("arrived", F.col("us") + DAY)
    return first.withColumn("copy", F.lit(0).cast("long")).unionByName(again.withColumn("copy", F.lit(1).cast("long")))


DELIVERED_SQL = (
    f"{LOG_SQL}, delivered AS (SELECT *, us + CASE WHEN seq % 11 = 0 THEN {DAY} ELSE 0 END AS arrived, 0::BIGINT AS copy "
    f"FROM log UNION ALL SELECT *, us + {DAY} AS arrived, 1::BIGINT AS copy FROM log WHERE seq % 7 = 0)"
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where that is unset, a new temporary
    one is set, but only if the session runs on this machine alone; elsewhere executors wouldn't see it, so this raises."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            found = known.get()
        elif re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            found = Path(tempfile.mkdtemp(prefix="strandlog-")).as_uri()
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write a table to the shared folder and read it back: later jobs neither recompute it nor depend on one executor's
    disk, and which rows lie in which partition stays fixed from here on."""
    path = work_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
