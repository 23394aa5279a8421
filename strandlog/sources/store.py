"""Durable logs as Parquet tables: events with fences, snapshots, reminders.

A store's folder has ``events``, ``snapshots``, ``fences`` and ``reminders``, each append-only; what holds is the last
valid row of a key. One writer appends to a store at a time, and a fence keeps out a writer that lost its turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators import logs

EVENTS = "actor long, seq long, token long, record string, amount long"
SNAPSHOTS = "actor long, at long, token long, through_seq long, balance long, applied long"
FENCES = "actor long, token long"
REMINDERS = "actor long, name string, arrival long, due_us long, period_us long, removed boolean"


class Fenced(ValueError):
    """A newer owner has taken the actor."""


class LogStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if files.exists(path) else self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: DataFrame, schema: str) -> None:
        names = [c.strip().split()[0] for c in schema.split(",")]
        rows.select(*names).write.mode("append").parquet(f"{self.folder}/{name}")

    def events(self, start: int = 0) -> DataFrame:
        """Events with seq >= start."""
        return logs.scan_from(self._read("events", EVENTS), start)

    def owners(self) -> DataFrame:
        return self._read("fences", FENCES).groupBy("actor").agg(F.max("token").alias("owner"))

    def acquire(self, actors: DataFrame) -> DataFrame:
        """A new owner's token for each actor: one more than the last."""
        given = actors.select("actor").distinct().join(self.owners(), "actor", "left")
        given = given.select("actor", (F.coalesce("owner", F.lit(0)) + 1).cast("long").alias("token"))
        self._append("fences", given, FENCES)
        return self.owners().join(actors.select("actor").distinct(), "actor", "left_semi").withColumnRenamed("owner", "token")

    def append(self, batch: DataFrame) -> None:
        """All of a batch or nothing: raises if any actor is fenced off or any seq doesn't increase beyond what is there.
        batch: columns of ``events``, and ``pos``, each row's place in the batch."""
        last = self.events().groupBy("actor").agg(F.max("seq").alias("last"))
        rows = batch.withColumn("_up", F.coalesce(F.col("seq") > F.lag("seq").over(logs._w(["actor"], ["pos"])), F.lit(True)))
        whole = rows.groupBy("actor").agg(F.bool_and("_up").alias("up"), F.min_by("seq", "pos").alias("first"), F.min("token").alias("tok"))
        facts = whole.join(last, "actor", "left").join(self.owners(), "actor", "left")
        found = facts.agg(
            F.max((F.col("tok") < F.coalesce("owner", F.lit(0))).cast("int")).alias("fenced"),
            F.max((~F.col("up") | (F.col("first") <= F.coalesce("last", F.lit(-1)))).cast("int")).alias("disordered"),
        ).head()
        if found["fenced"]:
            raise Fenced("a newer token owns an actor of this batch")
        if found["disordered"]:
            raise ValueError("seqs must increase strictly")
        self._append("events", batch, EVENTS)

    def save_snapshots(self, snapshots: DataFrame) -> None:
        """Keeps those whose token still holds and that claim no more than the log has."""
        last = self.events().groupBy("actor").agg(F.max("seq").alias("last"))
        rows = snapshots.join(last, "actor").join(self.owners(), "actor", "left")
        good = rows.filter((F.col("through_seq") <= F.col("last")) & (F.col("token") >= F.coalesce("owner", F.lit(0))))
        self._append("snapshots", good, SNAPSHOTS)

    def snapshots(self) -> DataFrame:
        rows = self._read("snapshots", SNAPSHOTS)
        return logs.latest_snapshot(rows, ["actor"], ["at"], F.col("through_seq")).select("actor", "through_seq", "balance", "applied")

    def recover(self) -> DataFrame:
        """Every actor's state: its snapshot and the events after it."""
        return logs.snapshot_and_tail(self.snapshots(), self.events(), ["actor"])

    def put_reminders(self, rows: DataFrame) -> None:
        self._append("reminders", rows, REMINDERS)

    def reminders(self) -> DataFrame:
        return logs.upsert_latest(self._read("reminders", REMINDERS), ["actor", "name"], ["arrival"])

    def compact_reminders(self, into: "LogStore") -> None:
        """Writes the live rows alone to another store."""
        into.put_reminders(self.reminders().withColumn("removed", F.lit(False)))
