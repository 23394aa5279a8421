"""Mergeable metrics: counters and histograms as partial aggregates that add up, their text exposition, skew measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shard_counters(rows: DataFrame, shard: Column, by: list[str], **counters: Column) -> DataFrame:
    """Counters of each shard, and then their sums: the two levels of aggregation on read."""
    per_shard = rows.groupBy(shard.alias("_shard"), *by).agg(*[F.sum(c).alias(n) for n, c in counters.items()])
    return per_shard.groupBy(*by).agg(*[F.sum(n).alias(n) for n in counters])


def histogram(rows: DataFrame, by: list[str], bucket: Column, value: str) -> DataFrame:
    """Partial histogram: for each bucket its count, sum, least and greatest value."""
    return rows.groupBy(*by, bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def merge(histograms: DataFrame, by: list[str]) -> DataFrame:
    """Histograms of many shards as one."""
    return histograms.groupBy(*by, "bucket").agg(
        F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max")
    )


def totals(histograms: DataFrame, by: list[str]) -> DataFrame:
    return histograms.groupBy(*by).agg(
        F.sum("n").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max")
    )


def cumulative(histograms: DataFrame, by: list[str]) -> DataFrame:
    """``le`` and how many values are at most that, for buckets that aren't empty."""
    w = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    le = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bucket").cast("int")) - 1
    return histograms.filter("n > 0").select(*by, "bucket", le.alias("le"), F.sum("n").over(w).alias("cumulative"))


def exposition(counters: DataFrame, name: str = "name", value: str = "value", prefix: str = "strandlog") -> DataFrame:
    """One text per counter in the exposition format for scraping."""
    full = F.concat(F.lit(prefix + "_"), F.col(name))
    text = F.concat(F.lit("# TYPE "), full, F.lit(" counter\n"), full, F.lit(" "), F.col(value).cast("string"), F.lit("\n"))
    return counters.select(F.col(name), text.alias("text"))


def histogram_exposition(histograms: DataFrame, by: str, prefix: str = "strandlog") -> DataFrame:
    """One text per histogram: its cumulative buckets in order, then sum and count. A histogram has at most 64 buckets."""
    full = F.concat(F.lit(prefix + "_"), F.col(by))
    line = F.concat(full, F.lit('_bucket{le="'), F.col("le").cast("string"), F.lit('"} '), F.col("cumulative").cast("string"))
    lines = cumulative(histograms, [by]).groupBy(by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines")
    )
    found = lines.join(totals(histograms, [by]), by)
    return found.select(
        by,
        F.concat(
            F.lit("# TYPE "), full, F.lit(" histogram\n"), F.col("lines"), F.lit("\n"), full, F.lit("_sum "),
            F.col("sum").cast("string"), F.lit("\n"), full, F.lit("_count "), F.col("count").cast("string"), F.lit("\n"),
        ).alias("text"),
    )


def bounded_instances(rows: DataFrame, by: list[str], instance: str, order: list[str], cap: int) -> DataFrame:
    """``slot``: the first ``cap`` instances of each type keep their own series, all others share ``other``."""
    first = rows.groupBy(*by, instance).agg(F.min(F.struct(*order)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_first", instance))
    placed = first.withColumn("_r", rank)
    slot = F.when(F.col("_r") <= cap, F.col(instance).cast("string")).otherwise("other")
    return rows.join(placed.select(*by, instance, slot.alias("slot")), [*by, instance])


def slot_use(rows: DataFrame, by: list[str], instance: str) -> DataFrame:
    """Of rows with their ``slot``: slots taken, instances that found none, and the rows of those."""
    other = F.col("slot") == "other"
    each = rows.groupBy(*by, instance, other.alias("_other")).agg(F.count("*").alias("_n"))
    return each.groupBy(*by).agg(
        F.count(F.when(~F.col("_other"), 1)).alias("slots"),
        F.count(F.when(F.col("_other"), 1)).alias("exhausted"),
        F.coalesce(F.sum(F.when(F.col("_other"), F.col("_n"))), F.lit(0).cast("long")).alias("other"),
    )


def skew(rows: DataFrame, owner: str, owners: DataFrame) -> DataFrame:
    """Spread of rows over all owners, those without rows included: how many are idle, largest over mean, and the
    coefficient of variation, each rounded to six places."""
    loads = owners.select(owner).join(rows.groupBy(owner).agg(F.count("*").alias("n")), owner, "left")
    n = F.coalesce("n", F.lit(0))
    return loads.agg(
        F.count("*").alias("owners"),
        F.sum((n == 0).cast("long")).alias("idle"),
        F.round(F.max(n) / F.avg(n), 6).alias("max_over_mean"),
        F.round(F.stddev_pop(n) / F.avg(n), 6).alias("cov"),
    )


def reconcile(sent: DataFrame, received: DataFrame, lost: DataFrame, key: list[str]) -> DataFrame:
    """Conservation: what each key sent, what arrived, what is accounted as lost, and whether that adds up."""
    zero = F.lit(0).cast("long")
    count = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    out = count(sent, "sent").join(count(received, "received"), key, "full").join(count(lost, "lost"), key, "full")
    out = out.select(*key, *[F.coalesce(c, zero).alias(c) for c in ("sent", "received", "lost")])
    return out.withColumn("whole", F.col("sent") == F.col("received") + F.col("lost"))


def last_writer(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The greatest row of each key by ``order``, compared field by field."""
    fields = [c for c in rows.columns if c not in key and c not in order]
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, *fields)).alias("_m"))
    return best.select(*key, *[F.col(f"_m.{c}").alias(c) for c in [*order, *fields]])
