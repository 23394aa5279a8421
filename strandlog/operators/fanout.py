"""Publishing to subscribers: pairings, receipts of bounded inboxes, evictions, propagation of context.

Pairs of a message with its subscribers are an equi-join on the topic, never a product of two logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions.scalars import earlier
from strandlog.operators.logs import placed


def subscribe(requests: DataFrame, topic: str = "topic", subscriber: str = "subscriber", order: str = "at_us") -> DataFrame:
    """``fresh``: the first subscription of each subscriber to each topic; later ones are no-ops."""
    first = F.row_number().over(Window.partitionBy(topic, subscriber).orderBy(order))
    return requests.withColumn("fresh", first == 1)


def publish(messages: DataFrame, subscribers: DataFrame, topic: str = "topic") -> DataFrame:
    """Every message once for each current subscriber of its topic."""
    return messages.join(subscribers.dropDuplicates([topic, "subscriber"]), topic)


def reached_during(messages: DataFrame, subscriptions: DataFrame, topic: str = "topic", at: str = "us") -> DataFrame:
    """``reached``: how many are subscribed when a message is published: from ``since`` on and before ``until``, if that
    isn't null. Subscriptions are steps up and down of one running sum, so no message meets a subscription row by row;
    messages that reach nobody are left out."""
    none = F.lit(0).cast("long")
    real = subscriptions.filter("until is null or since < until")
    steps = real.select(
        topic, F.explode(F.array(F.struct(F.col("since").alias("_at"), F.lit(1).cast("long").alias("_step")),
                                 F.struct(F.col("until").alias("_at"), F.lit(-1).cast("long").alias("_step")))).alias("x")
    ).select(topic, "x._at", "x._step").filter("_at is not null")
    steps = steps.groupBy(topic, "_at").agg(F.sum("_step").alias("_step")).withColumn("_message", F.lit(0))
    rows = messages.select("*", F.col(at).alias("_at"), none.alias("_step"), F.lit(1).alias("_message"))
    summed = placed(rows.unionByName(steps, allowMissingColumns=True), [topic], ["_at", "_message"], "reached", F.col("_step"))
    return summed.filter("_message = 1 and reached > 0").select(*messages.columns, "reached")


def inbox_size(capacity: int) -> int:
    """Capacities are rounded up to a power of two."""
    return 1 << max(0, capacity - 1).bit_length()


def bounded_delivery(pairs: DataFrame, lane: list[str], order: list[str], capacity: int) -> DataFrame:
    """``delivered``: of what reaches a lane before it is read, the first as many as it holds."""
    place = F.row_number().over(Window.partitionBy(*lane).orderBy(*order))
    return pairs.withColumn("delivered", place <= inbox_size(capacity))


def receipts(pairs: DataFrame, message: list[str]) -> DataFrame:
    """For each message to how many subscribers it was delivered, and how many inboxes were full."""
    return pairs.groupBy(*message).agg(
        F.count(F.when(F.col("delivered"), 1)).alias("delivered"), F.count(F.when(~F.col("delivered"), 1)).alias("dropped_full")
    )


def evictions(pairs: DataFrame, lane: list[str]) -> DataFrame:
    """For each lane how many messages it kept and how many were evicted."""
    return pairs.groupBy(*lane).agg(
        F.count(F.when(F.col("delivered"), 1)).alias("kept"), F.count(F.when(~F.col("delivered"), 1)).alias("evicted")
    )


def topic_sequence(messages: DataFrame, subscribers: DataFrame, order: list[str], topic: str = "topic") -> DataFrame:
    """``number``: consumed only by messages that had a subscriber. A topic's rows are numbered range by range."""
    heard = messages.join(subscribers.select(topic).distinct(), topic, "left_semi")
    return placed(heard, [topic], order, "number")


def child_context(parent_deadline: Column, own_deadline: Column, parent_trace: Column) -> dict[str, Column]:
    """A child send keeps the trace and takes the earlier deadline."""
    return {"deadline_us": earlier(parent_deadline, own_deadline), "trace_id": parent_trace}
