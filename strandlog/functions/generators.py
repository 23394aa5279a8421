"""Many rows for one request, in the manner of a streamed reply.

``ask_stream`` is for replies that an expression gives. A producer that needs code of its own is a table function like
``ReplyStream``, to be registered with ``spark.udtf`` and joined laterally; it runs row by row in Python."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ask_stream(requests: DataFrame, first: str, count: str, limit: int) -> DataFrame:
    """Each request's columns with each row of its reply stream: ``count`` items from ``first`` on, numbered from 0, and then
    the cause that ends the stream: at most ``limit`` items are sent before it is cancelled."""
    n = F.greatest(F.least(F.col(count), F.lit(limit)), F.lit(0)).cast("long")
    number = F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("producer_seq")
    rows = requests.select("*", n.alias("_n"), number)
    item = F.col("producer_seq") < F.col("_n")
    cause = F.when(F.col(count) <= limit, "closed").otherwise("cancelled")
    return rows.select(
        *requests.columns,
        F.when(item, F.col("producer_seq")).alias("producer_seq"),
        F.when(item, F.col(first) + F.col("producer_seq")).alias("item"),
        F.when(~item, cause).alias("terminal"),
    )


@F.udtf(returnType="producer_seq: bigint, item: bigint, terminal: string")
class ReplyStream:
    """The same stream from a producer written in Python."""

    def eval(self, first: int, count: int, limit: int) -> Iterator[tuple]:
        for i in range(min(count, limit)):
            yield i, first + i, None
        yield None, None, "closed" if count <= limit else "cancelled"
