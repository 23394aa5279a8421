"""The same folds over streams.

``fold_stream`` keeps each key's state between micro-batches and gives, over any cut of a log into batches, the rows
that ``operators.fold.ordered_fold`` gives over the whole log, as long as batches follow the log's order."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandlog.operators.fold import KeyedFold


def fold_stream(stream: DataFrame, key: list[str], order: list[str], fold: KeyedFold, idle_ms: int | None = None) -> DataFrame:
    """What the fold's steps emit, as rows arrive. With ``idle_ms`` a key's state goes once nothing has come for so long
    (by the processing clock), after its ``finish``.

    Rows of one key in one micro-batch are put in order in memory, as a stream can't be sorted before it; so the source
    has to bound a micro-batch (``maxFilesPerTrigger``, ``maxBytesPerTrigger``). Between batches only the state is kept."""
    if fold.reads is not None:
        stream = stream.select(*dict.fromkeys([*key, *order, *fold.reads]))
    keys = [stream.schema[k] for k in key]
    schema = T.StructType([*keys, *fold.emits.fields])
    names = schema.fieldNames()

    def run(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        head = dict(zip(key, own, strict=True))
        if state.hasTimedOut:
            end = fold.finish(pickle.loads(state.get[0])) if fold.finish else None
            state.remove()
            if end is not None:
                yield pd.DataFrame([head | end], columns=names)
            return
        current = pickle.loads(state.get[0]) if state.exists else fold.zero()
        # a key's rows of one micro-batch are put in order before its state moves on
        rows = [r for f in frames for r in f.astype(object).where(f.notna(), None).to_dict("records")]
        out = []
        for row in sorted(rows, key=lambda r: tuple(r[c] for c in order)):
            current, emitted = fold.step(current, row)
            if emitted is not None:
                out.append(head | emitted)
        state.update((pickle.dumps(current),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy(*[F.col(k) for k in key]).applyInPandasWithState(
        run, schema, T.StructType([T.StructField("state", T.BinaryType())]), "append", timeout
    )


def windowed_counts(stream: DataFrame, at: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by key and event-time window; rows later than the watermark are dropped."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n"))


def dedup_stream(stream: DataFrame, key: list[str], order: list[str], seq: str = "seq") -> DataFrame:
    """Rows whose seq exceeds all before it in their key. The marks are kept for good, as in a log."""

    def step(high: int | None, row: dict) -> tuple:
        fresh = high is None or row[seq] > high
        return (row[seq] if fresh else high), ({seq: row[seq]} if fresh else None)

    return fold_stream(stream, key, order, KeyedFold(lambda: None, step, f"{seq} long"))
