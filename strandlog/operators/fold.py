"""Folds over each key's rows in order.

``ordered_fold`` is for state that depends on the order of all earlier rows: keys are hashed to partitions, rows sorted
within them, and a Python step runs down each partition with the state of the current key alone. A key may have any
number of rows, as none are gathered; it can't be split, since the order is the meaning. Where a fold is associative,
use an aggregate or window instead: those split."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Step = Callable[[Any, dict[str, Any]], tuple[Any, "dict[str, Any] | None"]]


class KeyedFold:
    """``zero()`` makes a key's first state, ``step(state, row)`` gives the next one and what the row emits (or None),
    and ``finish(state)``, where there is one, what the key emits at its end (or None). ``reads`` names the columns that
    the step looks at besides key and order, if it is known: only those are sent to Python.

    The same object drives ``ordered_fold`` and ``strandlog.streaming.fold_stream``."""

    def __init__(
        self,
        zero: Callable[[], Any],
        step: Step,
        emits: str,
        finish: Callable[[Any], "dict[str, Any] | None"] | None = None,
        reads: "list[str] | None" = None,
    ):
        if not callable(zero) or not callable(step):
            raise ValueError("zero and step must be functions")
        self.zero, self.step, self.finish, self.reads = zero, step, finish, reads
        self.emits = T.StructType.fromDDL(emits)


def with_lifecycle(
    fold: KeyedFold, ended: Callable[[Any], dict[str, Any]], notes: str, at: str = "us", idle: int | None = None, fault: str | None = None
) -> KeyedFold:
    """The fold with activations: a key that was idle for longer than ``idle`` is passivated, and one whose row has ``fault``
    set is restarted after it. Both make the next state anew by the fold's ``zero``; a passivation calls ``ended`` on the
    old state, whose fields (``notes``, null otherwise) go with the row that woke the key up, as does ``activation``, the
    number of the activation that handles it."""
    extra = [f.name for f in T.StructType.fromDDL(notes).fields]

    def step(state: tuple[Any, int, int | None], row: dict[str, Any]) -> tuple:
        inner, number, last = state
        noted = dict.fromkeys(extra)
        if idle is not None and last is not None and row[at] - last > idle:
            noted, inner, number = ended(inner), fold.zero(), number + 1
        inner, out = fold.step(inner, row)
        out = None if out is None else out | noted | {"activation": number}
        if fault and row[fault]:
            inner, number = fold.zero(), number + 1
        return (inner, number, row[at]), out

    emits = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in fold.emits.fields)}, {notes}, activation long"
    reads = None if fold.reads is None else [*fold.reads, at, *([fault] if fault else [])]
    return KeyedFold(lambda: (fold.zero(), 0, None), step, emits, reads=reads)


def ordered_fold(rows: DataFrame, key: list[str], order: list[str], fold: KeyedFold) -> DataFrame:
    """Key columns followed by what the fold emits, for every row or key that emits."""
    keys = [rows.schema[k] for k in key]
    schema = T.StructType([*keys, *fold.emits.fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, begun = None, None, False
        arrow = None
        for batch in batches:
            out: list[dict[str, Any]] = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in key)
                if not begun or own != current:
                    if begun and fold.finish and (end := fold.finish(state)) is not None:
                        out.append(dict(zip(key, current, strict=True)) | end)
                    current, state, begun = own, fold.zero(), True
                state, emitted = fold.step(state, row)
                if emitted is not None:
                    out.append(dict(zip(key, own, strict=True)) | emitted)
            if arrow is None:
                arrow = arrow_schema(schema)
            if out:
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in out], schema=arrow)
        if begun and fold.finish and (end := fold.finish(state)) is not None:
            yield pa.RecordBatch.from_pylist(
                [{n: (dict(zip(key, current, strict=True)) | end)[n] for n in names}], schema=arrow or arrow_schema(schema)
            )

    if fold.reads is not None:
        rows = rows.select(*dict.fromkeys([*key, *order, *fold.reads]))
    return rows.repartition(*[F.col(k) for k in key]).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
