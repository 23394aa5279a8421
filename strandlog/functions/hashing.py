"""Unsigned 64-bit hashing on signed columns.

Products wrap modulo 2^64. Spark decides between wrapping and raising when a plan is analysed, so columns are added
through ``wrapped``, which switches ANSI mode off for just that step. Unsigned order is signed order after flipping the
sign bit (``unsigned``)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# These must be the same on every system that computes the hashes.
GOLDEN = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x00000100000001B3
FINGERPRINT_OFFSET = 1469598103934665603
BIN_SALT = 0xD1B54A32D192ED03

_ALL = (1 << 64) - 1


def signed(x: int) -> int:
    x &= _ALL
    return x - (1 << 64) if x >> 63 else x


def _lit(x: int) -> Column:
    return F.lit(signed(x)).cast("long")


def wrapped(df: DataFrame, **columns: Callable[[], Column] | Column) -> DataFrame:
    """``df`` with columns whose arithmetic wraps; each comes from a Column or a function that makes it."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.ansi.enabled")
    conf.set("spark.sql.ansi.enabled", "false")
    try:
        out = df.withColumns({k: c() if callable(c) and not isinstance(c, Column) else c for k, c in columns.items()})
        _ = out.schema
        return out
    finally:
        conf.set("spark.sql.ansi.enabled", before)


def splitmix64(x: Column) -> Column:
    x = x.cast("long") + _lit(GOLDEN)
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 30)) * _lit(MIX_1)
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 27)) * _lit(MIX_2)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 31))


def hash_combine(a: Column, b: Column) -> Column:
    a, b = a.cast("long"), b.cast("long")
    return splitmix64(a.bitwiseXOR(b + _lit(GOLDEN) + F.shiftleft(a, 6) + F.shiftrightunsigned(a, 2)))


def actor_hash(kind: Column | int, key: Column) -> Column:
    return hash_combine(F.lit(kind).cast("long") if isinstance(kind, int) else kind, key)


def unsigned(x: Column) -> Column:
    """A signed column that sorts as ``x`` does unsigned."""
    return x.bitwiseXOR(_lit(1 << 63))


def top_bits(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, 64 - n)


def py_splitmix64(x: int) -> int:
    x = (x + GOLDEN) & _ALL
    x = ((x ^ x >> 30) * MIX_1) & _ALL
    x = ((x ^ x >> 27) * MIX_2) & _ALL
    return x ^ x >> 31


def py_hash_combine(a: int, b: int) -> int:
    return py_splitmix64(a ^ ((b + GOLDEN + (a << 6) + (a >> 2)) & _ALL) & _ALL)


def py_fnv1a(data: bytes, offset: int = FNV_OFFSET) -> int:
    for byte in data:
        offset = ((offset ^ byte) * FNV_PRIME) & _ALL
    return offset


@F.pandas_udf(T.LongType())
def fnv1a(text: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 of a text, as a signed number. Bytes depend on each other, so no built-in expresses it."""
    return text.map(lambda t: None if t is None else signed(py_fnv1a(t.encode()))).astype("Int64")


#: Wire types of a schema's fields, as a fingerprint folds them.
WIRE_TYPES = {"varint": 0, "fixed64": 1, "bytes": 2, "fixed32": 5}


def fingerprint(fields: list[tuple[int, str]]) -> int:
    """Fingerprint of (tag, wire type) pairs; names do not enter."""
    h = FINGERPRINT_OFFSET
    for tag, wire in fields:
        h = py_fnv1a(tag.to_bytes(4, "little") + bytes([WIRE_TYPES[wire]]), h)
    return h


def sql_splitmix64(source: str, column: str, out: str, tag: str) -> str:
    """Common table expressions for DuckDB that add ``out``, the hash of a UBIGINT column, to ``source``; the last is
    named ``tag``. DuckDB raises on overflow, so products are taken in two halves modulo 2^64."""

    def times(x: str, c: int) -> str:
        hi, lo = c >> 32, c & 0xFFFFFFFF
        return (
            f"(({x}::HUGEINT * {lo} + (({x}::HUGEINT * {hi}) % 4294967296) * 4294967296) % 18446744073709551616)::UBIGINT"
        )

    return ", ".join(
        (
            f"{tag}_a AS (SELECT *, (({column}::HUGEINT + {GOLDEN}) % 18446744073709551616)::UBIGINT AS {tag}_0 FROM {source})",
            f"{tag}_b AS (SELECT *, xor({tag}_0, {tag}_0 >> 30) AS {tag}_1 FROM {tag}_a)",
            f"{tag}_c AS (SELECT *, {times(f'{tag}_1', MIX_1)} AS {tag}_2 FROM {tag}_b)",
            f"{tag}_d AS (SELECT *, xor({tag}_2, {tag}_2 >> 27) AS {tag}_3 FROM {tag}_c)",
            f"{tag}_e AS (SELECT *, {times(f'{tag}_3', MIX_2)} AS {tag}_4 FROM {tag}_d)",
            f"{tag} AS (SELECT * EXCLUDE ({tag}_0, {tag}_1, {tag}_2, {tag}_3, {tag}_4), "
            f"xor({tag}_4, {tag}_4 >> 31) AS {out} FROM {tag}_e)",
        )
    )


def sql_hash_combine(source: str, a: str, b: str, out: str, tag: str) -> str:
    mixed = (
        f"{tag}_p AS (SELECT *, xor(({a})::UBIGINT, ((({b})::HUGEINT + {GOLDEN} + (({a})::HUGEINT * 64) % 18446744073709551616 "
        f"+ (({a})::UBIGINT >> 2)::HUGEINT) % 18446744073709551616)::UBIGINT) AS {tag}_x FROM {source})"
    )
    return mixed + ", " + sql_splitmix64(f"{tag}_p", f"{tag}_x", out, tag)
