"""Schema evolution: missing fields take defaults, old versions are lifted step by step, foreign records are set aside."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Upcast = Callable[[DataFrame], DataFrame]


def with_defaults(rows: DataFrame, schema: dict[str, tuple[str, object]]) -> DataFrame:
    """Columns of ``schema`` (name: type and default): unknown ones go, absent and null ones take the default."""
    return rows.select(
        *[
            F.coalesce(F.col(n).cast(t), F.lit(d).cast(t)).alias(n) if n in rows.columns else F.lit(d).cast(t).alias(n)
            for n, (t, d) in schema.items()
        ]
    )


class Chain:
    """Versions of a record type: ``lift[v]`` takes rows of version v to v + 1; the last is current."""

    def __init__(self, lift: dict[int, Upcast]):
        if sorted(lift) != list(range(1, len(lift) + 1)):
            raise ValueError("versions must follow each other from 1")
        self.lift, self.current = lift, len(lift) + 1

    def read(self, versions: dict[int, DataFrame]) -> DataFrame:
        """All rows in the current version."""
        if unknown := [v for v in versions if not 1 <= v <= self.current]:
            raise ValueError(f"unknown versions {unknown}")
        lifted = [reduce(lambda d, k: self.lift[k](d), range(v, self.current), df) for v, df in versions.items()]
        return reduce(lambda a, b: a.unionByName(b), lifted)


def screen(records: DataFrame, type_key: int, newest: int) -> DataFrame:
    """``problem``: another type's record, or a version that isn't known; null for good ones."""
    return records.withColumn(
        "problem",
        F.when(F.col("type_key") != type_key, "type_mismatch").when(~F.col("version").between(1, newest), "unknown_version"),
    )


def negotiate(fingerprint: Column, abi: Column, own_fingerprint: Column, own_abi: Column) -> Column:
    """The packed encoding only between equal types on equal machines."""
    return F.when((fingerprint == own_fingerprint) & (abi == own_abi), "tagless").otherwise("tagged")
