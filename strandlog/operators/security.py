"""Rights, rules, revocation, quarantine, and records sealed at rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.model import cut


def dominates(rights: Column, required: Column) -> Column:
    """All required bits are among the rights."""
    return required.bitwiseAND(F.bitwise_not(rights)) == 0


def attenuate(inbound: Column, requested: Column) -> Column:
    return inbound.bitwiseAND(requested)


def amplifies(inbound: Column, requested: Column) -> Column:
    return requested.bitwiseAND(F.bitwise_not(inbound)) != 0


def authorise(messages: DataFrame, rules: DataFrame, on: list[str], default_open: bool = False) -> DataFrame:
    """``allowed``: the principal's rights hold all that the rule requires; without a rule the default decides."""
    rows = messages.join(rules, on, "left")
    return rows.withColumn("allowed", F.when(F.col("required").isNull(), F.lit(default_open)).otherwise(dominates(F.col("rights"), F.col("required"))))


def deny_audit(rows: DataFrame, by: list[str]) -> DataFrame:
    """Denied messages by reason."""
    return rows.filter(~F.col("allowed")).groupBy(*by).agg(F.count("*").alias("denied"))


def audit(rows: DataFrame, kind: int, code: Column, subject: str, detail: Column, at: str = "us") -> DataFrame:
    """Audit records of the rows: kind, code, subject (never a secret), detail, and when."""
    number = F.lit(kind).cast("long")
    return rows.select(number.alias("kind"), code.cast("long").alias("code"), F.col(subject).alias("subject"), detail.alias("detail"), F.col(at).alias("us"))


def live(rows: DataFrame, revoked: DataFrame, key: str) -> DataFrame:
    return rows.join(revoked.select(key).distinct(), key, "left_anti")


def admitted(rows: DataFrame, allowlist: DataFrame, key: str) -> DataFrame:
    return rows.join(allowlist.select(key).distinct(), key, "left_semi")


def route_faults(rows: DataFrame, key: list[str], order: list[str], fault: Column, stops: bool) -> DataFrame:
    """``route``: faulting rows go to dead letters. If a fault stops the key, all its later rows do, too."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_f", fault.cast("int"))
    stopped = F.coalesce(F.max("_f").over(w), F.lit(0)) == 1 if stops else F.lit(False)
    route = F.when(stopped, "supervised_stop").when(F.col("_f") == 1, "dead_letter").otherwise("handled")
    return rows.withColumn("route", route).drop("_f")


def seal(rows: DataFrame, key: bytes, body: Column, nonce: Column, bound_to: Column) -> DataFrame:
    """``sealed``: authenticated encryption of the body, bound to fence and seq; the nonce has 12 bytes and never recurs."""
    return rows.withColumn("sealed", F.aes_encrypt(body, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), nonce, bound_to))


def unseal(rows: DataFrame, key: bytes, bound_to: Column) -> DataFrame:
    """``body``: null where the record was changed or belongs elsewhere."""
    return rows.withColumn("body", F.try_aes_decrypt(F.col("sealed"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), bound_to).cast("string"))


def span_depths(spans: DataFrame) -> DataFrame:
    """``depth`` of each span below its root, however deep. Each round doubles how far a span looks up, so there are as many
    joins as the greatest depth has bits. Spans whose line ends at no root (a missing parent, or a ring) have no depth and
    are left out."""
    known = spans.filter(F.col("parent").isNull()).select("span", F.lit(0).cast("long").alias("depth"))
    open_ = spans.filter(F.col("parent").isNotNull()).select("span", F.col("parent").alias("up"), F.lit(1).cast("long").alias("by"))
    state = cut(known.withColumns({"up": F.lit(None).cast(open_.schema["up"].dataType), "by": F.lit(0).cast("long")}).unionByName(open_, True), "spans")
    left = state.filter("depth is null").count()
    while left:
        above = state.select(F.col("span").alias("up"), F.col("up").alias("up2"), F.col("by").alias("by2"), F.col("depth").alias("d2"))
        met = state.filter("depth is null").join(above, "up")  # a missing parent drops out
        now = met.select(
            "span", (F.col("by") + F.col("d2")).alias("depth"), F.when(F.col("d2").isNull(), F.col("up2")).alias("up"),
            (F.col("by") + F.when(F.col("d2").isNull(), F.col("by2")).otherwise(0)).alias("by"),
        )
        state = cut(state.filter("depth is not null").unionByName(now), "spans")
        before, left = left, state.filter("depth is null").count()
        if left == before:  # every round settles some of a line that has a root, so what is left are rings
            break
    return state.filter("depth is not null").select("span", "depth")
