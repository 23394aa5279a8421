"""Deterministic placement: rendezvous hashing, weights, virtual bins, constraints, neighbour tables and routes.

A membership view is small by its nature; ``view`` reads it with its size checked. Nodes then are literals, so placing a
key is an expression on its row: no row is multiplied and nothing is shuffled. For very many nodes, place the bins once
and look keys up by bin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions import hashing as h
from strandlog.functions.scalars import distance_bucket, xor_distance

MAX_NODES = 4096
TINY = 1e-9


def view(nodes: DataFrame, *columns: str) -> list[tuple]:
    rows = [tuple(r) for r in nodes.select(*columns).limit(MAX_NODES + 1).collect()]
    if len(rows) > MAX_NODES:
        raise ValueError(f"a view of more than {MAX_NODES} nodes: use virtual bins")
    return sorted(rows)


def clamp_weight(weight: Column) -> Column:
    """1 where there is none; a tiny one where it isn't positive."""
    w = F.coalesce(weight.cast("double"), F.lit(1.0))
    return F.when(w > 0, w).otherwise(F.lit(TINY))


def _score(mixed: Column, key_hash: Column) -> Column:
    return h.splitmix64(mixed.bitwiseXOR(key_hash))


#: Up to so many nodes a row's owner is one compiled expression, beyond that a function over an array of the nodes.
UNROLLED = 32


def _winner(key_hash: Column, nodes: list[tuple[int, float]], weighted: bool, but: Column | None = None) -> Column:
    """The node of the greatest score, the higher id on a tie, without the node ``but``; null if none is left."""
    if not nodes:
        return F.lit(None).cast("long")

    def score(n: Column, mixed: Column, weight: Column) -> Column:
        w = _score(mixed, key_hash)
        if weighted:
            unit = (F.shiftrightunsigned(w, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
            return F.struct((weight / -F.log(unit)).alias("s"), n.alias("n"))
        return F.struct(h.unsigned(w).alias("s"), n.alias("n"))

    known = [(F.lit(n).cast("long"), F.lit(h.signed(h.py_splitmix64(n))).cast("long"), F.lit(float(w))) for n, w in nodes]
    if len(nodes) <= UNROLLED:
        each = [score(*x) if but is None else F.when(x[0] != F.coalesce(but, F.lit(0)), score(*x)) for x in known]
        return (F.greatest(*each) if len(each) > 1 else each[0])["n"]
    left = F.array(*[F.struct(n.alias("n"), m.alias("m"), w.alias("w")) for n, m, w in known])
    if but is not None:
        left = F.filter(left, lambda x: x["n"] != F.coalesce(but, F.lit(0)))
    return F.array_max(F.transform(left, lambda x: score(x["n"], x["m"], x["w"])))["n"]


def hrw(key_hash: Column, nodes: list[int]) -> Column:
    """The node of the greatest rendezvous weight, the higher id on a tie; null without nodes. Use in ``hashing.wrapped``."""
    return _winner(key_hash, [(n, 1.0) for n in nodes], False)


def weighted_hrw(key_hash: Column, nodes: list[tuple[int, float]]) -> Column:
    """As ``hrw`` with shares proportional to the nodes' weights."""
    return _winner(key_hash, nodes, True)


def with_hash(rows: DataFrame, key: str, kind: int = 1, out: str = "key_hash") -> DataFrame:
    return h.wrapped(rows, **{out: lambda: h.actor_hash(kind, F.col(key))})


def place(rows: DataFrame, nodes: list[int], key_hash: str = "key_hash", out: str = "owner") -> DataFrame:
    return h.wrapped(rows, **{out: lambda: hrw(F.col(key_hash), nodes)})


def place_weighted(rows: DataFrame, nodes: list[tuple[int, float]], key_hash: str = "key_hash", out: str = "owner") -> DataFrame:
    return h.wrapped(rows, **{out: lambda: weighted_hrw(F.col(key_hash), nodes)})


def bin_count(max_nodes: int) -> int:
    return 1 << (16 * max(1, max_nodes) - 1).bit_length()


def virtual_bins(spark, nodes: list[int], max_nodes: int) -> DataFrame:
    """(bin, owner) for all bins: to be cached or written, and broadcast, as their number is fixed."""
    bins = spark.range(bin_count(max_nodes)).withColumnRenamed("id", "bin")
    salted = F.col("bin").bitwiseXOR(F.lit(h.signed(h.BIN_SALT)).cast("long"))
    return place(h.wrapped(bins, key_hash=lambda: h.splitmix64(salted)), nodes).select("bin", "owner")


def bin_of(rows: DataFrame, bins: int, key_hash: str = "key_hash") -> DataFrame:
    return h.wrapped(rows, bin=lambda: h.splitmix64(F.col(key_hash)).bitwiseAND(F.lit(bins - 1).cast("long")))


def has_flag(flags: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(flags, name), F.lit(False))


def has_label(labels: Column, key: str, value: str) -> Column:
    """A missing label is the empty text."""
    return F.coalesce(labels[key], F.lit("")) == value


def resolve(
    rows: DataFrame,
    nodes: list[dict],
    require: "callable | None" = None,
    prefer: "callable | None" = None,
    affinity: str | None = None,
    anti: str | None = None,
    caller: str | None = None,
    weighted: bool = False,
    key_hash: str = "key_hash",
    explicit: str | None = None,
    custom: "Callable[[Column, list[dict]], Column] | None" = None,
    bins: DataFrame | None = None,
) -> DataFrame:
    """``owner`` and ``error`` by the full policy: hard requirements, then the node of the affinity's hash (kept if
    eligible) and without that of the anti-affinity's, then the caller if it may be local, then preferred nodes if there
    are any, by plain or weighted rendezvous. nodes: dicts with ``node`` and ``weight`` and whatever the predicates read.

    Hash columns name rows' hashes of the actors to be near to or away from. Two strategies take the place of all that:
    ``explicit`` names a column with the target, and ``custom`` makes the owner from the key's hash and the nodes. With
    ``bins`` (of ``virtual_bins``) and without modifiers a key's owner is looked up. ``error`` is ``unavailable`` where there
    are no nodes at all, and ``not_found`` where none may be chosen."""
    missing = F.when(F.col("owner").isNull(), F.lit("not_found" if nodes or explicit or custom else "unavailable"))
    if explicit:
        return rows.withColumn("owner", F.col(explicit).cast("long")).withColumn("error", missing)
    if custom:
        return h.wrapped(rows, owner=lambda: custom(F.col(key_hash), nodes).cast("long")).withColumn("error", missing)
    if bins is not None and not (require or prefer or affinity or anti or caller or weighted):
        found = bin_of(rows, bins.count(), key_hash).join(bins.select("bin", "owner"), "bin", "left") if nodes else rows.withColumn("owner", F.lit(None).cast("long"))
        return found.drop("bin").withColumn("error", missing)
    eligible = [n for n in nodes if require is None or require(n)]
    every = [n["node"] for n in nodes]
    out = rows
    for name, column in (("_near", affinity), ("_far", anti)):
        if column:
            out = place(out, every, column, name)
    ids = [n["node"] for n in eligible]
    preferred = [n for n in eligible if prefer is not None and prefer(n)]

    def winner(candidates: list[dict]) -> Column:
        return _winner(F.col(key_hash), [(n["node"], n["weight"]) for n in candidates], weighted, F.col("_far") if anti else None)

    def owner() -> Column:
        among = F.array(*[F.lit(n).cast("long") for n in ids]) if ids else F.array().cast("array<long>")
        found = F.coalesce(winner(preferred), winner(eligible)) if preferred else winner(eligible)
        if caller:
            local = F.array_contains(among, F.col(caller)) & (F.col(caller) != 0)
            if anti:
                local = local & (F.col(caller) != F.col("_far"))
            found = F.when(local, F.col(caller)).otherwise(found)
        if affinity:
            near = F.array_contains(among, F.col("_near"))
            if anti:
                near = near & (F.col("_near") != F.col("_far"))
            found = F.when(near, F.col("_near"))
        return found

    return h.wrapped(out, owner=owner).withColumn("error", missing).drop("_near", "_far")


def sample(rows: DataFrame, seed: str, ratio: float) -> DataFrame:
    """``sampled``: the seed's hash, unsigned, is within the ratio of the whole range."""
    threshold = 0 if ratio <= 0 else (1 << 64) - 1 if ratio >= 1 else int(ratio * 1.8446744073709552e19)
    limit = F.lit(h.signed(threshold ^ (1 << 63))).cast("long")
    return h.wrapped(rows, sampled=lambda: h.unsigned(h.splitmix64(F.col(seed))) <= limit)


def roster_digest(nodes: DataFrame, node: str = "node", by: list[str] | None = None) -> DataFrame:
    """A digest of a set of nodes that doesn't depend on their order."""
    mixed = h.wrapped(nodes, _m=lambda: h.splitmix64(F.col(node) + F.lit(h.signed(h.GOLDEN)).cast("long")))
    return mixed.groupBy(*(by or [])).agg(F.bit_xor("_m").alias("digest"))


def neighbours(pairs: DataFrame, k: int, by: str = "self", node: str = "node") -> DataFrame:
    """Of each node's known nodes, the ``k`` nearest in each bucket of XOR distance."""
    rows = pairs.filter(F.col(by) != F.col(node)).withColumn("distance", xor_distance(F.col(by), F.col(node)))
    rows = rows.withColumn("bucket", distance_bucket(F.col("distance")))
    near = F.row_number().over(Window.partitionBy(by, "bucket").orderBy("distance"))
    return rows.withColumn("_r", near).filter(F.col("_r") <= k).drop("_r")


def partial_view(pairs: DataFrame, max_nodes: int, fanout: int = 3, by: str = "self", node: str = "node") -> DataFrame:
    """``role``: the nearest nodes are active, the next six times as many passive."""
    active = fanout * (max(2, max_nodes) - 1).bit_length()
    rows = pairs.filter(F.col(by) != F.col(node)).withColumn("distance", xor_distance(F.col(by), F.col(node)))
    near = F.row_number().over(Window.partitionBy(by).orderBy("distance"))
    role = F.when(F.col("_r") <= active, "active").when(F.col("_r") <= 7 * active, "passive")
    return rows.withColumn("_r", near).withColumn("role", role).filter("role is not null").drop("_r", "distance")


def routes(requests: DataFrame, table: DataFrame, max_hops: int) -> DataFrame:
    """(self, target, hops, outcome): greedy forwarding to the known node nearest to the target while that gets nearer;
    one join for each hop. table: (self, node)."""
    at = requests.select("self", "target", F.col("self").alias("at"), F.lit(0).cast("long").alias("hops"))
    for _ in range(max_hops):
        known = table.select(F.col("self").alias("at"), "node")
        best = (
            at.filter("at <> target")
            .join(known, "at")
            .withColumn("d", xor_distance(F.col("node"), F.col("target")))
            .groupBy("self", "target")
            .agg(F.min(F.struct("d", "node")).alias("best"))
        )
        moved = at.join(best, ["self", "target"], "left")
        nearer = F.col("best.d") < xor_distance(F.col("at"), F.col("target"))
        at = moved.select(
            "self", "target", F.when(nearer, F.col("best.node")).otherwise(F.col("at")).alias("at"),
            (F.col("hops") + F.coalesce(nearer, F.lit(False)).cast("long")).alias("hops"),
        )
    return at.select("self", "target", "hops", F.when(F.col("at") == F.col("target"), "arrived").otherwise("stuck").alias("outcome"))
