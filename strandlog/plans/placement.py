"""Placement of customers' actors on a cluster with a node for each nation.

A node's weight is its suppliers' balance, its zone the region; a nation without suppliers has no weight of its own. Nodes
know each other where a customer of the one has bought from a supplier of the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions import hashing as h
from strandlog.functions.hashing import sql_hash_combine, sql_splitmix64
from strandlog.model import LOG_SQL, cut, event_log, read
from strandlog.operators import metrics
from strandlog.operators import placement as p

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _nodes(spark: SparkSession, sf_dir: str) -> list[dict]:
    cents = F.floor(F.col("s_acctbal") * 100).cast("long")
    balances = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sum(cents).alias("cents"))
    rows = read(spark, sf_dir, "nation").join(balances, "n_nationkey", "left")
    rows = rows.select((F.col("n_nationkey") + 1).alias("node"), p.clamp_weight(F.col("cents")).alias("weight"), F.col("n_regionkey").alias("zone"))
    return [dict(zip(("node", "weight", "zone"), r, strict=True)) for r in p.view(rows, "node", "weight", "zone")]


def _ids(spark: SparkSession, sf_dir: str) -> list[int]:
    return [n["node"] for n in _nodes(spark, sf_dir)]


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.with_hash(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), "key")


_N = f"""w0 AS (SELECT s_nationkey, CAST(sum(CAST(floor(s_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents FROM supplier GROUP BY ALL),
n0 AS (SELECT (n_nationkey + 1)::UBIGINT AS node, CASE WHEN cents IS NULL THEN 1.0 WHEN cents > 0 THEN cents ELSE 1e-9 END::DOUBLE AS weight, n_regionkey AS zone
 FROM nation LEFT JOIN w0 ON s_nationkey = n_nationkey), {sql_splitmix64('n0', 'node', 'nm', 'nodes')}"""
_K = f"k0 AS (SELECT c_custkey::UBIGINT AS key FROM customer), {sql_hash_combine('k0', '1::UBIGINT', 'key', 'kh', 'keys')}"
_X = f"x0 AS (SELECT *, xor(nm, kh) AS xx FROM keys, nodes), {sql_splitmix64('x0', 'xx', 'w', 'x')}"
_SCORE = "weight / -ln(((w >> 11)::DOUBLE + 0.5) / 9007199254740992.0::DOUBLE)"
PLACED = f"WITH {_N}, {_K}, {_X}"


@query(f"{PLACED} SELECT key::BIGINT AS key, max_by(node, (w, node))::BIGINT AS owner FROM x GROUP BY key")
def ref_hrw_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.place(_keys(spark, sf_dir), _ids(spark, sf_dir)).select("key", "owner")


@query(f"{PLACED} SELECT key::BIGINT AS key, max_by(node, ({_SCORE}, node))::BIGINT AS owner FROM x GROUP BY key")
def ref_weighted_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = [(n["node"], n["weight"]) for n in _nodes(spark, sf_dir)]
    return p.place_weighted(_keys(spark, sf_dir), nodes).select("key", "owner")


_BINS = f"""b0 AS (SELECT i::UBIGINT AS bin, xor(i::UBIGINT, {h.BIN_SALT}::UBIGINT) AS salted FROM range({p.bin_count(64)}) t(i)),
{sql_splitmix64('b0', 'salted', 'kh', 'bk')}, y0 AS (SELECT *, xor(nm, kh) AS xx FROM bk, nodes), {sql_splitmix64('y0', 'xx', 'w', 'y')},
bins AS (SELECT bin, max_by(node, (w, node)) AS owner FROM y GROUP BY bin)"""
_BY_BIN = f"{sql_splitmix64('keys', 'kh', 'kb', 'kb0')}, looked AS (SELECT key, kb & {p.bin_count(64) - 1}::UBIGINT AS bin FROM kb0)"


@query(f"WITH {_N}, {_BINS} SELECT bin::BIGINT AS bin, owner::BIGINT AS owner FROM bins")
def ref_virtual_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.virtual_bins(spark, _ids(spark, sf_dir), 64)


def _looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = p.virtual_bins(spark, _ids(spark, sf_dir), 64)
    return p.bin_of(_keys(spark, sf_dir), p.bin_count(64)).join(F.broadcast(bins), "bin")


@query(f"WITH {_N}, {_K}, {_BINS}, {_BY_BIN} SELECT key::BIGINT AS key, bin::BIGINT AS bin, owner::BIGINT AS owner FROM looked JOIN bins USING (bin)")
def ref_bin_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_up(spark, sf_dir).select("key", "bin", "owner")


@query(f"""WITH {_N}, {_BINS}, c AS (SELECT node, count(bin) AS n FROM nodes LEFT JOIN bins ON owner = node GROUP BY node)
SELECT count(*) AS owners, CAST(sum((n = 0)::INT) AS BIGINT) AS idle, round(max(n) / avg(n), 6) AS max_over_mean, round(stddev_pop(n) / avg(n), 6) AS cov FROM c""")
def ref_bin_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _ids(spark, sf_dir)
    owners = spark.createDataFrame([(n,) for n in ids], "owner long")
    return metrics.skew(p.virtual_bins(spark, ids, 64), "owner", owners)


@query(f"""{PLACED}, o AS (SELECT key, max_by(node, ({_SCORE}, node)) AS node FROM x GROUP BY key),
s AS (SELECT node, count(*) AS n FROM o GROUP BY node)
SELECT node::BIGINT AS node, round((coalesce(n, 0) / (SELECT count(*) FROM o)) / (weight / (SELECT sum(weight ORDER BY node) FROM nodes)), 6) AS rho FROM nodes LEFT JOIN s USING (node)""")
def ref_weighted_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the keys over share of the weight, for each node."""
    nodes = _nodes(spark, sf_dir)
    placed = p.place_weighted(_keys(spark, sf_dir), [(n["node"], n["weight"]) for n in nodes])
    loads, total = placed.groupBy(F.col("owner").alias("node")).agg(F.count("*").alias("n")), sum(n["weight"] for n in nodes)
    whole = placed.agg(F.count("*").alias("m"))
    table = spark.createDataFrame([(n["node"], n["weight"]) for n in nodes], "node long, weight double")
    rows = table.join(loads, "node", "left").crossJoin(F.broadcast(whole))  # one row
    return rows.select("node", F.round((F.coalesce("n", F.lit(0)) / F.col("m")) / (F.col("weight") / F.lit(total)), 6).alias("rho"))


_ELIGIBLE = "SELECT * FROM x WHERE zone % 2 = 0"


@query(f"""{PLACED}, e AS ({_ELIGIBLE}), q AS (SELECT *, max((zone < 2)::INT) OVER (PARTITION BY key) AS most FROM e)
SELECT key::BIGINT AS key, max_by(node, (w, node))::BIGINT AS owner, NULL AS error FROM q WHERE (zone < 2)::INT = most GROUP BY key""".replace("NULL AS error", "NULL::VARCHAR AS error"))
def ref_require_prefer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even zones are required, zones below two preferred."""
    rows = p.resolve(_keys(spark, sf_dir), _nodes(spark, sf_dir), require=lambda n: n["zone"] % 2 == 0, prefer=lambda n: n["zone"] < 2)
    return rows.select("key", "owner", "error")


@query("SELECT c_custkey AS key, NULL::BIGINT AS owner, 'not_found' AS error FROM customer")
def ref_require_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A requirement that no node meets is an error on every row."""
    return p.resolve(_keys(spark, sf_dir), _nodes(spark, sf_dir), require=lambda n: n["zone"] < 0).select("key", "owner", "error")


_NEAR = f"""g0 AS (SELECT key, key % 10 AS parent FROM k0), {sql_hash_combine('g0', '2::UBIGINT', 'parent', 'gh', 'gk')},
z0 AS (SELECT key, node, zone, xor(nm, gh) AS xx FROM gk, nodes), {sql_splitmix64('z0', 'xx', 'w', 'z')}, near AS (SELECT key, max_by(node, (w, node)) AS near FROM z GROUP BY key)"""


def _with_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keys(spark, sf_dir).withColumn("parent", F.col("key") % 10)
    return p.with_hash(rows, "parent", 2, "parent_hash")


@query(f"""WITH {_N}, {_K}, {_NEAR} SELECT key::BIGINT AS key, CASE WHEN zone % 2 = 0 THEN near::BIGINT END AS owner,
 CASE WHEN zone % 2 = 0 THEN NULL ELSE 'not_found' END AS error FROM near JOIN nodes ON node = near""")
def ref_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the node of the parent's actor, if that is in an even zone."""
    rows = p.resolve(_with_parent(spark, sf_dir), _nodes(spark, sf_dir), require=lambda n: n["zone"] % 2 == 0, affinity="parent_hash")
    return rows.select("key", "owner", "error")


@query(f"""{PLACED}, {_NEAR} SELECT key::BIGINT AS key, max_by(node, ({_SCORE}, node))::BIGINT AS owner FROM x JOIN near USING (key) WHERE node <> near GROUP BY key""")
def ref_anti_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anywhere but on the parent's node, by weight."""
    rows = p.resolve(_with_parent(spark, sf_dir), _nodes(spark, sf_dir), anti="parent_hash", weighted=True)
    return rows.select("key", "owner")


@query(f"""{PLACED}, h AS (SELECT key, max_by(node, (w, node)) AS hrw FROM x GROUP BY key), c AS (SELECT *, key % 40 AS caller FROM h)
SELECT key::BIGINT AS key, CASE WHEN caller <> 0 AND caller IN (SELECT node FROM nodes) THEN caller ELSE hrw END::BIGINT AS owner FROM c""")
def ref_local_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keys(spark, sf_dir).withColumn("caller", F.col("key") % 40)
    return p.resolve(rows, _nodes(spark, sf_dir), caller="caller").select("key", "owner")


@query(f"{PLACED} SELECT key::BIGINT AS key, max_by(node, (w, node))::BIGINT AS owner FROM x WHERE node % 3 <> 0 GROUP BY key")
def ref_admitted_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only admitted nodes, those not divisible by three, take part."""
    return p.place(_keys(spark, sf_dir), [n for n in _ids(spark, sf_dir) if n % 3]).select("key", "owner")


@query(f"""{PLACED}, o AS (SELECT key, max_by(node, (w, node))::BIGINT AS owner FROM x GROUP BY key)
SELECT owner, owner = 1 AS local, count(*) FILTER (WHERE owner = 1 OR owner % 7 <> 0) AS sent, count(*) FILTER (WHERE owner <> 1 AND owner % 7 = 0) AS shed FROM o GROUP BY ALL""")
def ref_distributed_tell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What node 1 keeps and what it sends to each other node; what is for a congested peer is shed and counted."""
    placed = p.place(_keys(spark, sf_dir), _ids(spark, sf_dir))
    local, congested = F.col("owner") == 1, F.col("owner") % 7 == 0
    return placed.groupBy("owner", local.alias("local")).agg(
        F.count(F.when(local | ~congested, 1)).alias("sent"), F.count(F.when(~local & congested, 1)).alias("shed")
    )


@query("SELECT c_custkey AS key, nullif(c_custkey % 30, 0) AS owner, CASE WHEN c_custkey % 30 = 0 THEN 'not_found' END AS error FROM customer")
def ref_explicit_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wherever the caller says; without a target it is an error."""
    rows = _keys(spark, sf_dir).withColumn("target", F.nullif(F.col("key") % 30, F.lit(0)))
    return p.resolve(rows, _nodes(spark, sf_dir), explicit="target").select("key", "owner", "error")


@query(f"""WITH {_N}, {_K}, l AS (SELECT list(node ORDER BY node) AS every FROM nodes)
SELECT key::BIGINT AS key, every[(kh >> 33)::BIGINT % len(every) + 1]::BIGINT AS owner, NULL::VARCHAR AS error FROM keys, l""")
def ref_custom_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strategy of one's own: the hash's upper bits modulo the number of nodes."""

    def modulo(key_hash: Column, nodes: list[dict]) -> Column:
        every = F.array(*[F.lit(n["node"]).cast("long") for n in nodes])
        return F.get(every, (F.shiftrightunsigned(key_hash, 33) % len(nodes)).cast("int"))

    return p.resolve(_keys(spark, sf_dir), _nodes(spark, sf_dir), custom=modulo).select("key", "owner", "error")


@query(f"WITH {_N}, {_K}, {_BINS}, {_BY_BIN} SELECT key::BIGINT AS key, owner::BIGINT AS owner, NULL::VARCHAR AS error FROM looked JOIN bins USING (bin)")
def ref_bin_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without modifiers the policy looks keys up by bin."""
    nodes = _nodes(spark, sf_dir)
    bins = p.virtual_bins(spark, [n["node"] for n in nodes], 64)
    return p.resolve(_keys(spark, sf_dir), nodes, bins=bins).select("key", "owner", "error")


@query("SELECT c_custkey AS key, NULL::BIGINT AS owner, 'unavailable' AS error FROM customer")
def ref_place_unavailable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty view is another error than a requirement that nobody meets."""
    return p.resolve(_keys(spark, sf_dir), []).select("key", "owner", "error")


@query(f"""WITH {LOG_SQL}, s0 AS (SELECT seq, seq::UBIGINT AS u FROM log), {sql_splitmix64('s0', 'u', 'z', 's')} SELECT seq, z <= {int(0.25 * 1.8446744073709552e19)}::UBIGINT AS sampled FROM s""")
def ref_span_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.sample(event_log(spark, sf_dir), "seq", 0.25).select("seq", "sampled")


@query(f"""WITH r0 AS (SELECT s_nationkey AS zone, ((s_suppkey::HUGEINT + {h.GOLDEN}) % 18446744073709551616)::UBIGINT AS u FROM supplier), {sql_splitmix64('r0', 'u', 'z', 'r')},
d AS (SELECT zone, bit_xor(z) AS x FROM r GROUP BY zone) SELECT zone, CASE WHEN x >= 9223372036854775808 THEN (x::HUGEINT - 18446744073709551616)::BIGINT ELSE x::BIGINT END AS digest FROM d""")
def ref_roster_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("zone"), F.col("s_suppkey").alias("node"))
    return p.roster_digest(nodes, by=["zone"])


@query(f"""WITH {LOG_SQL}, i0 AS (SELECT seq, actor::UBIGINT AS a, seq::UBIGINT AS b FROM log), {sql_hash_combine('i0', 'a', 'b', 'z', 'i')}
SELECT seq, CASE WHEN z >= 9223372036854775808 THEN (z::HUGEINT - 18446744073709551616)::BIGINT ELSE z::BIGINT END AS hash FROM i""")
def ref_actor_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.wrapped(event_log(spark, sf_dir), hash=lambda: h.actor_hash(F.col("actor"), F.col("seq"))).select("seq", "hash")


@query(f"""SELECT p_partkey, CASE WHEN x >= 9223372036854775808 THEN x - 18446744073709551616 ELSE x END::BIGINT AS hash FROM (SELECT p_partkey,
 list_reduce(list_concat([{h.FNV_OFFSET}::HUGEINT], list_transform(range(octet_length(p_name::BLOB)::BIGINT), lambda i: ('0x' || substr(hex(p_name), 2 * i::BIGINT + 1, 2))::HUGEINT)),
 lambda a, b: xor(a, b) * {h.FNV_PRIME} % 18446744073709551616) AS x FROM part)""")
def ref_name_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of names."""
    return read(spark, sf_dir, "part").select("p_partkey", h.fnv1a("p_name").alias("hash"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(self, node) of nodes that know each other."""
    one = lambda name: (F.col(name) + 1).alias("a" if name[0] == "c" else "b")
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    bought = items.join(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey")
    bought = bought.join(read(spark, sf_dir, "customer").select("c_custkey", one("c_nationkey")), "c_custkey")
    bought = bought.join(read(spark, sf_dir, "supplier").select("s_suppkey", one("s_nationkey")), "s_suppkey")
    met = bought.groupBy("a", "b").count().filter("a <> b")  # at most one row for two nations
    return met.select(F.explode(F.array(F.struct(F.col("a").alias("self"), F.col("b").alias("node")), F.struct(F.col("b").alias("self"), F.col("a").alias("node")))).alias("x")).select("x.*").distinct()


_PAIRS = """met AS (SELECT DISTINCT c_nationkey + 1 AS a, s_nationkey + 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey), pairs AS (SELECT a AS self, b AS node FROM met UNION SELECT b, a FROM met),
t AS (SELECT self, node, xor(self, node) AS d, length(bin(xor(self, node))) - 1 AS bucket FROM pairs QUALIFY row_number() OVER (PARTITION BY self, length(bin(xor(self, node))) ORDER BY xor(self, node)) <= 2)"""


@query(f"WITH {_PAIRS} SELECT self, node, d AS distance, bucket FROM t")
def ref_xor_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.neighbours(_pairs(spark, sf_dir), 2).select("self", "node", "distance", "bucket")


@query(f"""WITH RECURSIVE {_PAIRS}, q AS (SELECT self, node AS target FROM pairs),
f AS (SELECT self, target, self AS at_node, 0::BIGINT AS hops FROM q
UNION ALL SELECT f.self, f.target, b.node, f.hops + 1 FROM f JOIN LATERAL (SELECT node FROM t WHERE t.self = f.at_node ORDER BY xor(node, f.target), node LIMIT 1) b ON true
WHERE f.at_node <> f.target AND f.hops < 4 AND xor(b.node, f.target) < xor(f.at_node, f.target))
SELECT self, target, max(hops) AS hops, CASE WHEN max_by(at_node, hops) = target THEN 'arrived' ELSE 'stuck' END AS outcome FROM f GROUP BY self, target""")
def ref_greedy_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cut(_pairs(spark, sf_dir), "pairs")
    table = p.neighbours(pairs, 2).select("self", "node")
    return p.routes(pairs.select("self", F.col("node").alias("target")), table, 4)


@query(f"""WITH {_PAIRS}, r AS (SELECT self, node, row_number() OVER (PARTITION BY self ORDER BY xor(self, node)) AS r FROM pairs)
SELECT self, node, CASE WHEN r <= 2 THEN 'active' ELSE 'passive' END AS role FROM r WHERE r <= 14""")
def ref_partial_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.partial_view(_pairs(spark, sf_dir), 4, 1).select("self", "node", "role")


@query(f"WITH {LOG_SQL} SELECT actor, seq, (row_number() OVER (PARTITION BY actor ORDER BY us, seq) - 1) % 6 AS slot FROM log")
def ref_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlog.operators.logs import fifo_position

    rows = fifo_position(event_log(spark, sf_dir), ["actor"], ["us", "seq"])
    return rows.select("actor", "seq", ((F.col("pos") - 1) % 6).alias("slot"))


@query("""WITH c AS (SELECT s_nationkey AS zone, count(*) AS total, count(*) FILTER (WHERE s_suppkey % 3 = 0) AS relays FROM supplier GROUP BY ALL)
SELECT zone, total, relays, relays <= greatest(8, CAST(ceil(sqrt(total)) AS BIGINT)) AS ok FROM c""")
def ref_relay_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relays may be no more than the root of the nodes, or eight."""
    rows = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("zone"))
    rows = rows.agg(F.count("*").alias("total"), F.count(F.when(F.col("s_suppkey") % 3 == 0, 1)).alias("relays"))
    return rows.withColumn("ok", F.col("relays") <= F.greatest(F.lit(8), F.ceil(F.sqrt("total"))))
