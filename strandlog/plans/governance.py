"""Overload control over the event log. Oracles fold with recursive queries, one row of every key a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.hashing import sql_splitmix64
from strandlog.model import DAY, LOG_SQL, event_log
from strandlog.operators import governance as g
from strandlog.operators.fold import ordered_fold

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEY, ORDER = ["actor"], ["us", "seq"]
HOUR = DAY // 24


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def fold_sql(rows: str, start: str, inner: str, step: str, result: str, key: str = "actor") -> str:
    """A recursive fold. rows: columns and source; start: first state; inner: columns computed from row b and state f;
    step: next state from those; result: what each row gives."""
    return f"""WITH RECURSIVE {LOG_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY us, seq) AS n FROM ({rows})),
f AS (SELECT {key}, 0::BIGINT AS n, NULL::BIGINT AS seq, {start} FROM (SELECT DISTINCT {key} FROM b)
UNION ALL SELECT {key}, n, seq, {step} FROM (SELECT b.*, {inner} FROM f JOIN b ON b.{key} = f.{key} AND b.n = f.n + 1))
SELECT {result} FROM f WHERE n > 0"""


def _bucket(cap: str, rate: str) -> str:
    """Tokens before the cost is taken, from state t and last."""
    return (
        f"CASE WHEN f.last IS NULL OR b.us <= f.last THEN f.t ELSE least({cap}, f.t + CAST((b.us - f.last) * 1000 AS DOUBLE) "
        f"* 1e-9 * {rate}) END AS t2, greatest(b.us, coalesce(f.last, b.us)) AS last2"
    )


@query(
    fold_sql(
        "SELECT * FROM log", "5.0::DOUBLE AS t, NULL::BIGINT AS last, false AS ok", _bucket("5.0", "2e-5::DOUBLE"),
        "CASE WHEN t2 + 1e-9 >= 1 THEN t2 - 1 ELSE t2 END, last2, t2 + 1e-9 >= 1", "actor, seq, ok AS admitted",
    )
)
def ref_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_fold(event_log(spark, sf_dir), KEY, ORDER, g.token_bucket(5.0, 2e-5))


@query(
    fold_sql(
        "SELECT *, 1 + seq % 4 AS cost FROM log", "10.0::DOUBLE AS t, NULL::BIGINT AS last, false AS ok", _bucket("10.0", "5e-5::DOUBLE"),
        "CASE WHEN t2 + 1e-9 >= cost THEN t2 - cost ELSE t2 END, last2, t2 + 1e-9 >= cost", "actor, seq, ok AS admitted",
    )
)
def ref_token_bucket_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).withColumn("cost", 1 + F.col("seq") % 4)
    return ordered_fold(rows, KEY, ORDER, g.token_bucket(10.0, 5e-5, "cost"))


WEIGHTS = {"click": 3.0, "view": 1.0}


@query(
    fold_sql(
        "SELECT *, CASE kind WHEN 'click' THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS share FROM log WHERE kind IN ('click', 'view')",
        "NULL::DOUBLE AS t, NULL::BIGINT AS last, false AS ok",
        "CASE WHEN f.last IS NULL THEN 40.0 * b.share WHEN b.us <= f.last THEN f.t ELSE least(40.0 * b.share, "
        "f.t + CAST((b.us - f.last) * 1000 AS DOUBLE) * 1e-9 * (1e-4::DOUBLE * b.share)) END AS t2, greatest(b.us, coalesce(f.last, b.us)) AS last2",
        "CASE WHEN t2 + 1e-9 >= 1 THEN t2 - 1 ELSE t2 END, last2, t2 + 1e-9 >= 1", "kind, seq, ok AS admitted", "kind",
    )
    + " UNION ALL SELECT kind, seq, true FROM log WHERE kind NOT IN ('click', 'view')"
)
def ref_fair_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds share rate and burst 3 to 1; the other kinds have no key and always pass."""
    log = event_log(spark, sf_dir)
    keyed = ordered_fold(log.filter(F.col("kind").isin(*WEIGHTS)), ["kind"], ORDER, g.fair_share(WEIGHTS, 1e-4, 40.0))
    rest = log.filter(~F.col("kind").isin(*WEIGHTS)).select("kind", "seq", F.lit(True).alias("admitted"))
    return keyed.unionByName(rest)


@query(
    fold_sql(
        "SELECT *, kind IN ('error', 'click') AS failed FROM log", "'closed' AS circuit, 0::BIGINT AS fails, 0::BIGINT AS opened, false AS sent",
        f"f.circuit AS c0, f.fails AS f0, f.opened AS o0, NOT (f.circuit = 'open' AND b.us - f.opened < {2 * DAY}) AS go",
        "CASE WHEN NOT go THEN 'open' WHEN NOT failed THEN 'closed' WHEN c0 = 'open' OR f0 + 1 >= 3 THEN 'open' ELSE 'closed' END, "
        "CASE WHEN NOT go THEN f0 WHEN NOT failed THEN 0 WHEN c0 = 'open' THEN f0 ELSE f0 + 1 END, "
        "CASE WHEN NOT go THEN o0 WHEN NOT failed THEN 0 WHEN c0 = 'open' OR f0 + 1 >= 3 THEN us ELSE 0 END, go",
        "actor, seq, sent, circuit",
    )
)
def ref_circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).withColumn("failed", F.col("kind").isin("error", "click"))
    return ordered_fold(rows, KEY, ORDER, g.circuit_breaker(3, 2 * DAY))


@query(
    fold_sql(
        f"SELECT *, CASE WHEN kind = 'error' THEN us + {3 * DAY} END AS until_us FROM log",
        "2.0::DOUBLE AS t, NULL::BIGINT AS last, 0::BIGINT AS until, NULL::BOOLEAN AS ok",
        f"{_bucket('2.0', '5e-6::DOUBLE')}, f.t AS t0, f.last AS l0, f.until AS u0",
        "CASE WHEN until_us IS NOT NULL OR us >= u0 THEN t0 WHEN t2 + 1e-9 >= 1 THEN t2 - 1 ELSE t2 END, "
        "CASE WHEN until_us IS NOT NULL OR us >= u0 THEN l0 ELSE last2 END, coalesce(until_us, u0), "
        "CASE WHEN until_us IS NULL THEN us >= u0 OR t2 + 1e-9 >= 1 END",
        "actor, seq, ok AS admitted",
    )
    + " AND ok IS NOT NULL"
)
def ref_congestion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    until = F.when(F.col("kind") == "error", F.col("us") + 3 * DAY)
    return ordered_fold(event_log(spark, sf_dir).withColumn("until_us", until), KEY, ORDER, g.congestion_gate(2.0, 5e-6))


@query(
    fold_sql(
        "SELECT *, amount % 100 AS total FROM log", "false AS active, 0::BIGINT AS nxt, false AS fired",
        "f.active AS a0, f.nxt AS n0, b.total >= 60 AND (NOT f.active OR b.us >= f.nxt) AS go",
        f"CASE WHEN go THEN true WHEN total < 30 THEN false ELSE a0 END, CASE WHEN go THEN us + {DAY} ELSE n0 END, go",
        "actor, seq, fired",
    )
)
def ref_congestion_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).withColumn("total", F.col("amount") % 100)
    return ordered_fold(rows, KEY, ORDER, g.congestion_edge(60, 30, DAY, "total"))


@query(
    fold_sql(
        "SELECT * FROM log WHERE kind = 'error'", "NULL::BIGINT AS start, 0::BIGINT AS c, false AS ok",
        f"f.start IS NULL OR b.us - f.start > {4 * DAY} AS anew, f.start AS s0, f.c AS c0",
        "CASE WHEN anew THEN us ELSE s0 END, CASE WHEN anew THEN 1 ELSE c0 + 1 END, CASE WHEN anew THEN true ELSE c0 + 1 <= 2 END",
        "actor, seq, ok AS allowed",
    )
)
def ref_restart_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    faults = event_log(spark, sf_dir).filter("kind = 'error'")
    return ordered_fold(faults, KEY, ORDER, g.restart_budget(2, 4 * DAY))


@query(
    fold_sql(
        "SELECT * FROM log WHERE kind = 'error'", "NULL::BIGINT AS start, 0::BIGINT AS c, false AS ok",
        f"f.start IS NULL OR b.us - f.start >= {4 * DAY} AS anew, f.start AS s0, f.c AS c0",
        "CASE WHEN anew THEN us ELSE s0 END, CASE WHEN anew THEN 1 ELSE least(c0 + 1, 2) END, anew OR c0 < 2",
        "actor, seq, ok AS allowed",
    )
)
def ref_source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    faults = event_log(spark, sf_dir).filter("kind = 'error'")
    return ordered_fold(faults, KEY, ORDER, g.source_cap(2, 4 * DAY))


_GUARD = f"""WITH RECURSIVE {LOG_SQL}, e AS (SELECT *, actor % 4 AS supervisor FROM log WHERE kind = 'error'),
b AS (SELECT *, row_number() OVER (PARTITION BY supervisor ORDER BY us, seq) AS n FROM e),
f AS (SELECT supervisor, 0::BIGINT AS n, NULL::BIGINT AS actor, NULL::BIGINT AS us, NULL::BIGINT AS seq, 5.0::DOUBLE AS t, NULL::BIGINT AS last, false AS ok FROM (SELECT DISTINCT supervisor FROM b)
UNION ALL SELECT supervisor, n, actor, us, seq, CASE WHEN t2 + 1e-9 >= 1 THEN t2 - 1 ELSE t2 END, last2, t2 + 1e-9 >= 1
 FROM (SELECT b.*, {_bucket("5.0", "2e-5::DOUBLE")} FROM f JOIN b ON b.supervisor = f.supervisor AND b.n = f.n + 1)),
c AS (SELECT supervisor, actor, us, seq, row_number() OVER (PARTITION BY supervisor, actor ORDER BY us, seq) AS n FROM f WHERE ok),
g AS (SELECT supervisor, actor, 0::BIGINT AS n, NULL::BIGINT AS us, NULL::BIGINT AS seq, NULL::BIGINT AS start, 0::BIGINT AS c, false AS ok FROM (SELECT DISTINCT supervisor, actor FROM c)
UNION ALL SELECT supervisor, actor, n, us, seq, CASE WHEN anew THEN us ELSE s0 END, CASE WHEN anew THEN 1 ELSE least(c0 + 1, 2) END, anew OR c0 < 2
 FROM (SELECT c.*, g.start IS NULL OR c.us - g.start >= {4 * DAY} AS anew, g.start AS s0, g.c AS c0 FROM g JOIN c ON c.supervisor = g.supervisor AND c.actor = g.actor AND c.n = g.n + 1))
SELECT supervisor, actor, seq, ok AS admitted, CASE WHEN ok THEN us + {HOUR} ELSE 0 END AS deadline_us FROM g WHERE n > 0
UNION ALL SELECT supervisor, actor, seq, false, 0 FROM f WHERE n > 0 AND NOT ok"""


@query(_GUARD)
def ref_escalation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four supervisors over the actors; a supervisor's bucket holds for all of its actors."""
    faults = event_log(spark, sf_dir).filter("kind = 'error'").withColumn("supervisor", F.col("actor") % 4)
    return g.escalation_guard(faults, ["supervisor"], ["actor"], ORDER, 5.0, 2e-5, 2, 4 * DAY, HOUR)


@query(f"WITH {LOG_SQL} SELECT actor % 4 AS supervisor, actor, seq, true AS admitted, 0::BIGINT AS deadline_us FROM log WHERE kind = 'error'")
def ref_escalation_guard_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All knobs at 0: nothing is shed and nothing has a deadline."""
    faults = event_log(spark, sf_dir).filter("kind = 'error'").withColumn("supervisor", F.col("actor") % 4)
    return g.escalation_guard(faults, ["supervisor"], ["actor"], ORDER, 5.0, 0.0, 0, 4 * DAY, 0)


@query(
    fold_sql(
        "SELECT *, CASE WHEN kind = 'error' THEN 1 + seq % 5 ELSE 0 END AS fails FROM log", "NULL::BIGINT AS start, 0::BIGINT AS c, '' AS outcome",
        f"least(b.fails, 3) AS runs, b.fails > 0 AND (f.start IS NULL OR b.us - f.start > {4 * DAY}) AS anew, f.start AS s0, "
        f"CASE WHEN b.fails > 0 AND (f.start IS NULL OR b.us - f.start > {4 * DAY}) THEN 0 ELSE f.c END AS c0",
        "CASE WHEN anew THEN us ELSE s0 END, CASE WHEN runs = 0 THEN c0 WHEN c0 + runs > 5 THEN c0 + greatest(0, 5 - c0) + 1 ELSE c0 + runs END, "
        "CASE WHEN runs = 0 THEN 'handled' WHEN c0 + runs > 5 THEN 'escalated' WHEN fails <= 3 THEN 'recovered' ELSE 'dead_letter' END",
        "actor, seq, outcome",
    )
)
def ref_retry_dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fails = F.when(F.col("kind") == "error", 1 + F.col("seq") % 5).otherwise(0)
    return ordered_fold(event_log(spark, sf_dir).withColumn("fails", fails), KEY, ORDER, g.retry(3, 5, 4 * DAY))


@query(
    fold_sql(
        "SELECT *, amount % 2 AS digest FROM log", "NULL::BIGINT AS com, NULL::BIGINT AS pend, 0::BIGINT AS since, false AS fired",
        f"f.com AS c0, f.pend AS p0, f.since AS s0, f.com IS NOT NULL AND b.digest <> f.com AND f.pend IS NOT NULL AND b.digest = f.pend "
        f"AND b.us - f.since >= {DAY // 2} AS go",
        "CASE WHEN c0 IS NULL OR go THEN digest ELSE c0 END, CASE WHEN c0 IS NULL OR go OR digest = c0 THEN NULL ELSE digest END, "
        "CASE WHEN c0 IS NULL OR go OR digest = c0 THEN 0 WHEN p0 IS NULL OR p0 <> digest THEN us ELSE s0 END, go",
        "actor, seq, fired AS committed",
    )
)
def ref_stabilize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).withColumn("digest", F.col("amount") % 2)
    return ordered_fold(rows, KEY, ORDER, g.stabilise(DAY // 2))


_RUMOURS = "SELECT *, seq % 4 AS inc, CASE WHEN kind = 'error' AND seq % 3 = 0 THEN 'dead' WHEN kind = 'click' THEN 'suspect' ELSE 'alive' END AS st FROM log"


@query(
    fold_sql(
        _RUMOURS, "NULL::VARCHAR AS status, 0::BIGINT AS incarnation",
        "f.status AS s0, f.incarnation AS i0, f.status IS NULL OR (f.status <> 'dead' AND (b.inc > f.incarnation OR (b.inc = f.incarnation AND "
        "(b.st = 'dead' OR (b.st = 'suspect' AND f.status = 'alive'))))) AS wins",
        "CASE WHEN wins THEN st ELSE s0 END, CASE WHEN wins THEN inc ELSE i0 END", "actor, status, incarnation",
    )
    + " QUALIFY n = max(n) OVER (PARTITION BY actor)"
)
def ref_membership_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rumours about each actor's node in order of arrival."""
    status = F.when((F.col("kind") == "error") & (F.col("seq") % 3 == 0), "dead").when(F.col("kind") == "click", "suspect").otherwise("alive")
    rows = event_log(spark, sf_dir).select("actor", "us", "seq", (F.col("seq") % 4).alias("incarnation"), status.alias("status"))
    return ordered_fold(rows, KEY, ORDER, g.membership())


@query(f"""WITH {LOG_SQL}, f AS (SELECT *, first_value(kind) OVER (PARTITION BY actor ORDER BY us, seq) AS first FROM log)
SELECT actor, seq, CASE WHEN kind = first THEN 'bound' ELSE 'unavailable' END AS outcome FROM f""")
def ref_single_producer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).withColumnRenamed("kind", "producer")
    return g.single_producer(rows, KEY, ORDER).select("actor", "seq", "outcome")


@query(
    fold_sql(
        _RUMOURS, "0::BIGINT AS own, false AS refuted", "f.own AS o0, b.st <> 'alive' AND b.inc >= f.own AS go",
        "CASE WHEN go THEN inc + 1 ELSE o0 END, go", "actor, seq, refuted, own",
    )
)
def ref_self_refutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rumours as the node itself takes them."""
    status = F.when((F.col("kind") == "error") & (F.col("seq") % 3 == 0), "dead").when(F.col("kind") == "click", "suspect").otherwise("alive")
    rows = event_log(spark, sf_dir).select("actor", "us", "seq", (F.col("seq") % 4).alias("incarnation"), status.alias("status"))
    return ordered_fold(rows, KEY, ORDER, g.refutation())


@query(
    fold_sql(
        "SELECT * FROM log", "0::BIGINT AS pushed, []::BIGINT[] AS done, false AS stalled",
        f"greatest(b.us, f.pushed) AS ready, CASE WHEN len(f.done) = 4 THEN greatest(b.us, f.pushed, f.done[1]) ELSE greatest(b.us, f.pushed) END AS p2, f.done AS d0",
        f"p2, list_append(CASE WHEN len(d0) = 4 THEN d0[2:] ELSE d0 END, greatest(p2, coalesce(d0[-1], 0)) + {HOUR * 6}), p2 > ready",
        "actor, seq, pushed AS pushed_us, done[-1] AS done_us, stalled",
    )
)
def ref_stream_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four credits, and a consumer that takes six hours a frame: frames wait, none is lost."""
    return ordered_fold(event_log(spark, sf_dir), KEY, ORDER, g.credit_channel(4, 6 * HOUR))


class EveryOther:
    """A limiter of one's own: accepts every second call."""

    def __init__(self) -> None:
        self.calls = 0

    def take(self, us: int, cost: float = 1.0) -> bool:
        self.calls += 1
        return self.calls % 2 == 1


@query(f"WITH {LOG_SQL} SELECT actor, seq, row_number() OVER (PARTITION BY actor ORDER BY us, seq) % 2 = 1 AS admitted FROM log")
def ref_custom_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_fold(event_log(spark, sf_dir), KEY, ORDER, g.limited(EveryOther))


_BANDS = """b AS (SELECT actor, seq, seq % 3 AS band, row_number() OVER (PARTITION BY actor, seq % 3 ORDER BY us, seq) - 1 AS i FROM log),
n AS (SELECT actor, count(*) FILTER (WHERE band = 0) AS n0, count(*) FILTER (WHERE band = 1) AS n1, count(*) FILTER (WHERE band = 2) AS n2 FROM b GROUP BY actor)"""
_TOP = "CASE WHEN h0 < n0 THEN 0 WHEN h1 < n1 THEN 1 ELSE 2 END"


def _from(at: str) -> str:
    """The first band with something left, from ``at`` on in rotation."""
    full = lambda b: f"(CASE ({b}) % 3 WHEN 0 THEN h0 < n0 WHEN 1 THEN h1 < n1 ELSE h2 < n2 END)"
    return f"CASE WHEN {full(at)} THEN {at} WHEN {full(f'{at} + 1')} THEN ({at} + 1) % 3 ELSE ({at} + 2) % 3 END"


_SERVED = "SELECT b.actor, b.seq, CAST(b.band AS BIGINT) AS band, f.turn AS place FROM f JOIN b ON b.actor = f.actor AND b.band = f.band AND b.i = f.i"


@query(f"""WITH RECURSIVE {LOG_SQL}, {_BANDS}, f AS (SELECT actor, 0::BIGINT AS turn, 0::BIGINT AS cur, 0::BIGINT AS h0, 0::BIGINT AS h1, 0::BIGINT AS h2, -1::BIGINT AS band, 0::BIGINT AS i FROM n
UNION ALL SELECT actor, turn + 1, CASE WHEN (turn + 1) % 4 = 0 THEN (k + 1) % 3 ELSE cur END, h0 + (k = 0)::INT, h1 + (k = 1)::INT, h2 + (k = 2)::INT, k, CASE k WHEN 0 THEN h0 WHEN 1 THEN h1 ELSE h2 END
FROM (SELECT f.*, CASE WHEN (turn + 1) % 4 = 0 THEN {_from('cur')} ELSE {_TOP} END AS k FROM f JOIN n USING (actor) WHERE turn < n0 + n1 + n2)) {_SERVED}""")
def ref_rotating_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).withColumn("band", (F.col("seq") % 3).cast("int"))
    return g.rotating_reserve(rows, KEY, ORDER, 3, 4).select("actor", "seq", F.col("band").cast("long").alias("band"), "place")


@query(f"""WITH RECURSIVE {LOG_SQL}, {_BANDS}, f AS (SELECT actor, 0::BIGINT AS turn, 0::BIGINT AS cur, 0::BIGINT AS h0, 0::BIGINT AS h1, 0::BIGINT AS h2, [0, 0, 0]::BIGINT[] AS d, -1::BIGINT AS band, 0::BIGINT AS i FROM n
UNION ALL SELECT actor, turn + 1, k, h0 + (k = 0)::INT, h1 + (k = 1)::INT, h2 + (k = 2)::INT, [d[1] + CASE WHEN k = 0 THEN 3 ELSE 0 END, d[2] + CASE WHEN k = 1 THEN 1 ELSE 0 END, d[3]], k, CASE k WHEN 0 THEN h0 WHEN 1 THEN h1 ELSE h2 END
FROM (SELECT f.*, {_from('cur')} AS k FROM f JOIN n USING (actor) WHERE turn < n0 + n1 + n2)) {_SERVED}""")
def ref_deficit_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 4, 2 and 1: a visit raises a band's credit by those and costs one."""
    rows = event_log(spark, sf_dir).withColumn("band", (F.col("seq") % 3).cast("int"))
    return g.deficit_round_robin(rows, KEY, ORDER, [4, 2, 1]).select("actor", "seq", F.col("band").cast("long").alias("band"), "place")


@query(f"""WITH RECURSIVE {LOG_SQL}, b0 AS (SELECT actor, seq, row_number() OVER (PARTITION BY actor ORDER BY us, seq) - 1 AS n FROM log), b1 AS (SELECT *, n::UBIGINT AS t FROM b0),
{sql_splitmix64('b1', 't', 'r', 'b')}, f AS (SELECT actor, -1::BIGINT AS n, NULL::BIGINT AS seq, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS depth, 0::BIGINT AS slot FROM (SELECT DISTINCT actor FROM b)
UNION ALL SELECT actor, n, seq, list_concat(depth[1:k], [depth[k + 1] + 1], depth[k + 2:8]), k FROM (
 SELECT *, CASE WHEN depth[x + 1] <= depth[y + 1] THEN x ELSE y END AS k FROM (SELECT b.actor, b.n, b.seq, f.depth, (r % 8)::BIGINT AS x, ((r >> 32) % 8)::BIGINT AS y FROM f JOIN b ON b.actor = f.actor AND b.n = f.n + 1)))
SELECT actor, seq, slot FROM f WHERE n >= 0""")
def ref_two_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_fold(event_log(spark, sf_dir), KEY, ORDER, g.two_choices(8))
