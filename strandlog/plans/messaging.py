"""Filters, pairings, fan-out, schedules, rights and evolution over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.functions import scalars as sc
from strandlog.functions.hashing import GOLDEN, hash_combine, sql_hash_combine, sql_splitmix64, wrapped
from strandlog.model import DAY, LOG_SQL, cut, event_log, read
from strandlog.operators import evolution, fanout, logs, schedule, security
from strandlog.operators import placement as p
from strandlog.operators.fold import KeyedFold, ordered_fold, with_lifecycle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
HOUR = DAY // 24
WINDOW = "PARTITION BY actor ORDER BY us, seq"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {LOG_SQL} SELECT actor, CAST(sum(amount * 2) AS BIGINT) AS total, count(*) AS n FROM log GROUP BY actor")
def ref_map_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message doubled and sent on to a sink that sums."""
    sent = event_log(spark, sf_dir).select("actor", (F.col("amount") * 2).alias("amount"))
    return sent.groupBy("actor").agg(F.sum("amount").alias("total"), F.count("*").alias("n"))


@query(f"WITH {LOG_SQL} SELECT seq, CASE kind WHEN 'purchase' THEN amount WHEN 'error' THEN -1 WHEN 'click' THEN 1 ELSE 0 END AS handled FROM log")
def ref_type_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    handled = F.when(F.col("kind") == "purchase", F.col("amount")).when(F.col("kind") == "error", -1).when(F.col("kind") == "click", 1)
    return event_log(spark, sf_dir).select("seq", handled.otherwise(0).cast("long").alias("handled"))


@query(f"""WITH {LOG_SQL} SELECT seq, actor FROM log WHERE NOT (seq % 9 = 0 AND seq % 2 = 0 AND amount % 100 < 50)""")
def ref_cancelled_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages are claimed half a second after they were sent. Each ninth is cancelled, some too late; cancels of odd ones
    carry an old generation. Both change nothing."""
    log = event_log(spark, sf_dir).withColumn("generation", F.lit(2)).withColumn("claimed_at", F.col("us") + 500_000)
    generation, at = F.when(F.col("seq") % 2 == 0, 2).otherwise(1), F.col("us") + F.col("amount") % 100 * 10_000
    cancels = log.filter("seq % 9 = 0").select("seq", generation.alias("generation"), at.alias("cancel_at"))
    return log.join(logs.cancelled(log, cancels, ["seq"]), ["seq"], "left_anti").select("seq", "actor")


@query("""SELECT s_suppkey AS node, s_nationkey % 2 = 0 AS flagged, 'zone' || (s_nationkey % 3) = 'zone1' AS zoned, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 1e-9 END AS weight FROM supplier""")
def ref_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags, labels and a scalar with its fallback, from arrays and maps."""
    zone = F.concat(F.lit("zone"), (F.col("s_nationkey") % 3).cast("string"))
    nodes = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("node"),
        F.when(F.col("s_nationkey") % 2 == 0, F.array(F.lit("gpu"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.create_map(F.lit("zone"), zone).alias("labels"),
        F.create_map(F.lit("weight"), F.col("s_acctbal")).alias("scalars"),
    )
    return nodes.select(
        "node",
        p.has_flag(F.col("flags"), "gpu").alias("flagged"),
        p.has_label(F.col("labels"), "zone", "zone1").alias("zoned"),
        p.clamp_weight(F.col("scalars")["weight"]).alias("weight"),
    )


@query(f"""WITH {LOG_SQL}, d AS (SELECT *, CASE WHEN seq % 4 = 0 THEN 0 ELSE us + amount * 1000 END AS deadline, row_number() OVER ({WINDOW}) AS resident FROM log)
SELECT actor, seq FROM d WHERE NOT (deadline <> 0 AND resident >= 10 AND deadline <= us + 5000000)""")
def ref_deadline_shed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handled five seconds late: a row with a passed deadline is shed if ten or more are resident."""
    rows = logs.fifo_position(event_log(spark, sf_dir), ["actor"], ["us", "seq"])
    deadline = F.when(F.col("seq") % 4 == 0, 0).otherwise(F.col("us") + F.col("amount") * 1000)
    shed = (deadline != 0) & (F.col("pos") >= 10) & (deadline <= F.col("us") + 5_000_000)
    return rows.filter(~shed).select("actor", "seq")


_ACL = "rules(kind, required) AS (VALUES ('purchase', 3), ('error', 4), ('click', 1)), m AS (SELECT *, actor % 8 AS rights FROM log)"


def _authorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("purchase", 3), ("error", 4), ("click", 1)], "kind string, required long")
    rows = event_log(spark, sf_dir).withColumn("rights", F.col("actor") % 8)
    return security.authorise(rows, F.broadcast(rules), ["kind"])


@query(f"WITH {LOG_SQL}, {_ACL} SELECT seq, kind, required IS NOT NULL AND (required & ~rights) = 0 AS allowed FROM m LEFT JOIN rules USING (kind)")
def ref_acl_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _authorised(spark, sf_dir).select("seq", "kind", "allowed")


@query(f"WITH {LOG_SQL}, {_ACL} SELECT kind, count(*) AS denied FROM m LEFT JOIN rules USING (kind) WHERE NOT (required IS NOT NULL AND (required & ~rights) = 0) GROUP BY kind")
def ref_acl_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.deny_audit(_authorised(spark, sf_dir), ["kind"])


@query(f"WITH {LOG_SQL} SELECT seq, (actor % 16) & (seq % 16) AS rights, ((seq % 16) & ~(actor % 16)) <> 0 AS amplified FROM log")
def ref_rights_attenuate(spark: SparkSession, sf_dir: str) -> DataFrame:
    inbound, asked = F.col("actor") % 16, F.col("seq") % 16
    return event_log(spark, sf_dir).select("seq", security.attenuate(inbound, asked).alias("rights"), security.amplifies(inbound, asked).alias("amplified"))


@query(f"WITH {LOG_SQL} SELECT seq, CASE WHEN kind = 'error' THEN 'dead_letter' ELSE 'handled' END AS route FROM log")
def ref_poison_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.route_faults(event_log(spark, sf_dir), ["actor"], ["us", "seq"], F.col("kind") == "error", False).select("seq", "route")


@query(f"""WITH {LOG_SQL}, m AS (SELECT *, coalesce(bool_or(kind = 'error' AND amount > 5000) OVER ({WINDOW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM log)
SELECT seq, CASE WHEN stopped THEN 'supervised_stop' WHEN kind = 'error' AND amount > 5000 THEN 'dead_letter' ELSE 'handled' END AS route FROM m""")
def ref_poison_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    fault = (F.col("kind") == "error") & (F.col("amount") > 5000)
    return security.route_faults(event_log(spark, sf_dir), ["actor"], ["us", "seq"], fault, True).select("seq", "route")


@query(f"WITH {LOG_SQL} SELECT seq FROM log WHERE actor % 5 <> 0 AND actor % 2 = 1")
def ref_revocation_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    revoked = log.filter("actor % 5 = 0").select("actor")
    return security.admitted(security.live(log, revoked, "actor"), log.filter("actor % 2 = 1"), "actor").select("seq")


@query("""SELECT CAST(c_custkey AS BIGINT) AS actor, count(o_orderkey) AS messages, CASE WHEN count(o_orderkey) = 0 THEN 'activated_lazily' ELSE 'resolved' END AS outcome FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def ref_address_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = read(spark, sf_dir, "customer").join(counts, "c_custkey", "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return rows.select(F.col("c_custkey").alias("actor"), n.alias("messages"), F.when(n == 0, "activated_lazily").otherwise("resolved").alias("outcome"))


_SUBS = "subs AS (SELECT DISTINCT topic, subscriber FROM (SELECT CASE n_regionkey WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error' WHEN 3 THEN 'purchase' ELSE 'none' END AS topic, n_nationkey // 2 AS subscriber FROM nation))"


def _subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = F.col("n_regionkey")
    topic = F.when(region == 0, "click").when(region == 1, "view").when(region == 2, "error").when(region == 3, "purchase").otherwise("none")
    return read(spark, sf_dir, "nation").select(topic.alias("topic"), F.floor(F.col("n_nationkey") / 2).cast("long").alias("subscriber"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).withColumnRenamed("kind", "topic")


@query(f"WITH {LOG_SQL}, {_SUBS} SELECT seq, CAST(subscriber AS BIGINT) AS subscriber FROM log JOIN subs ON kind = topic")
def ref_broadcast_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The producer waits, so nothing is lost."""
    return fanout.publish(_messages(spark, sf_dir), _subscribers(spark, sf_dir)).select("seq", "subscriber")


_LANES = f"{_SUBS}, lanes AS (SELECT seq, us, kind, subscriber, row_number() OVER (PARTITION BY kind, subscriber, us // {DAY} ORDER BY us, seq) <= 8 AS ok FROM log JOIN subs ON kind = topic)"


def _bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inboxes are read once a day and hold eight (six, rounded up to a power of two)."""
    pairs = fanout.publish(_messages(spark, sf_dir), _subscribers(spark, sf_dir)).withColumn("day", F.floor(F.col("us") / DAY))
    return fanout.bounded_delivery(pairs, ["topic", "subscriber", "day"], ["us", "seq"], 6)


@query(f"WITH {LOG_SQL}, {_LANES} SELECT seq, count(*) FILTER (WHERE ok) AS delivered, count(*) FILTER (WHERE NOT ok) AS dropped_full FROM lanes GROUP BY seq")
def ref_topic_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout.receipts(_bounded(spark, sf_dir), ["seq"])


@query(f"WITH {LOG_SQL}, {_LANES} SELECT kind AS topic, CAST(subscriber AS BIGINT) AS subscriber, count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS evicted FROM lanes GROUP BY ALL")
def ref_fanout_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout.evictions(_bounded(spark, sf_dir), ["topic", "subscriber"])


@query(f"WITH {LOG_SQL}, {_SUBS} SELECT seq, row_number() OVER (PARTITION BY kind ORDER BY us, seq) AS number FROM log WHERE kind IN (SELECT topic FROM subs)")
def ref_topic_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout.topic_sequence(_messages(spark, sf_dir), _subscribers(spark, sf_dir), ["us", "seq"]).select("seq", "number")


@query(f"""WITH {LOG_SQL}, s0 AS (SELECT min(us) AS t FROM log), s AS (SELECT kind AS topic, actor AS subscriber, min(us) AS since, CASE WHEN actor % 3 = 0 THEN NULL ELSE min(us) + actor * {DAY // 8} END AS until FROM log GROUP BY kind, actor)
SELECT seq, count(*) AS reached FROM log JOIN s ON kind = topic AND since <= us AND (until IS NULL OR us < until) GROUP BY seq""")
def ref_subscription_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An actor subscribes to a kind with its first message of it, for a time that depends on it."""
    log = event_log(spark, sf_dir)
    subs = log.groupBy(F.col("kind").alias("topic"), F.col("actor").alias("subscriber")).agg(F.min("us").alias("since"))
    subs = subs.withColumn("until", F.when(F.col("subscriber") % 3 != 0, F.col("since") + F.col("subscriber") * (DAY // 8)))
    return fanout.reached_during(_messages(spark, sf_dir), subs).select("seq", "reached")


@query(f"WITH {LOG_SQL} SELECT kind AS topic, actor AS subscriber, seq, row_number() OVER (PARTITION BY kind, actor ORDER BY seq) = 1 AS fresh FROM log")
def ref_subscribe_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).select(F.col("kind").alias("topic"), F.col("actor").alias("subscriber"), "seq")
    return fanout.subscribe(rows, order="seq")


@query(f"""WITH {LOG_SQL} SELECT c.seq, p.seq AS trace_id, least(p.us + {HOUR}, c.us + c.amount * 1000) AS deadline_us FROM log c JOIN log p ON c.seq = p.seq + 1""")
def ref_context_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is sent by the one before it, and inherits trace and the earlier deadline."""
    log = event_log(spark, sf_dir)
    parents = log.select((F.col("seq") + 1).alias("seq"), F.col("seq").alias("trace"), (F.col("us") + HOUR).alias("until"))
    rows = log.join(parents, "seq")
    context = fanout.child_context(F.col("until"), F.col("us") + F.col("amount") * 1000, F.col("trace"))
    return rows.select("seq", *[c.alias(n) for n, c in context.items()])


@query(f"WITH {LOG_SQL} SELECT kind, count(*) AS dropped FROM log WHERE kind NOT IN ('click', 'view', 'purchase') GROUP BY kind")
def ref_unknown_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("click",), ("view",), ("purchase",)], "kind string")
    return event_log(spark, sf_dir).join(F.broadcast(known), "kind", "left_anti").groupBy("kind").agg(F.count("*").alias("dropped"))


@query(f"WITH {LOG_SQL} SELECT seq, us // 1000 + greatest(1, (amount + 9) // 10) AS expiry FROM log")
def ref_one_shot_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.floor(F.col("us") / 1000).cast("long")
    return event_log(spark, sf_dir).select("seq", schedule.one_shot(now, F.col("amount"), 10).alias("expiry"))


_SERIES = "fires AS (SELECT actor, seq, unnest(range(amount, 20001, 1000 + actor)) AS fire FROM log)"


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir)
    return schedule.series(rows, F.col("amount"), 1000 + F.col("actor"), F.lit(20000).cast("long"))


@query(f"WITH {LOG_SQL}, {_SERIES} SELECT seq, fire FROM fires")
def ref_periodic_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir).select("seq", "fire")


@query(f"WITH {LOG_SQL}, {_SERIES} SELECT seq, fire FROM fires WHERE NOT (seq % 2 = 0 AND fire > 9000)")
def ref_timer_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second timer is cancelled at 9000; an older generation's cancel changes nothing."""
    fires = _series(spark, sf_dir).withColumn("generation", F.lit(1))
    at = fires.select("seq").distinct().filter("seq % 2 = 0").withColumn("cancel_at", F.lit(9000))
    cancels = at.withColumn("generation", F.lit(1)).unionByName(fires.select("seq").distinct().withColumn("cancel_at", F.lit(1)).withColumn("generation", F.lit(0)))
    return schedule.without_cancelled(fires, cancels, ["seq"]).select("seq", "fire")


@query(f"WITH {LOG_SQL} SELECT us // {HOUR} AS bucket, count(*) AS due FROM log GROUP BY ALL")
def ref_due_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).groupBy(schedule.due_bucket(F.col("us"), HOUR).alias("bucket")).agg(F.count("*").alias("due"))


_FLAT = f"""r0 AS (SELECT o_orderkey, o_orderpriority, 1::UBIGINT AS k, o_orderkey::UBIGINT AS key, (o_orderkey % 7)::UBIGINT AS name FROM orders), {sql_hash_combine('r0', 'k', 'key', 'ah', 'r1')},
r2 AS (SELECT *, xor(ah, ((name::HUGEINT * {GOLDEN}) % 18446744073709551616)::UBIGINT) AS x FROM r1), {sql_splitmix64('r2', 'x', 'rank', 'r')},
t AS (SELECT *, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY rank) - 1) // 40 AS tick FROM r)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderkey") % 7).alias("name"))
    rows = wrapped(rows, ah=lambda: hash_combine(F.lit(1), F.col("o_orderkey")))
    return schedule.drain_rank(rows, "ah", "name")


@query(f"WITH {_FLAT} SELECT o_orderkey, tick FROM t")
def ref_reminder_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reminders due at once, a wave for each priority, forty a tick in the order of their rank."""
    return schedule.flatten_wave(_ranked(spark, sf_dir), ["o_orderpriority"], ["rank"], 40).select("o_orderkey", "tick")


@query(f"WITH {_FLAT}, p AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY rank) - 1 AS k FROM r) SELECT o_orderkey, k // 85 * 3 + CASE WHEN k % 85 < 15 THEN 0 WHEN k % 85 < 45 THEN 1 ELSE 2 END AS tick FROM p")
def ref_reminder_paced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen tokens a bucket and ticks after one, two and four buckets: the third tick's sixty are capped at the credit of
    forty."""
    granted = schedule.grants([1, 2, 4], 15, 40)
    return schedule.paced_wave(_ranked(spark, sf_dir), ["o_orderpriority"], ["rank"], granted).select("o_orderkey", "tick")


@query(f"WITH {_FLAT} SELECT o_orderkey FROM r QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY rank) <= 100")
def ref_reminder_unlimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a rate all that are ready fire, up to the credit."""
    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("rank"))
    return _ranked(spark, sf_dir).withColumn("r", place).filter("r <= 100").select("o_orderkey")


@query(f"""WITH {LOG_SQL}, s AS (SELECT actor, kind AS name, max(us) AS due, CASE WHEN actor % 2 = 0 THEN {HOUR} ELSE 0 END AS period FROM log GROUP BY ALL)
SELECT actor, name, due + CASE WHEN actor % 5 <> 0 THEN period ELSE 0 END AS due, period FROM s WHERE actor % 5 = 0 OR period > 0""")
def ref_reminder_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reminders fire; a crash loses the confirmations of each fifth actor, so theirs are still in the store."""
    due = event_log(spark, sf_dir).groupBy("actor", F.col("kind").alias("name")).agg(F.max("us").alias("due"))
    store = due.withColumn("period", F.when(F.col("actor") % 2 == 0, F.lit(HOUR)).otherwise(0))
    fired = store.select("actor", "name", (F.col("actor") % 5 != 0).alias("confirmed"))
    return schedule.confirm(store, fired, ["actor", "name"]).select("actor", "name", "due", "period")


@query(f"WITH {LOG_SQL} SELECT actor, kind AS name, us // {DAY} AS scheduled FROM log GROUP BY ALL")
def ref_reminder_idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firings that a crash repeats are dropped by (actor, name, scheduled)."""
    fires = event_log(spark, sf_dir).select("actor", F.col("kind").alias("name"), F.floor(F.col("us") / DAY).cast("long").alias("scheduled"))
    return schedule.confirmed(fires.unionByName(fires), ["actor", "name", "scheduled"])


@query(f"""WITH {LOG_SQL}, m AS (SELECT *, coalesce(us - lag(us) OVER ({WINDOW}) > {DAY}, true) AS fresh FROM log)
SELECT actor, seq, CAST(sum(fresh::INT) OVER ({WINDOW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) AS session FROM m""")
def ref_idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.idle_sessions(event_log(spark, sf_dir), ["actor"], "us", ["us", "seq"], DAY).select("actor", "seq", "session")


@query("""SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) * CASE WHEN o_orderkey % 3 = 2 THEN 1 ELSE 10 END AS balance_millis, CASE WHEN o_orderkey % 3 = 0 THEN 'USD' ELSE 'EUR' END AS currency, o_orderkey % 3 = 2 AND o_orderkey % 2 = 0 AS frozen FROM orders""")
def ref_schema_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts of three versions: cents, then with a currency, then in thousandths with a frozen flag."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("long").alias("b"))
    v1 = rows.filter("id % 3 = 0").select("id", F.col("b").alias("balance_cents"))
    v2 = rows.filter("id % 3 = 1").select("id", F.col("b").alias("balance_cents"), F.lit("EUR").alias("currency"))
    v3 = rows.filter("id % 3 = 2").select("id", F.col("b").alias("balance_millis"), F.lit("EUR").alias("currency"), (F.col("id") % 2 == 0).alias("frozen"))
    chain = evolution.Chain(
        {
            1: lambda d: d.withColumn("currency", F.lit("USD")),
            2: lambda d: d.select("id", (F.col("balance_cents") * 10).alias("balance_millis"), "currency", F.lit(False).alias("frozen")),
        }
    )
    return chain.read({1: v1, 2: v2, 3: v3})


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_orderkey % 5 END AS priority, '' AS note FROM orders")
def ref_additive_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old records lack fields, new ones have unknown fields."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    schema = {"id": ("long", 0), "priority": ("long", 0), "note": ("string", "")}
    old = evolution.with_defaults(rows.filter("id % 2 = 0"), schema)
    new = rows.filter("id % 2 = 1").select("id", (F.col("id") % 5).alias("priority"), F.lit("x").alias("later_field"))
    return old.unionByName(evolution.with_defaults(new, schema))


@query(f"""WITH {LOG_SQL} SELECT seq, CASE WHEN seq % 10 = 3 THEN 'type_mismatch' WHEN seq % 7 NOT BETWEEN 1 AND 4 THEN 'unknown_version' END AS problem,
 CASE WHEN seq % 2 = 0 AND actor % 2 = 0 THEN 'tagless' ELSE 'tagged' END AS encoding FROM log""")
def ref_record_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    type_key = F.when(F.col("seq") % 10 == 3, 8).otherwise(7)
    rows = event_log(spark, sf_dir).withColumn("type_key", type_key).withColumn("version", F.col("seq") % 7)
    encoding = evolution.negotiate(F.col("seq") % 2, F.col("actor") % 2, F.lit(0), F.lit(0))
    return evolution.screen(rows, 7, 4).select("seq", "problem", encoding.alias("encoding"))


@query(f"WITH {LOG_SQL} SELECT seq, CASE WHEN seq % 6 <> 0 THEN CAST(amount AS VARCHAR) END AS body FROM log")
def ref_sealed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed under (fence, seq) and opened again; each sixth is opened under another seq, and refused."""
    log = event_log(spark, sf_dir)
    bound = lambda seq: F.concat_ws(":", F.lit("7"), seq.cast("string"))
    nonce = F.unhex(F.lpad(F.hex("seq"), 24, "0"))
    sealed = security.seal(log, b"0123456789abcdef", F.col("amount").cast("string"), nonce, bound(F.col("seq")))
    claimed = F.when(F.col("seq") % 6 == 0, F.col("seq") + 1).otherwise(F.col("seq"))
    return security.unseal(sealed, b"0123456789abcdef", bound(claimed)).select("seq", "body")


@query(f"""WITH RECURSIVE {LOG_SQL}, s AS (SELECT seq AS span, CASE WHEN seq % 50 = 0 THEN NULL ELSE seq - 1 END AS parent FROM log),
t AS (SELECT span, 0::BIGINT AS depth FROM s WHERE parent IS NULL UNION ALL SELECT s.span, t.depth + 1 FROM t JOIN s ON s.parent = t.span) SELECT span, depth FROM t""")
def ref_span_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of fifty spans."""
    spans = event_log(spark, sf_dir).select(F.col("seq").alias("span"), F.when(F.col("seq") % 50 != 0, F.col("seq") - 1).alias("parent"))
    return security.span_depths(spans)


@query(f"""WITH {LOG_SQL}, t AS (SELECT *, CASE WHEN kind = 'error' THEN 'failed' WHEN kind = 'purchase' THEN 'closed' END AS cause FROM log)
SELECT actor, min_by(cause, (us, seq)) AS terminal FROM t WHERE cause IS NOT NULL GROUP BY actor""")
def ref_stream_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cause that ends an actor's reply stream."""
    cause = F.when(F.col("kind") == "error", "failed").when(F.col("kind") == "purchase", "closed")
    rows = event_log(spark, sf_dir).withColumn("cause", cause).filter("cause is not null")
    return rows.groupBy("actor").agg(F.min_by("cause", F.struct("us", "seq")).alias("terminal"))


@query("SELECT s_suppkey AS node FROM supplier WHERE s_suppkey <> 1 AND s_suppkey <> 4 AND s_suppkey % 6 <> 0")
def ref_roster_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live peers without oneself, an excluded node and the dead."""
    nodes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    gone = nodes.filter("node % 6 = 0").union(spark.createDataFrame([(1,), (4,)], "node long"))
    return nodes.join(gone.distinct(), "node", "left_anti")


@query("SELECT DISTINCT s_suppkey AS node, s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AS changed FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
def ref_revocation_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set that only grows; ``changed``: what the merge brought."""
    nodes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    own, other = nodes.filter("node % 3 = 0").withColumn("own", F.lit(1)), nodes.filter("node % 2 = 0")
    merged = other.union(own.select("node")).distinct().join(own, "node", "left")
    return merged.select("node", F.col("own").isNull().alias("changed"))


@query(f"""WITH {LOG_SQL}, p AS (SELECT *, row_number() OVER ({WINDOW}) AS pos, count(*) OVER (PARTITION BY actor) AS n FROM log)
SELECT actor, count(*) AS acked, count(*) FILTER (WHERE pos <= n // 8 * 8) AS batched, count(*) AS synced FROM p GROUP BY actor""")
def ref_persist_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crash after the last row leaves: every acknowledged row in the one mode, all but an open batch of eight in the
    other."""
    log = event_log(spark, sf_dir)
    synced = logs.persisted(log, ["actor"], ["us", "seq"]).groupBy("actor").agg(F.count("*").alias("acked"), F.count("durable_at").alias("synced"))
    batched = logs.persisted(log, ["actor"], ["us", "seq"], 8).groupBy("actor").agg(F.count("durable_at").alias("batched"))
    return synced.join(batched, "actor").select("actor", "acked", "batched", "synced")


@query(f"WITH {LOG_SQL} SELECT actor, seq, CASE WHEN row_number() OVER ({WINDOW}) > 20 THEN 'overflow' ELSE 'queued' END AS outcome FROM log")
def ref_overflow_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded queue that tells its senders."""
    return logs.fail_when_full(event_log(spark, sf_dir), ["actor"], ["us", "seq"], 20).select("actor", "seq", "outcome")


_LIVES = f"""n AS (SELECT *, us - lag(us) OVER ({WINDOW}) > {DAY} AS idle, lag(kind) OVER ({WINDOW}) = 'error' AS restarted FROM log),
m AS (SELECT *, sum(coalesce(idle, false)::INT) OVER w + sum(coalesce(restarted, false)::INT) OVER w AS activation FROM n WINDOW w AS ({WINDOW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT *, sum(amount) OVER (PARTITION BY actor, activation ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM m)"""


@query(f"""WITH {LOG_SQL}, {_LIVES} SELECT actor, seq, CAST(total AS BIGINT) AS total, CAST(activation AS BIGINT) AS activation,
CAST(CASE WHEN idle THEN CASE WHEN restarted THEN 0 ELSE lag(total) OVER ({WINDOW}) END END AS BIGINT) AS flushed FROM t""")
def ref_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running total that is flushed when its actor is passivated after an idle day, and starts anew after a fault."""
    step = lambda total, row: (total + row["amount"], {"seq": row["seq"], "total": total + row["amount"]})
    fold = KeyedFold(lambda: 0, step, "seq long, total long", reads=["seq", "amount"])
    rows = event_log(spark, sf_dir).withColumn("fault", F.col("kind") == "error")
    return ordered_fold(rows, ["actor"], ["us", "seq"], with_lifecycle(fold, lambda total: {"flushed": total}, "flushed long", "us", DAY, "fault"))


_AUDIT = (("authn_failure", 0), ("authz_denial", 1), ("cluster_admission", 2), ("secret_failure", 3), ("amplification_refused", 4), ("placement_rejected", 5), ("other", 6))


@query(f"""WITH {LOG_SQL}, {_ACL}, a AS (SELECT us, actor AS subject, CASE WHEN required IS NULL THEN 2 ELSE 1 END AS code, 1 AS kind, 'no right to ' || kind AS detail FROM m LEFT JOIN rules USING (kind) WHERE NOT (required IS NOT NULL AND (required & ~rights) = 0)
UNION ALL SELECT us, actor, 4, 4, 'rights beyond the caller''s' FROM log WHERE ((seq % 16) & ~(actor % 16)) <> 0
UNION ALL SELECT us, actor, 5, 5, 'node not admitted' FROM log WHERE actor % 3 = 0)
SELECT CAST(kind AS BIGINT) AS kind, CAST(code AS BIGINT) AS code, subject, detail, count(*) AS n, max(us) AS last_us FROM a GROUP BY ALL""")
def ref_audit_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Denials, refused amplifications and rejected placements as records of kind, code, subject, detail and time in one
    append-only table, and how many of each there are."""
    number = dict(_AUDIT)
    denied = _authorised(spark, sf_dir).filter("not allowed")
    code = F.when(F.col("required").isNull(), 2).otherwise(1)
    log = event_log(spark, sf_dir)
    records = security.audit(denied, number["authz_denial"], code, "actor", F.concat(F.lit("no right to "), F.col("kind")))
    beyond = log.filter(security.amplifies(F.col("actor") % 16, F.col("seq") % 16))
    records = records.unionByName(security.audit(beyond, number["amplification_refused"], F.lit(4), "actor", F.lit("rights beyond the caller's")))
    records = records.unionByName(security.audit(log.filter("actor % 3 = 0"), number["placement_rejected"], F.lit(5), "actor", F.lit("node not admitted")))
    kept = cut(records, "audit")
    return kept.groupBy("kind", "code", "subject", "detail").agg(F.count("*").alias("n"), F.max("us").alias("last_us"))


@query(f"""WITH {LOG_SQL} SELECT seq, CASE WHEN seq % 2 = 1 THEN CAST(actor AS HUGEINT) - 9223372036854775808 ELSE actor END::BIGINT AS trace_id, seq % 2 = 1 AS sampled, actor AS correlation FROM log""")
def ref_trace_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling decision is the top bit of a trace's id and travels with it."""
    rows = event_log(spark, sf_dir).withColumn("trace_id", sc.make_trace_id(F.col("actor"), F.col("seq") % 2 == 1))
    return rows.select("seq", "trace_id", sc.trace_is_sampled(F.col("trace_id")).alias("sampled"), sc.trace_correlation(F.col("trace_id")).alias("correlation"))
