"""Counters, histograms and scalar functions over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions import scalars as sc
from strandlog.model import DAY, DELIVERED_SQL, LOG_SQL, delivered, event_log
from strandlog.operators import logs, metrics

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_BITS = "CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {LOG_SQL} SELECT kind, count(*) AS messages, CAST(sum(amount) AS BIGINT) AS amount FROM log GROUP BY kind")
def ref_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir)
    return metrics.shard_counters(rows, F.col("actor") % 8, ["kind"], messages=F.lit(1).cast("long"), amount=F.col("amount"))


def _log2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).withColumn("shard", F.col("actor") % 8)
    return metrics.merge(metrics.histogram(rows, ["shard", "kind"], sc.log2_bucket(F.col("amount")), "amount"), ["kind"])


_LOG2 = f"h AS (SELECT kind, least(63, {_BITS.format('amount')}) AS bucket, count(*) AS n, CAST(sum(amount) AS BIGINT) AS sum, min(amount) AS min, max(amount) AS max FROM log GROUP BY ALL)"


@query(f"WITH {LOG_SQL}, {_LOG2} SELECT kind, bucket, n, sum, min, max FROM h")
def ref_log2_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of each shard and kind, merged over shards."""
    return _log2(spark, sf_dir)


@query(f"WITH {LOG_SQL}, {_LOG2} SELECT kind, bucket, (1::BIGINT << bucket) - 1 AS le, CAST(sum(n) OVER (PARTITION BY kind ORDER BY bucket) AS BIGINT) AS cumulative FROM h")
def ref_cumulative_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cumulative(_log2(spark, sf_dir), ["kind"])


@query(f"""WITH {LOG_SQL}, {_LOG2}, c AS (SELECT *, (1::BIGINT << bucket) - 1 AS le, CAST(sum(n) OVER (PARTITION BY kind ORDER BY bucket) AS BIGINT) AS cum FROM h)
SELECT kind, '# TYPE strandlog_' || kind || ' histogram' || chr(10) || string_agg('strandlog_' || kind || '_bucket{{le="' || le || '"}} ' || cum, chr(10) ORDER BY bucket)
 || chr(10) || 'strandlog_' || kind || '_sum ' || CAST(sum(sum) AS BIGINT) || chr(10) || 'strandlog_' || kind || '_count ' || CAST(sum(n) AS BIGINT) || chr(10) AS text FROM c GROUP BY kind""")
def ref_histogram_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram_exposition(_log2(spark, sf_dir), "kind")


@query(f"""WITH {LOG_SQL} SELECT kind AS name, '# TYPE strandlog_' || kind || ' counter' || chr(10) || 'strandlog_' || kind || ' ' || count(*) || chr(10) AS text FROM log GROUP BY kind""")
def ref_counter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = event_log(spark, sf_dir).groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("value"))
    return metrics.exposition(counts)


def _linear_log_sql(v: str, buckets: int, shift: int, step: int) -> str:
    sub, octave = 1 << step, f"({_BITS.format(v)} - 1)"
    return (
        f"least({buckets - 1}, CASE WHEN {v} < {sub << shift} THEN {v} >> {shift} ELSE {sub} + ({octave} - {shift + step}) * {sub} "
        f"+ (({v} - (1::BIGINT << {octave})) >> ({octave} - {step})) END)"
    )


@query(f"WITH {LOG_SQL} SELECT kind, {_linear_log_sql('amount', *sc.LATENCY_NS)} AS latency, {_linear_log_sql('seq', *sc.MAILBOX_DEPTH)} AS depth, count(*) AS n FROM log GROUP BY ALL")
def ref_linear_log_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    latency = sc.linear_log_bucket(F.col("amount"), *sc.LATENCY_NS)
    depth = sc.linear_log_bucket(F.col("seq"), *sc.MAILBOX_DEPTH)
    return event_log(spark, sf_dir).groupBy("kind", latency.alias("latency"), depth.alias("depth")).agg(F.count("*").alias("n"))


_BOUNDS = sc.boundaries(*sc.MAILBOX_DEPTH)[:-1]


@query("SELECT i AS bucket, CASE WHEN i < 8 THEN i ELSE (1::BIGINT << (3 + (i - 8) // 8)) + ((i - 8) % 8 + 1) * (1::BIGINT << ((i - 8) // 8)) - 1 END AS upper FROM range(31) t(i)")
def ref_bucket_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_BOUNDS)), "bucket long, upper long")


@query(f"""WITH {LOG_SQL}, f AS (SELECT kind, actor, min((us, seq)) AS first FROM log GROUP BY kind, actor),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY first, actor) AS r FROM f)
SELECT kind, CASE WHEN r <= 5 THEN CAST(actor AS VARCHAR) ELSE 'other' END AS slot, count(*) AS n FROM log JOIN r USING (kind, actor) GROUP BY ALL""")
def ref_bounded_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.bounded_instances(event_log(spark, sf_dir), ["kind"], "actor", ["us", "seq"], 5)
    return rows.groupBy("kind", "slot").agg(F.count("*").alias("n"))


@query(f"""WITH {LOG_SQL}, f AS (SELECT actor % 4 AS shard, kind, actor, count(*) AS n FROM log GROUP BY ALL),
w AS (SELECT actor % 4 AS shard, kind, actor, min((us, seq)) AS first FROM log GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY shard, kind ORDER BY first, actor) AS r FROM w)
SELECT shard, kind, count(*) FILTER (WHERE r <= 3) AS slots, count(*) FILTER (WHERE r > 3) AS exhausted, CAST(coalesce(sum(n) FILTER (WHERE r > 3), 0) AS BIGINT) AS other FROM r JOIN f USING (shard, kind, actor) GROUP BY shard, kind""")
def ref_instance_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three slots for each shard and kind: how many are taken, how often there was none, and what instances without one
    handled."""
    rows = event_log(spark, sf_dir).withColumn("shard", F.col("actor") % 4)
    slotted = metrics.bounded_instances(rows, ["shard", "kind"], "actor", ["us", "seq"], 3)
    return metrics.slot_use(slotted, ["shard", "kind"], "actor")


@query(f"WITH {DELIVERED_SQL} SELECT actor, max(copy) AS copy, max_by(amount, (seq % 10, copy, amount)) AS amount FROM delivered GROUP BY actor".replace(
    "max(copy) AS copy", "max_by(copy, (seq % 10, copy, amount)) AS copy"))
def ref_last_writer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities merged by (incarnation, local seq, blob)."""
    rows = delivered(event_log(spark, sf_dir)).select("actor", (F.col("seq") % 10).alias("inc"), "copy", "amount")
    return metrics.last_writer(rows, ["actor"], ["inc", "copy", "amount"]).select("actor", "copy", "amount")


@query(f"""WITH {DELIVERED_SQL}, m AS (SELECT *, max(seq) OVER (PARTITION BY actor ORDER BY arrived, seq, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM delivered)
SELECT actor, count(*) AS sent, count(*) FILTER (WHERE high IS NULL OR seq > high) AS received, count(*) FILTER (WHERE seq <= high) AS lost, count(*) = count(*) FILTER (WHERE high IS NULL OR seq > high) + count(*) FILTER (WHERE seq <= high) AS whole FROM m GROUP BY actor""")
def ref_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery is either accepted or accounted for as a duplicate."""
    rows = logs.mark_duplicates(delivered(event_log(spark, sf_dir)), ["actor"], ["arrived", "seq", "copy"])
    return metrics.reconcile(rows, rows.filter("accepted"), rows.filter("not accepted"), ["actor"])


@query(f"""WITH {LOG_SQL}, v AS (SELECT seq, amount - 5000 AS s, amount AS u FROM log)
SELECT seq, CASE WHEN s >= 0 THEN 2 * s ELSE -2 * s - 1 END AS zz, s AS back, greatest(1, CAST(ceil(({_BITS.format('u')}) / 7.0) AS BIGINT)) AS leb,
 CASE WHEN u <= 1 THEN 1 ELSE 1::BIGINT << ({_BITS.format('(u - 1)')}) END AS pow2 FROM v""")
def ref_codec_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir)
    s, u = F.col("amount") - 5000, F.col("amount")
    return rows.select("seq", sc.zigzag(s).alias("zz"), sc.unzigzag(sc.zigzag(s)).alias("back"), sc.uleb_size(u).alias("leb"), sc.next_pow2(u).alias("pow2"))


@query(f"""WITH {LOG_SQL}, v AS (SELECT seq, us, CASE WHEN seq % 3 = 0 THEN 0 ELSE us + amount * 1000 END AS a, CASE WHEN seq % 4 = 0 THEN 0 ELSE us + 2000000 END AS b, us + 3000000 AS now, amount AS rtt FROM log)
SELECT seq, coalesce(least(nullif(a, 0), nullif(b, 0)), 0) AS early, a <> 0 AND a <= now AS gone, CASE WHEN a <> 0 THEN a - now END AS left_us,
 greatest(0, coalesce(CASE WHEN a <> 0 THEN a - now END, 0)) AS clamped, now + (2000000 - rtt // 2) AS rebased, us + 2000000 AS after, greatest(1, (rtt + 9) // 10) AS ticks FROM v""")
def ref_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir)
    a = F.when(F.col("seq") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("us") + F.col("amount") * 1000)
    b = F.when(F.col("seq") % 4 == 0, F.lit(0).cast("long")).otherwise(F.col("us") + 2_000_000)
    now = F.col("us") + 3_000_000
    return rows.select(
        "seq",
        sc.earlier(a, b).alias("early"),
        sc.expired(a, now).alias("gone"),
        sc.remaining(a, now).alias("left_us"),
        F.coalesce(sc.remaining_clamped(a, now), F.lit(0).cast("long")).alias("clamped"),
        sc.rebase(F.lit(2_000_000).cast("long"), F.col("amount"), now).alias("rebased"),
        sc.deadline_after(F.col("us"), F.lit(2_000_000).cast("long")).alias("after"),
        sc.ticks_ceil(F.col("amount"), 10).alias("ticks"),
    )


@query(f"""WITH {LOG_SQL} SELECT seq, CAST(((seq::HUGEINT << 16) | (2 << 12) | (actor % 4096)) AS BIGINT) AS word, seq % (1::BIGINT << 48) AS gen, 2 AS state, actor % 4096 AS flags,
 (64 + seq % 100) AS budget, amount % 16777216 AS bound FROM log""")
def ref_packed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir)
    word = sc.pack({"flags": F.col("actor") % 4096, "state": F.lit(2), "generation": F.col("seq")}, sc.MESSAGE_WORD)
    config = sc.pack(
        {"budget": 64 + F.col("seq") % 100, "overflow": F.lit(1), "bound": F.col("amount"), "idle": F.lit(30), "log": F.lit(3), "shed": F.lit(1)}, sc.CONFIG_WORD
    )
    of = lambda name: sc.unpack(word, name, sc.MESSAGE_WORD)
    return rows.select(
        "seq", word.alias("word"), of("generation").alias("gen"), of("state").alias("state"), of("flags").alias("flags"),
        sc.unpack(config, "budget", sc.CONFIG_WORD).alias("budget"), sc.unpack(config, "bound", sc.CONFIG_WORD).alias("bound"),
    )


@query(f"""WITH {LOG_SQL} SELECT seq, '00-0000000000000000' || lpad(lower(hex(actor)), 16, '0') || '-' || lpad(lower(hex(seq)), 16, '0') || '-0' || (seq % 2) AS header,
 CASE WHEN seq % 5 <> 0 AND seq > 0 AND actor > 0 THEN actor END AS trace, CASE WHEN seq % 5 <> 0 AND seq > 0 AND actor > 0 THEN seq END AS span,
 CASE WHEN seq % 5 <> 0 AND seq > 0 AND actor > 0 THEN seq % 2 = 1 END AS sampled FROM log""")
def ref_traceparent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers written and read again; each fifth is damaged on the way."""
    header = sc.format_traceparent(F.col("actor"), F.col("seq"), F.col("seq") % 2 == 1)
    rows = event_log(spark, sf_dir).withColumn("header", header)
    got = F.when(F.col("seq") % 5 == 0, F.overlay("header", F.lit("x"), 36)).otherwise(F.col("header"))
    return rows.select("seq", "header", *[c.alias(n) for n, c in sc.parse_traceparent(got).items()])


@query(f"WITH {LOG_SQL} SELECT seq, xor(seq, actor) AS distance, {_BITS.format('xor(seq, actor)')} - 1 AS bucket FROM log WHERE seq <> actor")
def ref_xor_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sc.xor_distance(F.col("seq"), F.col("actor"))
    return event_log(spark, sf_dir).filter("seq <> actor").select("seq", d.alias("distance"), sc.distance_bucket(d).alias("bucket"))


@query(f"WITH {LOG_SQL} SELECT kind, us // {DAY} AS day, count(*) AS n, max(seq) AS last FROM log GROUP BY ALL")
def ref_audit_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit table's records by kind and day."""
    day = F.floor(F.col("us") / DAY).cast("long")
    return event_log(spark, sf_dir).groupBy("kind", day.alias("day")).agg(F.count("*").alias("n"), F.max("seq").alias("last"))
