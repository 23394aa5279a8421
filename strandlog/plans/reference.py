"""Order, duplicates, appends, snapshots and replay over the event log, with the same rows in DuckDB SQL.

``events`` has neither duplicates nor disorder, so both are derived: see ``model.delivered``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.model import DELIVERED_SQL, LOG_SQL, delivered, event_log, read
from strandlog.operators import logs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEY, ORDER = ["actor"], ["us", "seq"]
WINDOW = "PARTITION BY actor ORDER BY us, seq"
RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {LOG_SQL} SELECT actor, seq, row_number() OVER ({WINDOW}) AS pos,
       CAST(sum(amount) OVER ({WINDOW} {RUN}) AS BIGINT) AS total FROM log""")
def ref_fifo_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.fifo_position(event_log(spark, sf_dir), KEY, ORDER)
    return logs.running_total(rows, KEY, ORDER, "amount").select("actor", "seq", "pos", "total")


@query(f"""WITH {LOG_SQL} SELECT actor, seq, amount FROM log WHERE seq >= 500""")
def ref_log_scan_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.scan_from(event_log(spark, sf_dir), 500).select("actor", "seq", "amount")


@query(f"""WITH {DELIVERED_SQL}, m AS (SELECT *, max(seq) OVER (PARTITION BY actor ORDER BY arrived, seq, copy {BEFORE}) AS high
           FROM delivered) SELECT actor, seq, copy, high IS NULL OR seq > high AS accepted FROM m""")
def ref_dedup_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.mark_duplicates(delivered(event_log(spark, sf_dir)), KEY, ["arrived", "seq", "copy"])
    return rows.select("actor", "seq", "copy", "accepted")


@query(f"""WITH {DELIVERED_SQL}, d AS (SELECT actor, arrived, seq, copy, seq % 50 AS n FROM delivered),
m AS (SELECT *, max(n) OVER (PARTITION BY actor ORDER BY arrived, seq, copy {BEFORE}) AS high FROM d)
SELECT actor, seq, copy, n > coalesce(high, 0) AS accepted FROM m""")
def ref_stale_datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = delivered(event_log(spark, sf_dir)).withColumn("n", F.col("seq") % 50)
    return logs.mark_stale(rows, KEY, ["arrived", "seq", "copy"], "n").select("actor", "seq", "copy", "accepted")


@query(f"""WITH {DELIVERED_SQL}, p AS (SELECT actor, seq, row_number() OVER (PARTITION BY actor ORDER BY seq) - 1 AS n FROM log),
d AS (SELECT actor, arrived, copy, seq, n FROM delivered JOIN p USING (actor, seq) WHERE seq % 13 <> 0),
m AS (SELECT *, coalesce(max(n) OVER (PARTITION BY actor ORDER BY arrived, seq, copy {BEFORE}) + 1, 0) AS nxt FROM d)
SELECT actor, seq, copy, n >= nxt AS accepted, n > nxt AS gap FROM m""")
def ref_reply_gap_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    places = logs.fifo_position(log, KEY, ["seq"]).select("actor", "seq", (F.col("pos") - 1).alias("n"))
    rows = delivered(log).join(places, ["actor", "seq"]).filter("seq % 13 <> 0")
    return logs.reply_gaps(rows, KEY, ["arrived", "seq", "copy"], "n").select("actor", "seq", "copy", "accepted", "gap")


@query(f"""WITH {DELIVERED_SQL}, m AS (SELECT *, coalesce(max(seq) OVER (PARTITION BY actor ORDER BY arrived, seq, copy {BEFORE}), 0) AS h
           FROM delivered) SELECT actor, count(*) FILTER (WHERE seq > h) AS advances, max(greatest(seq, 0)) AS tail FROM m GROUP BY actor""")
def ref_credit_max_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.credit_advances(delivered(event_log(spark, sf_dir)), KEY, ["arrived", "seq", "copy"], "seq")
    return rows.groupBy("actor").agg(F.count(F.when(F.col("advanced"), 1)).alias("advances"), F.max("seq").alias("tail"))


@query(f"""WITH {DELIVERED_SQL}, t AS (SELECT *, seq // 40 AS token FROM delivered),
m AS (SELECT *, max(token) OVER (PARTITION BY actor ORDER BY arrived, seq, copy {RUN}) AS high FROM t)
SELECT actor, seq, copy, token FROM m WHERE token >= high""")
def ref_fencing_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = delivered(event_log(spark, sf_dir)).withColumn("token", F.floor(F.col("seq") / 40).cast("long"))
    return logs.fence(rows, KEY, ["arrived", "seq", "copy"]).select("actor", "seq", "copy", "token")


_ATTEMPTS = """attempts AS (SELECT actor, n // 5 AS batch, n % 5 AS pos, CASE WHEN (n // 5) % 4 = 3 AND n % 5 = 4 THEN seq - 10000000 ELSE seq END AS seq,
       CASE WHEN (n // 5) % 6 = 5 THEN 1 ELSE 1 + n // 10 END AS token
FROM (SELECT actor, seq, row_number() OVER (PARTITION BY actor ORDER BY us, seq) - 1 AS n FROM log))"""


@query(f"""WITH RECURSIVE {LOG_SQL}, {_ATTEMPTS},
u AS (SELECT *, coalesce(seq > lag(seq) OVER (PARTITION BY actor, batch ORDER BY pos), true) AS up FROM attempts),
b AS (SELECT actor, batch, bool_and(up) AS up, min_by(seq, pos) AS first, max(seq) AS last, max(token) AS tok FROM u GROUP BY ALL),
f AS (SELECT actor, -1::BIGINT AS batch, '' AS outcome, -1::BIGINT AS last_seq, 0::BIGINT AS owner FROM (SELECT DISTINCT actor FROM b)
 UNION ALL SELECT b.actor, b.batch, CASE WHEN tok < owner THEN 'fenced' WHEN NOT up OR first <= last_seq THEN 'out_of_order' ELSE 'appended' END,
   CASE WHEN tok < owner OR NOT up OR first <= last_seq THEN last_seq ELSE last END, greatest(owner, tok)
 FROM f JOIN b ON b.actor = f.actor AND b.batch = f.batch + 1)
SELECT actor, batch, outcome, last_seq FROM f WHERE batch >= 0""")
def ref_atomic_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of five; each fourth ends with a low seq and each sixth has an old token."""
    n = F.col("pos") - 1
    rows = logs.fifo_position(event_log(spark, sf_dir), KEY, ORDER).withColumn("n", n)
    batch = F.floor(F.col("n") / 5).cast("long")
    rows = rows.select(
        "actor",
        batch.alias("batch"),
        (F.col("n") % 5).alias("pos"),
        F.when((batch % 4 == 3) & (F.col("n") % 5 == 4), F.col("seq") - 10_000_000).otherwise(F.col("seq")).alias("seq"),
        F.when(batch % 6 == 5, F.lit(1)).otherwise(1 + F.floor(F.col("n") / 10)).cast("long").alias("token"),
    )
    return logs.atomic_append(rows, KEY, "batch").select("actor", "batch", "outcome", "last_seq")


@query(f"""WITH {LOG_SQL}, l AS (SELECT actor, max(seq) AS last_seq FROM log GROUP BY actor),
s AS (SELECT actor, seq AS arrived, seq + CASE WHEN seq % 3 = 0 THEN 1000000 ELSE 0 END AS through_seq, amount AS balance FROM log WHERE seq % 5 = 0)
SELECT actor, max_by(through_seq, arrived) AS through_seq, max_by(balance, arrived) AS balance FROM s JOIN l USING (actor)
WHERE through_seq <= last_seq GROUP BY actor""")
def ref_snapshot_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot at each fifth event; each third of them claims more than the log holds and is rejected."""
    log = event_log(spark, sf_dir)
    last = log.groupBy("actor").agg(F.max("seq").alias("last_seq"))
    through = F.col("seq") + F.when(F.col("seq") % 3 == 0, F.lit(1_000_000)).otherwise(0)
    made = log.filter("seq % 5 = 0").select("actor", F.col("seq").alias("arrived"), through.alias("through_seq"), F.col("amount").alias("balance"))
    found = logs.latest_snapshot(made.join(last, "actor"), KEY, ["arrived"], F.col("last_seq"))
    return found.select("actor", "through_seq", "balance")


@query(f"""WITH {LOG_SQL} SELECT actor, CAST(sum(amount) AS BIGINT) AS balance, count(*) AS applied, max(seq) AS last_seq
           FROM log GROUP BY actor""")
def ref_event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.replay(event_log(spark, sf_dir), KEY)


@query(ORACLES["ref_event_replay"])
def ref_snapshot_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots through each actor's last seq divisible by ten, and the events after them: the same as a full replay."""
    log = event_log(spark, sf_dir)
    cuts = log.filter("seq % 10 = 0").groupBy("actor").agg(F.max("seq").alias("through_seq"))
    taken = log.join(cuts, "actor").filter("seq <= through_seq").groupBy("actor", "through_seq")
    snapshots = taken.agg(F.sum("amount").alias("balance"), F.count("*").alias("applied"))
    return logs.snapshot_and_tail(snapshots, log, KEY)


@query(f"""WITH {LOG_SQL}, r AS (SELECT actor, kind AS name, seq, us + amount AS due_us, kind = 'error' AND seq % 2 = 0 AS removed FROM log),
l AS (SELECT actor, name, max_by(due_us, seq) AS due_us, max_by(removed, seq) AS removed FROM r GROUP BY actor, name)
SELECT actor, name, due_us FROM l WHERE NOT removed""")
def ref_reminder_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts on (actor, name), and removals; what is left is the compacted store."""
    removed = (F.col("kind") == "error") & (F.col("seq") % 2 == 0)
    rows = event_log(spark, sf_dir).select(
        "actor", F.col("kind").alias("name"), "seq", (F.col("us") + F.col("amount")).alias("due_us"), removed.alias("removed")
    )
    return logs.upsert_latest(rows, ["actor", "name"], ["seq"]).select("actor", "name", "due_us")


@query(f"""WITH {LOG_SQL}, e AS (SELECT * FROM log WHERE kind = 'error'), r AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY us DESC, seq DESC) AS r,
       count(*) OVER (PARTITION BY actor) AS n FROM e) SELECT actor, seq, greatest(n - 4, 0) AS dropped FROM r WHERE r <= 4""")
def ref_ring_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters: the last four of each actor."""
    kept, lost = logs.ring(event_log(spark, sf_dir).filter("kind = 'error'"), KEY, ORDER, 4)
    return kept.join(lost, "actor").select("actor", "seq", "dropped")


@query(f"""WITH {LOG_SQL} SELECT actor, seq, (row_number() OVER ({WINDOW}) - 1) // 8 AS turn FROM log""")
def ref_drain_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.drain_batches(event_log(spark, sf_dir), KEY, ORDER, 8).select("actor", "seq", "turn")


@query(f"""WITH {LOG_SQL}, r AS (SELECT *, row_number() OVER ({WINDOW}) AS r FROM log) SELECT actor, seq FROM r WHERE r <= 20""")
def ref_drop_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.drop_newest(event_log(spark, sf_dir), KEY, ORDER, 20).select("actor", "seq")


@query(f"""WITH {LOG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY us DESC, seq DESC) AS r FROM log)
           SELECT actor, seq FROM r WHERE r <= 20""")
def ref_drop_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.drop_oldest(event_log(spark, sf_dir), KEY, ORDER, 20).select("actor", "seq")


@query(f"""WITH {LOG_SQL}, g AS (SELECT *, seq % 97 <> 13 AS good FROM log), m AS (SELECT *, bool_and(good) OVER ({WINDOW} {RUN}) AS ok FROM g)
           SELECT actor, seq FROM m WHERE ok""")
def ref_wal_torn_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames carry a crc of their body; each 97th is torn, and nothing after a key's first torn frame is read."""
    body = F.concat_ws("|", "actor", "seq", "amount").cast("binary")
    rows = event_log(spark, sf_dir).withColumn("stored", F.crc32(body) + F.when(F.col("seq") % 97 == 13, 1).otherwise(0))
    return logs.torn_tail(rows, KEY, ORDER, F.col("stored") == F.crc32(body)).select("actor", "seq")


_COMMIT = """rec AS (SELECT actor, us, seq, unnest(['event', 'watermark'] || list_transform(range(seq % 3), lambda x: 'outbox') ||
  CASE WHEN seq % 2 = 0 THEN ['reply'] ELSE [] END) AS record, generate_subscripts(['event', 'watermark'] || list_transform(range(seq % 3), lambda x: 'outbox') ||
  CASE WHEN seq % 2 = 0 THEN ['reply'] ELSE [] END, 1) - 1 AS place FROM log)"""


def _committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).withColumn("outbound", (F.col("seq") % 3).cast("int")).withColumn("replies", F.col("seq") % 2 == 0)
    return logs.commit_batch(rows, KEY, ORDER)


@query(f"""WITH {LOG_SQL}, {_COMMIT} SELECT actor, seq, record, place, row_number() OVER (PARTITION BY actor ORDER BY us, seq, place) AS log_seq FROM rec""")
def ref_commit_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _committed(spark, sf_dir).select("actor", "seq", "record", "place", "log_seq")


@query(f"""WITH {LOG_SQL}, {_COMMIT} SELECT actor, max(seq) FILTER (WHERE record = 'watermark') AS watermark, count(*) FILTER (WHERE record = 'outbox') AS outbox,
 max_by(seq, (us, seq)) FILTER (WHERE record = 'reply') AS reply_seq, count(*) FILTER (WHERE record = 'event') AS events FROM rec GROUP BY actor""")
def ref_recover_by_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.recover(_committed(spark, sf_dir), KEY, ["us", "seq", "place"])


@query(f"""WITH {LOG_SQL}, {_COMMIT} SELECT actor, seq * 1048576 + (place - 2) + 1 AS out_seq FROM rec WHERE record = 'outbox'""")
def ref_outbound_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _committed(spark, sf_dir).filter("record = 'outbox'").withColumn("index", F.col("place") - 2)
    return logs.outbound_ids(rows, "seq", "index").select("actor", "out_seq")


@query(f"""WITH {LOG_SQL}, {_COMMIT}, o AS (SELECT actor, seq * 1048576 + (place - 2) + 1 AS out_seq FROM rec WHERE record = 'outbox')
SELECT actor, count(*) * 2 AS sent, count(*) AS accepted FROM o GROUP BY actor""")
def ref_outbox_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two drains send every committed outbox row twice; the receiver keeps each once."""
    rows = logs.outbound_ids(_committed(spark, sf_dir).filter("record = 'outbox'").withColumn("index", F.col("place") - 2), "seq", "index")
    sent = rows.withColumn("round", F.explode(F.array(F.lit(0), F.lit(1))))
    got = logs.mark_duplicates(sent, KEY, ["round", "out_seq"], "out_seq")
    return got.groupBy("actor").agg(F.count("*").alias("sent"), F.count(F.when(F.col("accepted"), 1)).alias("accepted"))


@query(f"""WITH {DELIVERED_SQL}, m AS (SELECT *, max(seq) OVER (PARTITION BY actor ORDER BY arrived, seq, copy {BEFORE}) AS high FROM delivered)
SELECT actor, max_by(amount, (arrived, seq, copy)) AS reply FROM m WHERE (high IS NULL OR seq > high) AND seq % 2 = 0 GROUP BY actor""")
def ref_reply_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reply of each sender's last committed message that had one."""
    rows = logs.mark_duplicates(delivered(event_log(spark, sf_dir)), KEY, ["arrived", "seq", "copy"]).filter("accepted and seq % 2 = 0")
    return rows.groupBy("actor").agg(F.max_by("amount", F.struct("arrived", "seq", "copy")).alias("reply"))


@query("""SELECT a.conv_id, a.turn, b.turn AS reply_turn, CASE WHEN b.turn IS NULL THEN 'unanswered' ELSE 'replied' END AS outcome
FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'""")
def ref_ask_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ask is a user's turn, its reply the assistant's next one; an ask without one is an error row."""
    turns = read(spark, sf_dir, "conversations")
    asks = turns.filter("role = 'user'").select("conv_id", "turn")
    replies = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("reply_turn"))
    outcome = F.when(F.col("reply_turn").isNull(), "unanswered").otherwise("replied")
    return asks.join(replies, ["conv_id", "turn"], "left").select("conv_id", "turn", "reply_turn", outcome.alias("outcome"))
