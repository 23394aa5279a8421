"""Records through the codec, and requests answered by streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.generators import ask_stream
from strandlog.model import LOG_SQL, cut, event_log, work_folder
from strandlog.operators import logs
from strandlog.sources import codec, frames
from strandlog.sources.store import LogStore

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
OLD = ((1, "actor", "uint"), (2, "seq", "uint"), (3, "amount", "int"), (4, "kind", "string"))
NEW = ((1, "actor", "uint"), (3, "amount", "int"), (4, "kind", "string"), (9, "priority", "uint"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {LOG_SQL} SELECT actor, amount, kind, 0::BIGINT AS priority FROM log")
def ref_tagged_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written with one schema and read with another: a field gone, and one that takes its default."""
    data = event_log(spark, sf_dir).select(codec.to_tagged(OLD).alias("data"))
    return data.select(codec.from_tagged("data", NEW).alias("r")).select("r.actor", "r.amount", "r.kind", "r.priority")


def _uleb(v: str) -> str:
    """Hexadecimal digits of a number below 2^28 in base-128 groups."""
    byte = lambda x: f"printf('%02x', {x})"
    parts = [f"CASE WHEN {v} >= {1 << 7 * k} OR {k} = 0 THEN {byte(f'CASE WHEN {v} >= {1 << 7 * (k + 1)} THEN 128 + (({v} >> {7 * k}) & 127) ELSE ({v} >> {7 * k}) & 127 END')} ELSE '' END" for k in range(4)]
    return "(" + " || ".join(parts) + ")"


@query(f"""WITH {LOG_SQL} SELECT seq, '08' || {_uleb('actor')} || '10' || {_uleb('seq')} || '18' || {_uleb('(amount * 2)')} || '22' || {_uleb('length(kind)')} || lower(hex(kind)) AS tagged,
'{{"actor":' || actor || ',"seq":' || seq || ',"amount":' || amount || ',"kind":"' || kind || '"}}' AS json, true AS same FROM log""")
def ref_serializers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records through two codecs, byte for byte, and back."""
    tagged, text = codec.Tagged(OLD), codec.Json(OLD)
    rows = event_log(spark, sf_dir).withColumn("t", tagged.encode()).withColumn("j", text.encode())
    same = tagged.decode("t") == text.decode("j")
    return rows.select("seq", F.lower(F.hex("t")).alias("tagged"), F.col("j").cast("string").alias("json"), same.alias("same"))


@query(f"""WITH {LOG_SQL} SELECT seq, i AS producer_seq, amount + i AS item, NULL::VARCHAR AS terminal FROM (SELECT *, unnest(range(least(seq % 6, 4))) AS i FROM log)
UNION ALL SELECT seq, NULL, NULL, CASE WHEN seq % 6 <= 4 THEN 'closed' ELSE 'cancelled' END FROM log""")
def ref_ask_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).select("seq", "amount", (F.col("seq") % 6).alias("n"))
    return ask_stream(rows, "amount", "n", 4).select("seq", "producer_seq", "item", "terminal")


@query(f"WITH {LOG_SQL} SELECT actor % 8 AS peer, seq, kind FROM log WHERE seq < 800 OR actor % 8 <> 5")
def ref_frame_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as checked frames, a file for each peer, read back as a source; the fifth peer's file is torn from its first
    message from 800 on."""
    folder, rows = work_folder(spark, "frames"), event_log(spark, sf_dir).withColumn("peer", F.col("actor") % 8)
    body = F.concat_ws(":", "seq", "kind").cast("binary")
    # a frame is torn where its body's checksum is one of something else
    torn = (F.col("peer") == 5) & (F.col("seq") >= 800)
    frames.write(rows.select("peer", "seq", body.alias("body"), torn.alias("torn")), folder, "peer", "seq")
    frames.register(spark)
    found = spark.read.format("frames").option("checked", "true").load(folder)
    parts = F.split(F.col("body").cast("string"), ":")
    return found.select(F.regexp_extract("file", r"-(\d+)\.", 1).cast("long").alias("peer"), parts[0].cast("long").alias("seq"), parts[1].alias("kind"))


@query(f"""WITH {LOG_SQL} SELECT actor, CAST(sum(amount) AS BIGINT) AS balance, count(*) AS applied, max(seq) AS last_seq FROM log GROUP BY actor""")
def ref_log_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Told messages are appended to a durable store in two batches by the actors' owners, with a snapshot between them;
    what the store recovers is the state after all of them. Each actor's batches part in the middle of its seqs, so the
    second has later ones alone, however seqs are spread."""
    store = LogStore(spark, work_folder(spark, "store"))
    log = event_log(spark, sf_dir)
    middle = log.groupBy("actor").agg(F.expr("min(seq) + (max(seq) - min(seq)) div 2").alias("middle"))
    tokens = cut(store.acquire(log.select("actor")).join(middle, "actor"), "owners")
    rows = log.join(tokens, "actor").select("actor", "seq", "token", F.lit("event").alias("record"), "amount", F.col("seq").alias("pos"), "middle")
    half = F.col("seq") <= F.col("middle")
    store.append(rows.filter(half))
    taken = logs.replay(store.events(), ["actor"]).join(tokens, "actor")
    store.save_snapshots(taken.select("actor", F.lit(0).cast("long").alias("at"), "token", F.col("last_seq").alias("through_seq"), "balance", "applied"))
    store.append(rows.filter(~half))
    return store.recover()
