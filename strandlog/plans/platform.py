"""Plain relational queries that the engine underneath supplies: joins, grouping sets, windows, set operations, functions.

Names begin with ``platform_`` as these are the platform's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.model import DAY, LOG_SQL, event_log, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _cents(column: str) -> F.Column:
    return F.floor(F.col(column) * 100).cast("long")


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, CAST(sum(CAST(floor(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum_price, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def platform_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").cast("long").alias("sum_qty"), F.sum(_cents("l_extendedprice")).alias("sum_price"), F.count("*").alias("n")
    )


@query("""SELECT n_name, count(*) AS orders, CAST(sum(CAST(floor(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def platform_inner_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("orders"), F.sum(_cents("o_totalprice")).alias("total"))


@query("""SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def platform_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("""SELECT coalesce(s_nationkey, c_nationkey) AS nation, s, c FROM (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY ALL) FULL JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_nationkey > 3 GROUP BY ALL) ON s_nationkey = c_nationkey""")
def platform_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("s"))
    c = read(spark, sf_dir, "customer").filter("c_nationkey > 3").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    return s.join(c, F.col("s_nationkey") == F.col("c_nationkey"), "full").select(F.coalesce("s_nationkey", "c_nationkey").alias("nation"), "s", "c")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def platform_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = read(spark, sf_dir, "orders").filter("o_totalprice > 200000")
    return read(spark, sf_dir, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 20 = 0)")
def platform_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").filter("o_orderkey % 20 = 0")
    return read(spark, sf_dir, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query(f"""WITH {LOG_SQL}, a AS (SELECT actor, seq, us FROM log WHERE kind = 'purchase'), b AS (SELECT actor, seq, us FROM log WHERE kind = 'error')
SELECT b.actor, b.seq, (SELECT max((a.us, a.seq)) FROM a WHERE a.actor = b.actor AND (a.us, a.seq) <= (b.us, b.seq))[2] AS purchase FROM b""")
def platform_as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error's last purchase: one window over both logs instead of a join by range."""
    w = Window.partitionBy("actor").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == "purchase", F.col("seq")), ignorenulls=True).over(w)
    rows = event_log(spark, sf_dir).filter("kind in ('purchase', 'error')").withColumn("purchase", last)
    return rows.filter("kind = 'error'").select("actor", "seq", "purchase")


@query(f"""WITH {LOG_SQL}, a AS (SELECT kind, seq, us FROM log WHERE kind = 'error'), b AS (SELECT us FROM log WHERE kind = 'purchase')
SELECT a.seq, count(*) AS purchases FROM a JOIN b ON b.us BETWEEN a.us - {DAY // 24} AND a.us GROUP BY a.seq""")
def platform_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of anybody in the hour before each error: an equi-join on hours, and then the range. Each error meets two
    hours, so neither side is compared with all of the other."""
    hour = DAY // 24
    log = event_log(spark, sf_dir)
    errors = log.filter("kind = 'error'").select("seq", F.col("us").alias("at"), F.explode(F.array(F.floor(F.col("us") / hour), F.floor(F.col("us") / hour) - 1)).alias("h"))
    bought = log.filter("kind = 'purchase'").select("us", F.floor(F.col("us") / hour).alias("h"))
    near = errors.join(bought, "h").filter(F.col("us").between(F.col("at") - hour, F.col("at")))
    return near.groupBy("seq").agg(F.count("*").alias("purchases"))


@query("""SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, CAST(grouping_id(l_returnflag, l_linestatus, l_linenumber) AS BIGINT) AS g
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus, l_linenumber), (l_linenumber), ())""")
def platform_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    flag, status, number = (F.col(f"l_{c}") for c in ("returnflag", "linestatus", "linenumber"))
    sets = rows.groupingSets([[flag, status], [status, number], [number], []], flag, status, number)
    return sets.agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("g"))


@query(f"""WITH {LOG_SQL}, c AS (SELECT actor, kind, count(*) AS n FROM log GROUP BY ALL)
SELECT actor, CAST(count(*) AS BIGINT) AS kinds, max(n) FILTER (WHERE kind = 'view') AS views, string_agg(kind, ',' ORDER BY kind) FILTER (WHERE n >= 3) AS often, CAST(sum(n * 2) AS BIGINT) AS doubled FROM c GROUP BY actor""")
def platform_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = event_log(spark, sf_dir).groupBy("actor", "kind").agg(F.count("*").alias("n"))
    rows = counts.groupBy("actor").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("m"))
    often = F.array_join(F.array_sort(F.map_keys(F.map_filter("m", lambda k, v: v >= 3))), ",")
    doubled = F.aggregate(F.map_values(F.transform_values("m", lambda k, v: v * 2)), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("actor", F.size("m").cast("long").alias("kinds"), F.try_element_at("m", F.lit("view")).alias("views"), F.nullif(often, F.lit("")).alias("often"), doubled.alias("doubled"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2 FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def platform_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus")
    return cube.agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("long").alias("g1"), F.grouping("l_linestatus").cast("long").alias("g2"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def platform_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, quantile_disc(event_id, 0.5) AS median FROM events GROUP BY event_type")
def platform_distinct_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id)").cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), median.alias("median"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS near FROM lineitem GROUP BY ALL")
def platform_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact number, and whether the approximate one is within a fifth of it."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("exact"), F.approx_count_distinct("l_partkey").alias("approx"))
    return rows.select("l_returnflag", "exact", (F.abs(F.col("approx") - F.col("exact")) <= F.col("exact") * 0.2).alias("near"))


@query(f"""WITH {LOG_SQL} SELECT seq, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY actor ORDER BY us, seq) AS quarter, lag(seq) OVER (PARTITION BY actor ORDER BY us, seq) AS before,
lead(seq) OVER (PARTITION BY actor ORDER BY us, seq) AS after FROM log WINDOW w AS (PARTITION BY actor ORDER BY amount // 1000)""")
def platform_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_time = Window.partitionBy("actor").orderBy("us", "seq")
    rows = event_log(spark, sf_dir).withColumn("k", F.floor(F.col("amount") / 1000))
    by_amount = Window.partitionBy("actor").orderBy("k")
    return rows.select(
        "seq", F.rank().over(by_amount).cast("long").alias("rank"), F.dense_rank().over(by_amount).cast("long").alias("dense"),
        F.ntile(4).over(by_time).cast("long").alias("quarter"), F.lag("seq").over(by_time).alias("before"), F.lead("seq").over(by_time).alias("after"),
    )


@query(f"""WITH {LOG_SQL} SELECT seq, CAST(sum(amount) OVER (PARTITION BY actor ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS BIGINT) AS day_sum,
CAST(sum(amount) OVER (PARTITION BY actor ORDER BY us, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_three FROM log""")
def platform_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = Window.partitionBy("actor").orderBy("us").rangeBetween(-DAY, 0)
    three = Window.partitionBy("actor").orderBy("us", "seq").rowsBetween(-2, 0)
    return event_log(spark, sf_dir).select("seq", F.sum("amount").over(day).alias("day_sum"), F.sum("amount").over(three).alias("last_three"))


@query("SELECT o_orderkey, CAST(floor(o_totalprice * 100) AS BIGINT) AS cents FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def platform_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", _cents("o_totalprice").alias("cents"))


@query("""(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def platform_union_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf_dir, "supplier").select("s_nationkey")
    return c.union(s).distinct().exceptAll(read(spark, sf_dir, "nation").filter("n_regionkey = 1").select("n_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def platform_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("""SELECT p_partkey, upper(p_brand) AS brand, length(p_name) AS n, split_part(p_type, ' ', 1) AS kind, substr(p_name, 2, 3) AS part, replace(p_name, 'a', 'A') AS swapped, p_name LIKE '%e%' AS has_e FROM part""")
def platform_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.split_part("p_type", F.lit(" "), F.lit(1))
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_brand").alias("brand"), F.length("p_name").cast("long").alias("n"), kind.alias("kind"),
        F.substring("p_name", 2, 3).alias("part"), F.replace("p_name", F.lit("a"), F.lit("A")).alias("swapped"), F.col("p_name").like("%e%").alias("has_e"),
    )


@query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, epoch_us(date_trunc('month', o_orderdate)) // 1000000 AS month_start, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') AS days FROM orders""")
def platform_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', date_trunc('month', o_orderdate)::timestamp_ntz)")
    days = F.datediff(F.lit("2000-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m"), start.alias("month_start"), days.cast("long").alias("days")
    )


@query("""SELECT o_custkey, len(list(o_orderkey)) AS n, list_sort(list(o_orderkey))[1] AS first, CAST(list_sum(list_transform(list(o_orderkey), lambda x: x % 10)) AS BIGINT) AS digits FROM orders GROUP BY o_custkey""")
def platform_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("k"))
    digits = F.aggregate(F.transform("k", lambda x: x % 10), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("o_custkey", F.size("k").cast("long").alias("n"), F.array_sort("k")[0].alias("first"), digits.alias("digits"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def platform_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k"))


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start, count(*) AS n FROM events GROUP BY ALL")
def platform_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', w.start)")
    return read(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("event_type", start.alias("start"), "n")


@query("""SELECT start, count(*) AS n FROM (SELECT unnest([epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) - 21600000000, epoch_us(time_bucket(INTERVAL 6 HOUR, ts))]) AS start FROM events) GROUP BY start""")
def platform_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', w.start)")
    return read(spark, sf_dir, "events").groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(start.alias("start"), "n")


@query(f"""WITH {LOG_SQL}, m AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY actor ORDER BY us, seq) >= {DAY // 4}, true) AS fresh FROM log),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY actor ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM m)
SELECT actor, min(us) AS start, count(*) AS n FROM s GROUP BY actor, session""")
def platform_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', w.start)")
    rows = read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select(F.col("user_id").alias("actor"), start.alias("start"), "n")
