"""Folds on literal logs, with deliberately wrong variants that must differ, and their streaming twins."""

from __future__ import annotations

import random
import time
from datetime import timedelta

import pytest

from strandlog.functions import hashing as h
from strandlog.operators import fanout, logs, security
from strandlog.operators import governance as g
from strandlog.operators.fold import KeyedFold, ordered_fold, with_lifecycle
from strandlog.operators.placement import bin_count, virtual_bins
from strandlog.plans.streams import QUERIES
from strandlog.streaming import fold_stream

S = 1_000_000


def run(spark, rows, fold, schema="k string, us long, seq long"):
    frame = spark.createDataFrame(rows, schema)
    return sorted(map(tuple, ordered_fold(frame, ["k"], ["us", "seq"], fold).collect()), key=lambda r: (r[0], r[1] if len(r) > 1 else 0))


def test_token_bucket_script(spark):
    times = [0] * 8 + [S // 2] * 8 + [101 * S] * 8
    rows = [("a", us, i) for i, us in enumerate(times)]
    out = [r[2] for r in run(spark, rows, g.token_bucket(5, 10))]
    assert [sum(out[i : i + 8]) for i in (0, 8, 16)] == [5, 5, 5]


def test_token_bucket_costs(spark):
    rows = [("a", 0, i, c) for i, c in enumerate((4, 4, 4, 2))]
    out = run(spark, rows, g.token_bucket(10, 0, "cost"), "k string, us long, seq long, cost long")
    assert [r[2] for r in out] == [True, True, False, True]


def test_backward_clock_refills_nothing():
    bucket = g.Bucket(1, 1)
    assert bucket.take(10 * S) and not bucket.take(5 * S) and not bucket.take(10 * S) and bucket.take(11 * S)


def test_fair_share_script(spark):
    rows = [("x", 0, i) for i in range(40)] + [("y", 0, 100 + i) for i in range(40)]
    out = run(spark, rows, g.fair_share({"x": 3, "y": 1}, 20, 40, "k"))
    assert sum(r[2] for r in out if r[0] == "x") == 30 and sum(r[2] for r in out if r[0] == "y") == 10
    with pytest.raises(ValueError):
        g.fair_share({"x": 0}, 1, 1)


def test_breaker_probes_once_it_may(spark):
    rows = [("a", t * S, t, t < 4) for t in range(20)]
    out = run(spark, rows, g.circuit_breaker(3, 5 * S), "k string, us long, seq long, failed boolean")
    sent = [r[1] for r in out if r[2]]
    assert sent == [0, 1, 2, *range(7, 20)]


def test_windows_start_anew_at_their_own_boundary(spark):
    """The restart budget needs more than the window to pass, the source cap exactly it."""
    rows = [("a", t * S, t) for t in (0, 1, 10)]
    assert [r[2] for r in run(spark, rows, g.restart_budget(1, 10 * S))] == [True, False, False]
    assert [r[2] for r in run(spark, rows, g.source_cap(1, 10 * S))] == [True, False, True]


def test_dead_is_final_and_order_matters(spark):
    schema = "k string, us long, seq long, status string, incarnation long"
    rows = [("n", 0, 0, "alive", 1), ("n", 1, 1, "suspect", 1), ("n", 2, 2, "alive", 1), ("n", 3, 3, "dead", 1), ("n", 4, 4, "alive", 9)]
    assert run(spark, rows, g.membership(), schema) == [("n", "dead", 1)]
    turned = [("n", 5 - r[1], *r[2:]) for r in rows]
    assert run(spark, turned, g.membership(), schema) != [("n", "dead", 1)]


def test_flap_back_cancels(spark):
    schema = "k string, us long, seq long, digest long"
    rows = [("r", t * S, t, d) for t, d in ((0, 1), (1, 2), (2, 1), (3, 2), (4, 2), (6, 2), (7, 2))]
    assert [r[1] for r in run(spark, rows, g.stabilise(3 * S), schema) if r[2]] == [6]


def test_reserve_lets_lower_bands_through(spark):
    rows = [("q", 0, i, 0 if i < 6 else 1) for i in range(8)]
    frame = spark.createDataFrame(rows, "k string, us long, seq long, band int")
    served = [r["seq"] for r in g.rotating_reserve(frame, ["k"], ["us", "seq"], 2, 3).orderBy("place").collect()]
    assert sorted(served) == list(range(8)) and served[2] == 0 + 2 and 6 in served[:6]
    drr = [r["seq"] for r in g.deficit_round_robin(frame, ["k"], ["us", "seq"], [2, 1]).orderBy("place").collect()]
    assert drr == list(range(8))  # each visit brings at least the one credit that it costs, so a band is served until it is empty
    with pytest.raises(ValueError):
        g.deficit_round_robin(frame, ["k"], ["us", "seq"], [1, 0])


def test_source_cap_after_a_spent_token(spark):
    """A's third escalation is rejected by its own cap, and yet has spent the token that B then lacks."""
    rows = [("s", "a", 0, 0), ("s", "a", 0, 1), ("s", "a", 0, 2), ("s", "b", 0, 3)]
    frame = spark.createDataFrame(rows, "v string, k string, us long, seq long")
    admitted = lambda *knobs: [(r["admitted"], r["deadline_us"]) for r in g.escalation_guard(frame, ["v"], ["k"], ["us", "seq"], *knobs).orderBy("seq").collect()]
    assert admitted(3.0, 1e-9, 2, S, 5) == [(True, 5), (True, 5), (False, 0), (False, 0)]
    assert admitted(9.0, 1e-9, 2, S, 0) == [(True, 0), (True, 0), (False, 0), (True, 0)]


def test_frames_wait_for_credit(spark):
    rows = [("p", 0, i) for i in range(5)]
    out = run(spark, rows, g.credit_channel(2, 10))
    assert [(r[2], r[3], r[4]) for r in out] == [(0, 10, False), (0, 20, False), (10, 30, True), (20, 40, True), (30, 50, True)]


def test_activations_end_by_idleness_and_fault(spark):
    rows = [("a", 0, 0, False), ("a", 5, 1, True), ("a", 6, 2, False), ("a", 99, 3, False)]
    count = KeyedFold(lambda: 0, lambda n, row: (n + 1, {"seq": row["seq"], "n": n + 1}), "seq long, n long")
    fold = with_lifecycle(count, lambda n: {"flushed": n}, "flushed long", "us", 10, "fault")
    out = run(spark, rows, fold, "k string, us long, seq long, fault boolean")
    assert [tuple(r)[2:] for r in out] == [(1, None, 0), (2, None, 0), (1, None, 1), (1, 1, 2)]


def test_places_over_ranges(spark):
    """A key with most rows is numbered and summed as by one window."""
    from pyspark.sql import functions as F

    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "b").when(F.col("id") == 7, None).otherwise("a").alias("k"), (F.col("id") * 7919 % 5000).alias("at"))
    got = {(r["k"], r["at"]): r["pos"] for r in logs.placed(rows, ["k"], ["at"]).collect()}
    assert got == {(r["k"], r["at"]): r["pos"] for r in logs.fifo_position(rows, ["k"], ["at"]).collect()}
    sums = {(r["k"], r["at"]): r["s"] for r in logs.placed(rows, ["k"], ["at"], "s", F.col("at")).collect()}
    assert sums == {(r["k"], r["at"]): r["total"] for r in logs.running_total(rows, ["k"], ["at"], "at").collect()}


def test_depths_of_any_chain(spark):
    """A chain of 300, an orphan with a child, a ring, and a second root."""
    spans = [(i, i - 1 if i else None) for i in range(300)] + [(1000, 999), (1001, 1000), (2000, 2001), (2001, 2000), (3000, None)]
    found = {r["span"]: r["depth"] for r in security.span_depths(spark.createDataFrame(spans, "span long, parent long")).collect()}
    assert found == {i: i for i in range(300)} | {3000: 0}


def test_interval_that_ends_before_it_starts(spark):
    messages = spark.createDataFrame([("t", us, us) for us in range(6)], "topic string, us long, seq long")
    subs = spark.createDataFrame([("t", 1, 3), ("t", 2, None), ("t", 4, 2), ("u", 0, None)], "topic string, since long, until long")
    assert {r["seq"]: r["reached"] for r in fanout.reached_during(messages, subs).collect()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 1}


def test_late_rows_are_dropped(spark, sf_dir):
    counted = QUERIES["platform_stream_windows"](spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    open_ = rows.groupBy().agg({"ts": "max"}).head()[0]
    closed = rows.filter(rows["ts"] < str(open_ - timedelta(days=2))).count()
    assert 0 < counted.agg({"n": "sum"}).head()[0] < closed


def test_idle_state_goes(spark, tmp_path):
    """After the timeout a key's state is gone, so that its fold starts anew."""
    schema, fold = "k string, us long, seq long", KeyedFold(lambda: 0, lambda n, row: (n + 1, {"seq": row["seq"], "n": n + 1}), "seq long, n long")

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = fold_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["k"], ["us", "seq"], fold, idle_ms=200)
        writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
        writer.start(str(tmp_path / "out")).awaitTermination(120)

    arrive([("a", 0, 0), ("a", 1, 1)])
    time.sleep(0.5)
    arrive([("b", 2, 2)])  # a batch in which the idle key times out
    arrive([("a", 3, 3)])
    assert {r["seq"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: 1, 1: 2, 2: 1, 3: 1}


def test_input_order_and_partitions_do_not_matter(spark):
    rows = [(str(i % 5), (i * 7919) % 1000 * S, i) for i in range(300)]
    expected = run(spark, rows, g.token_bucket(3, 0.01))
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, us long, seq long").repartition(7)
    got = sorted(map(tuple, ordered_fold(frame, ["k"], ["us", "seq"], g.token_bucket(3, 0.01)).collect()), key=lambda r: (r[0], r[1]))
    assert got == expected


def test_dedup_needs_the_order(spark):
    rows = spark.createDataFrame([("s", 0, 5), ("s", 1, 3), ("s", 2, 6), ("s", 3, 6)], "k string, at long, seq long")
    good = [r["accepted"] for r in logs.mark_duplicates(rows, ["k"], ["at"]).orderBy("at").collect()]
    wrong = [r["accepted"] for r in logs.mark_duplicates(rows, ["k"], ["seq", "at"]).orderBy("at").collect()]
    assert good == [True, False, True, False] and wrong != good
    first = spark.createDataFrame([("s", 0, 0)], "k string, at long, seq long")
    assert logs.mark_duplicates(first, ["k"], ["at"]).head()["accepted"] and not logs.mark_stale(first, ["k"], ["at"]).head()["accepted"]


def test_hashes_match_python(spark):
    from pyspark.sql import functions as F

    rows = spark.range(200).withColumn("b", F.col("id") * 7919 - 500)
    out = h.wrapped(rows, s=lambda: h.splitmix64(F.col("b")), c=lambda: h.hash_combine(F.col("id"), F.col("b"))).collect()
    for r in out:
        assert r["s"] == h.signed(h.py_splitmix64(r["b"] & (1 << 64) - 1))
        assert r["c"] == h.signed(h.py_hash_combine(r["id"], r["b"] & (1 << 64) - 1))
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    assert h.py_fnv1a(b"") == h.FNV_OFFSET and h.py_fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_bins_are_balanced(spark):
    ids = [i * 2654435761 + 101 for i in range(64)]
    loads = [r["n"] for r in virtual_bins(spark, ids, 256).groupBy("owner").count().withColumnRenamed("count", "n").collect()]
    mean = sum(loads) / 64
    assert bin_count(256) == 4096 and sum(loads) == 4096 and max(loads) / mean <= 1.5
    assert (sum((x - mean) ** 2 for x in loads) / 64) ** 0.5 / mean <= 0.2


def test_stream_folds_like_the_batch(spark, tmp_path):
    rows = [(str(i % 3), i * S, i) for i in range(60)]
    schema = "k string, us long, seq long"
    for part in range(4):
        spark.createDataFrame(rows[part * 15 : part * 15 + 15], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p*"))
    fold = g.token_bucket(2, 0.1)
    query = (
        fold_stream(stream, ["k"], ["us", "seq"], fold).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=lambda r: (r[0], r[1]))
    assert got == run(spark, rows, fold)


def test_fold_checks_its_parts():
    with pytest.raises(ValueError):
        KeyedFold(0, lambda s, r: (s, None), "x long")
