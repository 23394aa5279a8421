"""Codec, frames and stores."""

from __future__ import annotations

import math
import random
import struct

import pytest

from strandlog.functions import hashing as h
from strandlog.functions import scalars as sc
from strandlog.operators.evolution import Chain
from strandlog.sources import codec, frames
from strandlog.sources.store import Fenced, LogStore

POD = ((1, "id", "uint"), (2, "qty", "uint"), (3, "delta", "int"), (4, "price", "double"), (5, "ok", "bool"))
LINE = ((1, "sku", "uint"), (2, "weight", "double"))
ORDER = ((1, "id", "uint"), (2, "customer", "string"), (3, "lines", [LINE]), (4, "notes", ["string"]))


def test_round_trip_is_exact():
    rng = random.Random(3)
    for _ in range(2000):
        bits = struct.unpack("<d", rng.randbytes(8))[0]
        record = {"id": rng.getrandbits(64), "qty": rng.getrandbits(32), "delta": rng.getrandbits(63) - (1 << 62), "price": bits, "ok": rng.random() < 0.5}
        back = codec.decode(POD, codec.encode(POD, record))
        assert struct.pack("<d", back.pop("price")) == struct.pack("<d", record.pop("price")) and back == record
    assert math.copysign(1, codec.decode(POD, codec.encode(POD, {"id": 0, "qty": 0, "delta": 0, "price": -0.0, "ok": False}))["price"]) == -1


def test_nested_and_sequences():
    record = {"id": 7, "customer": "a\0é", "lines": [{"sku": 1, "weight": 0.5}, {"sku": 2, "weight": 2.0}], "notes": ["", "x" * 300]}
    assert codec.decode(ORDER, codec.encode(ORDER, record)) == record


def test_unknown_fields_are_skipped_and_absent_ones_default():
    data = codec.encode(POD, {"id": 5, "qty": 1, "delta": -2, "price": 1.5, "ok": True})
    assert codec.decode(((1, "id", "uint"), (8, "more", "string"), (3, "delta", "int")), data) == {"id": 5, "more": "", "delta": -2}
    for cut in (1, 3, len(data) - 1):
        with pytest.raises(ValueError):
            codec.decode(POD, data[:cut] if cut != 3 else data[:2] + b"\xff" * 12)


def test_fingerprint_ignores_names_but_not_order():
    a = h.fingerprint([(1, "varint"), (2, "bytes")])
    assert a == h.fingerprint([(1, "varint"), (2, "bytes")]) != h.fingerprint([(2, "bytes"), (1, "varint")])


def test_frames_in_pieces_and_torn(spark, tmp_path):
    bodies = [bytes([i]) * (i * 100) for i in range(20)]
    data = b"".join(frames.frame(b) for b in bodies)
    for size in (1, 7, 1000):
        stream = frames.FrameStream()
        assert [b for i in range(0, len(data), size) for b in stream.feed(data[i : i + size])] == bodies
    with pytest.raises(frames.FrameError):
        list(frames.FrameStream().feed(b"\xff\xff\xff\xff"))
    frames.register(spark)
    folder = tmp_path / "wal"
    folder.mkdir()
    good = b"".join(frames.frame(b, True) for b in bodies)
    (folder / "a").write_bytes(good)
    (folder / "b").write_bytes(good[: len(good) // 2])
    (folder / "c").write_bytes(good[:-5] + b"wrong")
    rows = spark.read.format("frames").option("checked", True).load(str(folder)).groupBy("file").count().collect()
    found = {r["file"]: r["count"] for r in rows}
    assert found["a"] == 20 and found["c"] == 19 and 0 < found["b"] < 20
    stream = spark.readStream.format("frames").option("checked", True).load(str(folder))
    query = stream.writeStream.format("memory").queryName("wal").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("wal").count() == sum(found.values())


def test_store_conformance(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    actors = spark.createDataFrame([(1,), (2,)], "actor long")
    token = {r["actor"]: r["token"] for r in store.acquire(actors).collect()}
    assert token == {1: 1, 2: 1}
    schema = "actor long, seq long, token long, record string, amount long, pos long"
    store.append(spark.createDataFrame([(1, 1, 1, "event", 5, 0), (1, 2, 1, "event", 7, 1), (2, 9, 1, "event", 1, 0)], schema))
    with pytest.raises(ValueError):  # nothing of a bad batch stays
        store.append(spark.createDataFrame([(1, 4, 1, "event", 1, 0), (1, 3, 1, "event", 1, 1)], schema))
    store.acquire(actors.filter("actor = 1"))
    with pytest.raises(Fenced):
        store.append(spark.createDataFrame([(1, 5, 1, "event", 1, 0)], schema))
    store.append(spark.createDataFrame([(1, 3, 2, "event", 11, 0)], schema))
    assert [r["seq"] for r in store.events(2).filter("actor = 1").orderBy("seq").collect()] == [2, 3]
    snapshots = "actor long, at long, token long, through_seq long, balance long, applied long"
    store.save_snapshots(spark.createDataFrame([(1, 0, 2, 2, 12, 2), (1, 1, 2, 99, 0, 0), (2, 0, 0, 9, 0, 0)], snapshots))
    state = {r["actor"]: tuple(r)[1:] for r in store.recover().collect()}
    assert state == {1: (23, 3, 3), 2: (1, 1, 9)}


def test_reminder_conformance(spark, tmp_path):
    store, live = LogStore(spark, str(tmp_path / "a")), LogStore(spark, str(tmp_path / "b"))
    schema = "actor long, name string, arrival long, due_us long, period_us long, removed boolean"
    store.put_reminders(spark.createDataFrame([(1, "wake", 0, 1000, 0, False), (1, "beat", 1, 2000, 500, False), (2, "wake", 2, 3000, 0, False)], schema))
    store.put_reminders(spark.createDataFrame([(2, "wake", 3, 0, 0, True), (1, "wake", 4, 7000, 0, False)], schema))
    rows = {(r["actor"], r["name"]): r["due_us"] for r in store.reminders().collect()}
    assert rows == {(1, "wake"): 7000, (1, "beat"): 2000}
    store.compact_reminders(live)
    assert live.reminders().count() == 2


def test_boundaries_close_every_bucket(spark):
    from pyspark.sql import functions as F

    for spec in (sc.LATENCY_NS, sc.MAILBOX_DEPTH):
        bounds = sc.boundaries(*spec)
        assert bounds[-1] == (1 << 64) - 1 and bounds == sorted(bounds)
        values = sorted({v for b in bounds[:-1] for v in (b, b + 1)})
        frame = spark.createDataFrame([(v,) for v in values], "v long")
        for r in frame.select("v", sc.linear_log_bucket(F.col("v"), *spec).alias("b")).collect():
            assert r["b"] == next(i for i, upper in enumerate(bounds) if r["v"] <= upper)


def test_chain_rejects_gaps_and_unknown_versions(spark):
    with pytest.raises(ValueError):
        Chain({2: lambda d: d})
    with pytest.raises(ValueError):
        Chain({1: lambda d: d}).read({7: spark.range(1)})
