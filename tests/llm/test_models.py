"""Classifiers, language model, search, archives and the pipeline: held-out figures, brute force, round trips, odd rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from conftest import canonical, tables
from pyspark.sql import functions as F

from strandlog.llm import common, decontamination, language_id, language_model, multi_index, quality, warc

ODD = [
    (1, "Plain words and a few more of them here.", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, "123 !!! 456", None, "s"),
    (5, "mot " * 30_000, "fr", "s"), (5, "mot " * 30_000, "fr", "s"), (None, "ohne Nummer", "de", None), (7, "\t \n", "en", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "extra", 1.0) for r in ODD], SCHEMA + ", score string, held_out double").cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(doc_id, modulus: int) -> int:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % modulus


# --- quality ---------------------------------------------------------------------------------------------------------


LARGER = "/root/testdata/sf0.01"  # the smallest tables hold out only some twenty labels


def test_quality_on_held_out_labels(spark):
    sf_dir = LARGER
    rows = quality.query(spark, sf_dir).toPandas().merge(common.table(spark, sf_dir, "labels").toPandas(), on="doc_id")
    assert (rows["held_out"] == rows["doc_id"].map(lambda i: crc(i, 5) == 0)).all()
    assert ((rows["score"] >= 0.3) == (rows["predicted"] == 1)).all() and rows["score"].between(0, 1).all()
    held = rows[rows["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.9


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    rng = np.random.default_rng(0)
    words = [" ".join(rng.choice(["ab", "cde", "f"], 50)) + ("!!! " * 20 if i % 2 else "") for i in range(40)]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    model = quality.train(docs, labels)
    assert isinstance(model, quality.Discriminant)
    assert quality.score(odd, model).count() == len(ODD) and quality.keep_good(odd, model).columns == odd.columns
    empty = quality.train(none, labels)
    assert quality.score(none, empty).count() == 0
    assert {r["score"] for r in quality.score(odd, empty).collect()} == {1.0}


@pytest.mark.parametrize("good, bad", [(1, 1), (1, 9), (3, 30), (30, 2)])
def test_few_labels_still_make_a_discriminant(good, bad):
    rng = np.random.default_rng(7)
    draw = lambda n, at: rng.normal(at, 0.3, (n, quality.N_STATS))
    model = quality.fit(np.concatenate((draw(good, 1), draw(bad, -1))), np.repeat([1, 0], [good, bad]))
    assert isinstance(model, quality.Discriminant)
    assert (model.score(draw(50, 1)) >= quality.THRESHOLD).all() and (model.score(draw(50, -1)) < quality.THRESHOLD).all()


def test_without_a_model_all_documents_stay(odd):
    model = quality.fit(np.zeros((9, quality.N_STATS)), np.zeros(9, dtype=int))
    assert quality.keep_good(odd, model).count() == len(ODD)


def test_discriminant_is_bayes_rule_for_normal_classes():
    """With little shrinkage, differences are those of the true log densities."""
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, (4000, 2)), rng.normal(0, 1, (4000, 2)) @ np.array([[2.0, 0.5], [0, 1.0]]) + 1
    x, y = np.concatenate((a, b)), np.repeat([0, 1], 4000)
    model = quality._fit(x, y, 0.0, 0.0)
    cov = np.array([[2.0, 0.5], [0, 1.0]]).T @ np.array([[2.0, 0.5], [0, 1.0]])
    z = rng.normal(0, 1.5, (50, 2))
    true = -0.5 * np.einsum("ij,jk,ik->i", z - 1, np.linalg.inv(cov), z - 1) - 0.5 * np.log(np.linalg.det(cov)) + 0.5 * (z**2).sum(axis=1)
    assert np.abs(model.difference(z) - true).max() < 0.6


# --- languages -------------------------------------------------------------------------------------------------------


def test_languages_on_held_out_rows(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "lang").toPandas()
    rows = language_id.query(spark, sf_dir).toPandas().merge(docs, on="doc_id")
    assert (rows["held_out"] == rows["doc_id"].map(lambda i: crc(i, 4) == 2)).all()
    held = rows[rows["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95 and held["score"].between(0, 1).all()
    sure = held[held["accepted"]]
    assert len(sure) > 0.5 * len(held) and (sure["lang_pred"] == sure["lang"]).mean() >= (held["lang_pred"] == held["lang"]).mean()


def test_languages_of_odd_rows(odd, none):
    model = language_id.fit([("the words of it", "en"), ("les mots de la", "fr")] * 20)
    rows = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (2, 3, 4, 7)) and rows[1]["lang_pred"] != "und"
    assert language_id.train(none) is None and language_id.predict(none, None).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(odd, None).collect()} == {"und"}


def test_long_texts_in_pieces_score_as_whole(monkeypatch):
    model = language_id.fit([("the words of it", "en"), ("les mots de la", "fr")] * 20)
    docs = [language_id.prepare("les mots " * 5000)]
    whole = model.mean_logits(docs)
    monkeypatch.setattr(language_id, "_PIECE", 1000)
    assert np.allclose(model.mean_logits(docs), whole)


# --- language model --------------------------------------------------------------------------------------------------


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def check_base(docs, rows):
    train = Counter(t for i, x in docs if crc(i, 7) != 2 for t in tokens(x))
    total, kinds = sum(train.values()), len(train)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]), r) for r in rows)
    want = sorted(((i is None, i or 0, len(tokens(x))), x) for i, x in docs)
    for (_, r), ((_, i, n), x) in zip(got, want, strict=True):
        own = tokens(x)
        assert r["n_tokens"] == n == len(own) and r["n_known"] == sum(t in train for t in own) and r["train_tokens"] == total
        assert r["held_out"] == (crc(r["doc_id"], 7) == 2)
        assert math.isclose(r["base_score"], sum(math.log10((train[t] + 1) / (total + kinds + 1)) for t in own), rel_tol=1e-9, abs_tol=1e-6)
        assert r["score"] <= 1e-9


def test_base_and_model_scores(spark, sf_dir):
    docs = [tuple(r) for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    rows = language_model.query(spark, sf_dir).collect()
    check_base(docs, rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_of_odd_rows(odd, none):
    rows = language_model.score(odd).collect()
    check_base([r[:2] for r in ODD], rows)
    assert language_model.score(none).count() == 0


def test_small_head_gives_the_same(spark, sf_dir, monkeypatch):
    """With nearly all counts joined by shuffle instead of sent, the base stays."""
    docs = common.table(spark, sf_dir, "documents").limit(60)
    monkeypatch.setattr(language_model, "HEAD", 30)
    check_base([tuple(r) for r in docs.select("doc_id", "text").collect()], language_model.score(docs).collect())


def _network():
    rng = np.random.default_rng(2)
    words = language_model.Vocabulary(np.sort(rng.integers(1, 1 << 60, 80)).astype(np.uint64), np.sort(rng.integers(1, 99, 80))[::-1].copy(), 9000, 200, 50)
    net = language_model.Network(words)
    net.train([rng.integers(0, words.size + 5, 40) for _ in range(60)], epochs=1)
    return words, net


def test_outputs_are_a_distribution():
    words, net = _network()
    hs = np.random.default_rng(0).normal(size=(1, language_model.HIDDEN)).astype(np.float32)
    all_targets = np.arange(words.size + 2)  # all words, the end, and one rare, whose class holds the rest
    logs, _ = net.log_outputs(np.repeat(hs, len(all_targets), axis=0), all_targets)
    assert abs(np.exp(logs).sum() - 1) < 1e-4


def test_lockstep_is_step_by_step(monkeypatch):
    words, net = _network()
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, words.size + 9, n) for n in (1, 5, 64, 33, 200, 7)]
    got = net.score(docs)
    for d, s in zip(docs, got, strict=True):
        h, before, total = np.zeros((1, language_model.HIDDEN), np.float32), net.size, 0.0
        for t in d:
            h = net.step(net.p["in"][[before]] + net.p["bias"], h)[0]
            total += net.log_outputs(h, np.array([t]))[0][0]
            before = t
        assert math.isclose(total / math.log(10), s, rel_tol=1e-4)
    monkeypatch.setattr(language_model, "LOCKSTEP", 2)
    monkeypatch.setattr(language_model, "WINDOW", 5)
    assert np.allclose(net.score(docs), got, rtol=1e-4)


def test_hashes_are_found_where_a_search_finds_them():
    rng = np.random.default_rng(8)
    top = (1 << 64) - 1
    for n in (1, 2, 3, 1000):
        spread = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        for held in (spread, spread >> np.uint64(40), np.unique(np.append(spread, np.array([0, top], np.uint64)))):
            held = np.unique(held)
            wanted = np.concatenate((held, held + np.uint64(1), held - np.uint64(1), rng.integers(0, top, 500, dtype=np.uint64, endpoint=True)))
            assert (language_model._Index(held).places(wanted) == np.searchsorted(held, wanted)).all()
    hashes = np.unique(rng.integers(0, top, 5000, dtype=np.uint64))
    words = language_model.Vocabulary(hashes, rng.integers(1, 99, len(hashes)), 250_000, 9000, 50)
    symbols, counts = words.look_up(np.append(hashes, hashes[:99] + np.uint64(1)))
    assert (counts[:-99] == words.counts).all() and (counts[-99:] == -1).all()
    assert (np.sort(symbols[symbols < words.size]) == np.arange(words.size)).all()


@pytest.mark.parametrize("safe", [40, 0])
def test_outputs_of_some_cases_at_once_are_those_of_all(monkeypatch, safe):
    words, net = _network()
    rng = np.random.default_rng(9)
    hs, targets = np.tanh(rng.normal(size=(500, language_model.HIDDEN))).astype(np.float32), rng.integers(0, words.size + 5, 500)
    monkeypatch.setattr(language_model, "SAFE", safe)
    results = []
    for cases in (1000, 7):
        monkeypatch.setattr(language_model, "CASES", cases)
        grad = {}
        results.append((*net.log_outputs(hs, targets, grad), *(grad[k] for k in ("class", "class_bias", "word", "word_bias"))))
    assert all(np.allclose(x, y, rtol=1e-3, atol=1e-4) for x, y in zip(*results, strict=True))
    assert all(grad[k].shape == net.p[k].shape for k in grad)


def test_all_training_rows_train_the_network(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").repartition(3)
    ends = sum(crc(r["doc_id"], 7) != 2 for r in docs.select("doc_id").collect())
    words, _ = language_model.vocabulary(language_model.count_tokens(docs), ends)
    assert language_model.fit(docs, words).tokens == words.total


def test_streams_cover_whole_documents(monkeypatch):
    monkeypatch.setattr(language_model, "DEALT", 5000)
    _, net = _network()
    rng = np.random.default_rng(5)
    docs = [np.append(rng.integers(0, net.size, n), net.size) for n in (0, 3000, *rng.integers(0, 90, 300))]
    want = Counter(x for d in docs for x in zip([net.size, *d[:-1].tolist()], d.tolist(), strict=True))
    got = Counter()
    for before, targets, _, real in net._windows(iter(docs)):
        got.update(zip(before[real].tolist(), targets[real].tolist(), strict=True))
    assert got == want


def test_vocabulary_grows_with_the_corpus():
    hashes, counts = np.arange(1, 20001, dtype=np.uint64), np.full(20000, 5)
    few, many = (language_model.Vocabulary(hashes, counts, total, 20001, 10) for total in (100_010, 500_000_010))
    assert few.size == 992 and many.size > 8000 and sum(many.members) == many.size and max(many.members) == many.per_class


def test_gradients(monkeypatch):
    """Backpropagation against differences of the loss."""
    words, net = _network()
    rng = np.random.default_rng(4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    seq = rng.integers(0, words.size + 5, (3, 6))
    before = np.concatenate((np.full((3, 1), net.size), seq[:, :-1]), axis=1)

    def loss():
        h, total = np.zeros((3, language_model.HIDDEN)), 0.0
        for t in range(6):
            h = np.where((before[:, t] == net.size)[:, None], 0, h)
            h = net.step(net.p["in"][before[:, t]] + net.p["bias"], h)[0]
            total -= net.log_outputs(h, seq[:, t])[0].sum()
        return total

    found = {}
    monkeypatch.setattr(language_model, "RATE", 0.0)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    net._update(before, seq, np.zeros((3, language_model.HIDDEN)), moments, 1, 1)
    for name in ("state", "in", "class", "bias"):
        m = moments[name][0] / 0.1  # the gradient up to one scale for all
        flat = np.argsort(-np.abs(m).ravel())[:3]
        for k in flat:
            at = np.unravel_index(k, m.shape)
            keep, eps = net.p[name][at], 1e-5
            net.p[name][at] = keep + eps
            up = loss()
            net.p[name][at] = keep - eps
            down = loss()
            net.p[name][at] = keep
            found[name, k] = (up - down) / (2 * eps) / m[at]
    ratios = np.array(list(found.values()))
    assert np.abs(ratios / ratios[0] - 1).max() < 1e-3


# --- search ----------------------------------------------------------------------------------------------------------


def brute_search(t, every, k):
    t = t.sort_values("vec_id")
    x, ids, out = np.stack(t["embedding"]).astype(np.float32).astype(float), t["vec_id"].to_numpy(), {}
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        out[int(ids[q])] = [int(ids[i]) for i in np.lexsort((ids, -s)) if i != q][:k]
    return out


def nearest(frame):
    rows = frame.toPandas().sort_values("rank")
    assert all(g["rank"].tolist() == list(range(1, len(g) + 1)) and (np.diff(g["score"]) <= 0).all() for _, g in rows.groupby("query_id"))
    return rows.groupby("query_id")["vec_id"].apply(list).to_dict()


def test_recall(spark, sf_dir):
    expected = brute_search(common.table(spark, sf_dir, "embeddings").toPandas(), 20, 20)
    got = nearest(multi_index.query(spark, sf_dir))
    assert set(got) == set(expected) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(expected[q])) / 20 for q in expected]) >= 0.9


def test_full_visit_is_exact_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 6)).astype(np.float32)
    rows = [(i, base[i].tolist()) for i in range(120)] + [(1000 + i, base[0].tolist()) for i in range(70)]
    frame = pd.DataFrame(rows, columns=["vec_id", "embedding"])
    bad = [(2000, None), (2020, [0.0] * 6), (2040, [float("nan")] * 6), (2060, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2080, [1.0] * 3), (None, [1.0] * 6), (2100, [float("inf")] * 6)]
    table = spark.createDataFrame(rows + bad + rows[:5], "vec_id long, embedding array<float>")
    for name in ("v", "rep", "rank", "cell", "shelf", "score", "query_id"):  # columns that clash with working ones
        table = table.withColumn(name, F.lit("x"))
    got = nearest(multi_index.search(table, target=1.0))
    expected = brute_search(frame, 20, 20)
    assert got == expected
    few = spark.createDataFrame(rows[:3] + bad, "vec_id long, embedding array<float>")
    assert {q: sorted(v) for q, v in nearest(multi_index.search(few)).items()} == {0: [1, 2]}
    assert multi_index.search(few.limit(0)).count() == 0


def test_walk_is_in_order_of_summed_distance():
    rng = np.random.default_rng(6)
    index = multi_index.MultiIndex(rng.normal(size=(7, 3)), rng.normal(size=(5, 4)), 3.0)
    q = rng.normal(size=6)
    a, b = index.halves(q[None], query=True)
    sums = (multi_index._distances(a, index.first)[0][:, None] + multi_index._distances(b, index.second)[0][None, :]).ravel()
    walked = list(index.walk(q))
    index.counts = np.ones(35, np.int64)
    cells, limit = index.visit(q, 11)
    assert cells.tolist() == walked[:11] and set(np.flatnonzero(index.sums(q[None], np.arange(35))[0] <= limit)) == set(cells)
    assert sorted(walked) == list(range(35)) and (np.diff(sums[walked]) >= -1e-12).all()


def test_shelves_split_large_cells(monkeypatch):
    monkeypatch.setattr(multi_index, "SHELF", 10)
    first, parts = multi_index._shelves(np.array([4, 5, 3, 35, 0, 10, 1]))
    assert parts == [1, 1, 1, 4, 1, 1, 1] and first[0] == first[1] != first[2] and first[5] >= first[3] + 4


# --- archives --------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark, sf_dir):
    expected = tables(sf_dir).sql(warc.ORACLE["op4_warc_index_first"]).df()
    assert canonical(warc.query(spark, sf_dir).toPandas()) == canonical(expected)


@pytest.mark.parametrize("broadcast_rows", [warc.BROADCAST_ROWS, 0])
def test_revisits_and_odd_pages(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast_rows)
    big, small = "é" * 600, "x" * 900
    rows = [(1, "http://a/\r\nEvil: x", big), (2, None, big), (9, "u", big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "y" * 300_000), (7, "u", "y" * 300_000)]
    folder = common.new_folder(spark, "warc-test")
    index = warc.write(spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string"), folder)
    got = {r["page_id"]: r for r in warc.read(index, folder).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items() if k in (1, 2, 9, None)} == {1: ("revisit", 9), 2: ("revisit", 9), 9: ("response", None), None: ("revisit", 9)}
    assert all(got[k]["record_type"] == "response" for k in (3, 4, 5, 6, 7)) and got[1]["payload_bytes"] == 1200 and got[5]["payload_bytes"] == 0
    assert warc.read(index.filter("page_id = 7"), folder).count() == 2
    nothing = warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read(nothing, folder).count() == 0


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, sf_dir):
    import corpus_pipeline
    from test_text_operators import brute_links, brute_scan, check_packing

    docs = common.table(spark, sf_dir, "documents")
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    good = {r["doc_id"] for r in quality.score(docs, model).filter("predicted = 1").collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect() if r["doc_id"] in good]
    first = {i: c for i, c, _ in brute_links(rows)}
    rows = [r for r in rows if first[r[0]] == r[0]]
    items = [tuple(r) for r in common.table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute_scan(rows, items) if r[5]}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = common.cut(stage(spark, kept, sf_dir), name)
        assert kept.columns == docs.columns and kept.count() <= before.count()
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r[0] for r in rows} - dirty
    assert not kept.filter("text like '%AKIA%' or text like '%password=%' and text not like '%password=[SECRET]%'").count()
    check_packing(kept, corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir))
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.select("doc_id").distinct().count() == kept.count()
    assert decontamination.scan(kept, common.table(spark, sf_dir, "benchmark")).filter("contaminated").count() == 0


def test_all_are_returned_where_there_are_few(spark):
    """However little calibration asks for, a result is full or has every candidate."""
    rng = np.random.default_rng(8)
    for n in (2, 12, 21, 60):
        rows = [(20 * i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(n)]
        got = nearest(multi_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), target=0.05))
        assert set(got) == {20 * i for i in range(n)} and all(len(set(v)) == min(20, n - 1) for v in got.values())


# --- brute force -----------------------------------------------------------------------------------------------------


def test_languages_match_brute_force(spark, sf_dir):
    """Every n-gram hashed by itself, with the fold of each row from its id."""
    docs = common.table(spark, sf_dir, "documents").limit(60)
    model = language_id.train(common.table(spark, sf_dir, "documents"))

    def bucket(gram):
        h = 2166136261
        for b in gram:
            h = (h ^ b) * 16777619 % 2**32
        return (h ^ h >> 15) * 2654435761 % 2**32 >> 32 - 15

    got = {(r["doc_id"], r["held_out"]): r for r in language_id.predict(docs, model).collect()}
    for r in docs.collect():
        row = got[r["doc_id"], zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        flat = b" " + re.sub(rb" +", b" ", bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in r["text"].lower().encode()))
        grams = [bucket((flat + b" " * 5)[i : i + n]) for n in (3, 4, 5) for i in range(len(flat))]
        z = (sum(model.logits[g].astype(float) for g in grams) / len(grams) + model.bias) / model.temperature
        e = np.exp(z - z.max())
        assert row["lang_pred"] == model.langs[int(z.argmax())] and abs(row["score"] - e.max() / e.sum()) < 1e-4


def test_quality_matches_brute_force(spark, sf_dir):
    """Folds from the ids, and Mahalanobis distances from covariances instead of their factors."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.query(spark, sf_dir).collect()}
    for r in docs.collect():
        z = (quality.statistics([(r["text"] or "").encode()])[0] - model.centre) / model.scale
        logs = [o - 0.5 * float((z - m) @ np.linalg.solve(np.linalg.inv(f) @ np.linalg.inv(f).T, z - m)) for m, f, o in zip(model.means, model.factors, model.offsets, strict=True)]
        score = 1 / (1 + math.exp(-max(-500, min(500, model.line[0] * (logs[1] - logs[0]) + model.line[1]))))
        row = got[r["doc_id"]]
        assert row["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and abs(row["score"] - score) < 1e-6
        assert row["predicted"] == int(row["score"] >= 0.3)
