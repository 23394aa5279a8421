"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are byte n-grams (3 to 5) of the lower-case text in which everything but letters is a space; each hashes to
one of ``BUCKETS`` embeddings. A document is the mean of its subwords' embeddings and a softmax gives the languages.
Embeddings and weights are trained together by stochastic gradient descent in numpy. On part of the training rows that
the descent doesn't see, a temperature is fitted and the lowest score is found at which accepted rows are right in
``TARGET`` of cases; ``accepted`` says whether a row reaches it.

Whole texts are scored: embeddings times weights is one table of BUCKETS x languages, so a document costs a lookup for
each subword, and long texts are read in pieces of bounded size.

Training uses at most about ``MAX_PER_LANG`` rows of each language, chosen by hash, and of each at most
``TRAIN_CHARS`` characters from a hashed place. Edge cases: null texts and texts without letters are ``und`` with score
0; without any training rows all are ``und``; rows with null lang aren't learnt from; ties between languages go to the
first in order; repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import arrow_map, held_out, table

BUCKETS, DIM = 1 << 15, 16
ORDERS = (3, 4, 5)
MAX_PER_LANG, TRAIN_CHARS = 500, 400
EPOCHS, RATE, BATCH = 5, 2.0, 32
#: Few rows are gone through more often.
LEAST_STEPS = 300
TARGET = 0.99
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_SPACE = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 0x20 for b in range(256))
_PIECE = 1 << 20


def subwords(flat: bytes) -> np.ndarray:
    """(orders, len(flat)) buckets of the n-grams that start at each byte."""
    b = np.frombuffer(flat + b" " * max(ORDERS), np.uint8).astype(np.uint32)
    n, out, h = len(flat), np.empty((len(ORDERS), len(flat)), np.uint32), None
    h = np.full(n, 2166136261, np.uint32)
    for k in range(max(ORDERS)):
        h = (h ^ b[k : k + n]) * np.uint32(16777619)
        if k + 1 in ORDERS:
            g = h ^ (h >> np.uint32(15))
            out[ORDERS.index(k + 1)] = (g * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return out


def prepare(text: str) -> bytes:
    return b" " + re.sub(rb" +", b" ", text.lower().encode().translate(_SPACE))


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # BUCKETS x langs
    bias: np.ndarray
    temperature: float
    least: float

    def mean_logits(self, docs: list[bytes]) -> np.ndarray:
        out = np.zeros((len(docs), len(self.langs)))
        for i, doc in enumerate(docs):
            for lo in range(0, len(doc), _PIECE):  # an n-gram may reach beyond its piece, so that one is cut
                part = subwords(doc[lo : lo + _PIECE + max(ORDERS)])[:, :_PIECE]
                counts = np.bincount(part.ravel(), minlength=BUCKETS) if part.size > BUCKETS else None
                out[i] += counts @ self.logits if counts is not None else self.logits[part.ravel()].sum(axis=0)
            out[i] /= max(1, len(ORDERS) * len(doc))
        return out + self.bias

    def probabilities(self, docs: list[bytes]) -> np.ndarray:
        z = self.mean_logits(docs) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 0) -> Model | None:
    """Train on (text, lang) pairs; every tenth calibrates."""
    rows = sorted({(t, x) for t, x in rows if t and _LETTER.search(t)})
    if not rows:
        return None
    langs = sorted({x for _, x in rows})
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held, seen = rows[::10], [r for i, r in enumerate(rows) if i % 10] or rows
    y = np.array([langs.index(x) for _, x in seen])
    grams = [subwords(prepare(t)).ravel().astype(np.int64) for t, _ in seen]
    emb = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
    w, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    w += (rng.standard_normal(w.shape) * 0.1).astype(np.float32)
    each = -(-len(seen) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // each))
    steps, done = epochs * each, 0
    for _ in range(epochs):
        order = rng.permutation(len(seen))
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            flat = np.concatenate([grams[i] for i in own])
            sizes = np.array([len(grams[i]) for i in own])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            mean = np.add.reduceat(emb[flat], starts, axis=0) / sizes[:, None]
            z = mean @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p /= len(own)
            back = (p @ w.T / sizes[:, None]).astype(np.float32)
            w -= rate * (mean.T @ p).astype(np.float32)
            bias -= rate * p.sum(axis=0).astype(np.float32)
            # subwords repeat within a batch, so their gradients are summed before the step
            keys, at = np.unique(flat, return_inverse=True)
            who = np.repeat(np.arange(len(own)), sizes)
            weight = np.bincount(at * len(own) + who, minlength=len(keys) * len(own)).reshape(len(keys), len(own))
            emb[keys] -= rate * 10 * (weight.astype(np.float32) @ back)
    model = Model(langs, emb @ w, bias, 1.0, 0.0)
    docs, truth = [prepare(t) for t, _ in held], np.array([langs.index(x) for _, x in held])
    z = model.mean_logits(docs)

    def loss(temperature: float) -> float:
        s = z / temperature
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]))

    model.temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    p = model.probabilities(docs)
    top, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-top)
    good = np.flatnonzero(np.cumsum(right[order]) >= TARGET * np.arange(1, len(order) + 1))
    model.least = float(top[order][good[-1]]) if len(good) else 1.0
    return model


def train(docs: DataFrame, most: int = MAX_PER_LANG) -> Model | None:
    usable = docs.select("doc_id", "text", "lang").filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id", 4, 2)
    )
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, most / n))).otherwise(share)
    h = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30))
    place = F.lit(1) + F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0)) + 1).cast("int")
    chosen = usable.filter(h < share * (1 << 30)).select(F.substring("text", place, F.lit(TRAIN_CHARS)).alias("t"), "lang")
    return fit([(r["t"], r["lang"]) for r in chosen.collect()])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(t: pa.Table) -> pa.Table:
            one, found = sent.value, [x or "" for x in t["text"].to_pylist()]
            known = [i for i, x in enumerate(found) if one is not None and _LETTER.search(x)]
            lang, score = [UNKNOWN] * len(found), [0.0] * len(found)
            if known:
                p = one.probabilities([prepare(found[i]) for i in known])
                for i, k, s in zip(known, p.argmax(axis=1), p.max(axis=1), strict=True):
                    lang[i], score[i] = one.langs[k], float(s)
            return pa.table(
                {
                    "doc_id": t["doc_id"],
                    "held_out": t["held_out"],
                    "lang_pred": pa.array(lang, pa.string()),
                    "score": pa.array(score, pa.float64()),
                    "accepted": pa.array([x != UNKNOWN and s >= one.least for x, s in zip(lang, score, strict=True)]),
                }
            )

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 4, 2).alias("held_out"), "text")
    return arrow_map(rows, make, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))


QUERY = {"op6_subword_language_id": query}
ORACLE: dict[str, str] = {}
