"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Statistics of the whole text are transformed (logarithms of counts, arcsine roots of shares) and standardised. Each
class has a mean and a covariance, shrunk towards the pooled one and towards a multiple of the identity by amounts
chosen on held-out folds. The score is the difference of the classes' Mahalanobis log densities, from Cholesky factors
computed once, mapped to a probability by a line fitted on out-of-fold differences.

Labels are read from at most ``MAX_LABELS`` rows, those with the smallest hash of their id; everything else covers all
rows. Edge cases: null and empty texts have the statistics of an empty text; null labels aren't learnt from; with fewer
than ``FOLDED`` labels of a class, too few for folds, both have the pooled covariance, strongly rounded, and the score is
Bayes' rule; with labels of one class, or none, there is no model: the score is the share of good labels (1 without
labels), and ``keep_good`` keeps all; a score equal to the threshold is kept; texts of any length are read whole; labels that
tie in the order of hashes go by id; repeated documents score alike; other columns pass through ``keep_good`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import SPACED, arrow_map, held_out, table, texts, word_hashes

MAX_LABELS = 20_000
THRESHOLD = 0.3
N_STATS = 12
FOLDED = 4
_GROUPS = np.zeros((256, 6))
for _b in range(256):
    _c = chr(_b)
    _GROUPS[_b] = (
        65 <= _b <= 90,
        97 <= _b <= 122 or _b >= 192,
        48 <= _b <= 57,
        _c in ".,;:?\"'()-",
        _c in "!#$%&*+/<=>@[\\]^_`{|}~" or (_b < 32 and _c not in "\t\n\r"),
        _c in " \t\n\r",
    )


def statistics(docs: list[bytes]) -> np.ndarray:
    """One row of transformed statistics for each text."""
    out = np.zeros((len(docs), N_STATS))
    hashes, at = word_hashes(docs, SPACED)
    share = lambda x, n: np.arcsin(np.sqrt(min(1.0, x / n))) if n else 0.0
    for i, doc in enumerate(docs):
        h = hashes[at[i] : at[i + 1]]
        n = len(h)
        upper, lower, digits, marks, symbols, blank = np.bincount(
            np.frombuffer(doc, np.uint8), minlength=256
        ) @ _GROUPS if doc else np.zeros(6)
        lines = doc.split(b"\n")
        times = np.unique(h, return_counts=True)[1]
        out[i] = (
            np.log1p(n),
            np.log1p((upper + lower) / n) if n else 0.0,
            share(upper, upper + lower),
            share(digits, len(doc)),
            share(marks, len(doc)),
            share(symbols, len(doc)),
            share(blank, len(doc)),
            share(len(times), n),
            share(int((h[1:] == h[:-1]).sum()), n),
            share(len(lines) - len(set(lines)), len(lines)),
            share(times.max() if n else 0, n),
            np.log1p(len(doc) / len(lines)),
        )
    return out


@dataclass
class Discriminant:
    """Class means with cached inverse Cholesky factors; ``line`` maps log-density differences to probabilities."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    line: tuple[float, float]

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        logs = [
            o - 0.5 * np.square((z - m) @ f.T).sum(axis=1)
            for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)
        ]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b = self.line
        return 1 / (1 + np.exp(-np.clip(a * np.clip(self.difference(x), -1e4, 1e4) + b, -500, 500)))


@dataclass
class Constant:
    value: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def _fit(x: np.ndarray, y: np.ndarray, to_pooled: float, to_round: float) -> Discriminant:
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, d = (x - centre) / scale, x.shape[1]
    parts = [z[y == k] for k in (0, 1)]
    means = [p.mean(axis=0) for p in parts]
    each = [(p - m).T @ (p - m) / max(1, len(p)) for p, m in zip(parts, means, strict=True)]
    pooled = sum(len(p) * c for p, c in zip(parts, each, strict=True)) / len(z)
    factors, offsets = [], []
    for p, c in zip(parts, each, strict=True):
        c = (1 - to_pooled) * c + to_pooled * pooled
        c = (1 - to_round) * c + to_round * max(np.trace(c) / d, 1e-3) * np.eye(d) + 1e-6 * np.eye(d)
        root = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(root))
        offsets.append(float(np.log(len(p) / len(z)) - np.log(np.diag(root)).sum()))
    return Discriminant(centre, scale, means, factors, offsets, (1.0, 0.0))


def _line(diff: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number, by Newton steps with a small ridge; the slope stays positive."""
    size = np.abs(diff).mean() + 1e-9
    t, w = np.clip(diff / size, -20, 20), np.array([1.0, 0.0])
    design = np.stack([t, np.ones_like(t)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 1e-2 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return max(1e-3, float(w[0])) / size, float(w[1])


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant | Constant:
    """``x``: rows of ``statistics``; ``y``: 0 or 1."""
    fewest = min((y == 0).sum(), (y == 1).sum())
    if fewest == 0:
        return Constant(float(y.mean()) if len(y) else 1.0)
    if fewest < FOLDED:
        return _fit(x, y, 1.0, 0.4)
    fold = np.zeros(len(y), dtype=int)
    for k in (0, 1):  # each class is dealt to all folds
        fold[y == k] = np.arange((y == k).sum()) % 2
    best = None
    for to_pooled in (0.02, 0.1, 0.4, 0.9):
        for to_round in (0.02, 0.1, 0.4):
            diff = np.zeros(len(y))
            for f in (0, 1):
                diff[fold == f] = _fit(x[fold != f], y[fold != f], to_pooled, to_round).difference(x[fold == f])
            a, b = _line(diff, y)
            p = 1 / (1 + np.exp(-np.clip(a * diff + b, -30, 30)))
            loss = -np.mean(np.where(y == 1, np.log(p + 1e-12), np.log(1 - p + 1e-12)))
            if best is None or loss < best[0]:
                best = (loss, to_pooled, to_round, (a, b))
    model = _fit(x, y, best[1], best[2])
    model.line = best[3]
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> Discriminant | Constant:
    """Fit on the labelled rows whose crc32(doc_id as text) mod 5 isn't 0."""
    usable = labels.filter(~held_out("doc_id", 5, 0) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = usable.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_y").limit(most)  # bounded, so it can be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "_y")

    def make():
        def step(t: pa.Table) -> pa.Table:
            x = statistics(texts(t["text"]))
            return pa.table({"x": pa.array(x.tolist(), pa.list_(pa.float64())), "y": t["_y"]})

        return step

    found = arrow_map(rows, make, "x array<double>, y int").toPandas()
    if not len(found):
        return fit(np.zeros((0, N_STATS)), np.zeros(0))
    x, y = np.stack(found["x"].to_numpy()), found["y"].to_numpy()
    order = np.lexsort((*x.T, y))  # the fit doesn't depend on the order of tasks
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Discriminant | Constant) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(t: pa.Table) -> pa.Table:
            p = sent.value.score(statistics(texts(t["text"])))
            return pa.table(
                {
                    "doc_id": t["doc_id"],
                    "held_out": t["held_out"],
                    "score": pa.array(p, pa.float64()),
                    "predicted": pa.array((p >= THRESHOLD).astype(np.int32), pa.int32()),
                }
            )

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 5, 0).alias("held_out"), "text")
    return arrow_map(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Discriminant | Constant) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold; all where there is no model."""
    if isinstance(model, Constant):
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda t: t.filter(pa.array(sent.value.score(statistics(texts(t["text"]))) >= THRESHOLD, pa.bool_()))

    return arrow_map(docs, make, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERY = {"op7_quadratic_discriminant_quality": query}
ORACLE: dict[str, str] = {}
