"""Approximate search by an inverted multi-index.

Vectors get one more coordinate that makes all of them equally long, after which the largest inner product is the least
distance. The two halves are quantised separately, so a cell is a pair of centroids; a query visits cells in order of
the sum of its two distances, taken from a heap, until the cells visited hold ``entries`` vectors, and all their entries
are reranked by the inner product in double precision.

How many entries that takes is measured, not guessed: for about ``CALIBRATION`` queries the true neighbours are found
by a scan, and ``entries`` is what lets ``TARGET`` of those be met. Vectors that cluster need few; vectors without any
structure need a large share of all, and get it.

Entries lie on shelves of at most about ``SHELF`` vectors, neighbouring cells together and a larger cell on several
shelves. A query goes to the shelves that hold cells it visits, once each, with the summed distance of the last cell: what is
nearer on a shelf is what it visits. Shelves that many queries visit are copied for each ``QUERIES`` of them. Codebooks are
fitted on about ``FIT_ROWS`` rows chosen by hash; every row is indexed. Equal vectors are one entry; each brings its smallest ids, as many as a result can hold.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows without an id; rows with one id count as one, with the smallest vector; ties go to the smaller id;
fewer candidates than ``k`` are all returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.llm.common import cut, sampled, shuffle_partitions, table

K, EVERY = 20, 20
FIT_ROWS, CENTROIDS_MAX, ROUNDS = 10_000, 256, 8
#: Rows in a cell, on average, while there are no more centroids than CENTROIDS_MAX.
CELL_ROWS = 64
CALIBRATION, TARGET = 128, 0.96
SHELF, QUERIES = 3_000, 8_000


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.square(x).sum(axis=1)[:, None] - 2 * x @ c.T + np.square(c).sum(axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        own = _distances(x, c).argmin(axis=1)
        size = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c


@dataclass
class MultiIndex:
    """Two codebooks over the halves of extended vectors, and how many entries each cell holds."""

    first: np.ndarray
    second: np.ndarray
    norm: float
    counts: np.ndarray | None = None

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def halves(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.norm**2 - np.square(x).sum(axis=1)))
        half = x.shape[1] // 2
        return x[:, :half], np.concatenate((x[:, half:], rest[:, None]), axis=1)

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x, query=False)
        return _distances(a, self.first).argmin(axis=1) * len(self.second) + _distances(b, self.second).argmin(axis=1)

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """Cells in order of summed distance: the heap holds the next pair of every row that has been reached."""
        a, b = self.halves(query[None], query=True)
        da, db = _distances(a, self.first)[0], _distances(b, self.second)[0]
        ra, rb = np.argsort(da, kind="stable").tolist(), np.argsort(db, kind="stable").tolist()
        da, db = da[ra].tolist(), db[rb].tolist()
        heap = [(da[0] + db[0], 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield ra[i] * len(rb) + rb[j]
            if j + 1 < len(rb):
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(ra):
                heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))

    def sums(self, queries: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The summed distance of each query to each of the cells."""
        a, b = self.halves(queries, query=True)
        i, j = np.divmod(cells, len(self.second))
        return _distances(a, self.first)[:, i] + _distances(b, self.second)[:, j]

    def visit(self, query: np.ndarray, entries: int) -> tuple[np.ndarray, float]:
        """The cells with entries that a query visits, and the summed distance up to which it does (with a little room for
        rounding, so that it may visit a cell more)."""
        found, size, counts = [], 0, self.counts
        for cell in self.walk(query):
            if counts[cell]:
                found.append(cell)
                size += counts[cell]
                if size >= entries:
                    break
        cells = np.array(found)
        last = float(self.sums(query[None], cells[-1:])[0, 0])
        return cells, last + 1e-9 * (abs(last) + self.norm**2)


def _matrix(column: pa.Array | pa.ChunkedArray | pd.Series) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array | pa.ChunkedArray) else list(column)
    return np.array(values, dtype=np.float64) if len(values) else np.zeros((0, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, one for each id."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        "vec_id is not null and v is not null and size(v) > 0"
    )
    rows = rows.filter(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").head()
    rows = rows.filter(F.size("v") == (sizes["d"] if sizes else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, best first, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search(vectors: DataFrame, every: int = EVERY, k: int = K, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    result = "query_id long, rank int, vec_id long, score double"
    rows = cut(usable(vectors), "vectors")
    facts = rows.agg(F.count("*"), F.max(F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + x * x))"))).head()
    n, norm = facts[0], facts[1]
    if not n:
        return spark.createDataFrame([], result)

    sample = sampled(rows, "vec_id", FIT_ROWS, n).select("v").toPandas()
    index = MultiIndex(np.zeros((1, 1)), np.zeros((1, 1)), float(norm) * (1 + 1e-9))
    a, b = index.halves(np.unique(_matrix(sample["v"]), axis=0), query=False)
    size = int(np.clip(round((n / CELL_ROWS) ** 0.5), 1, CENTROIDS_MAX))
    index.first, index.second = kmeans(a, size), kmeans(b, size, seed=1)
    sent = sc.broadcast(index)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = sent.value.cell(_matrix(batch.column("v")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("times"), pa.array(cells.astype(np.int32)), batch.column("v")],
                names=["rep", "times", "cell", "v"],
            )

    # equal vectors are one entry under their smallest id
    entries = rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"))
    entries = cut(entries.select("rep", "times", "v").mapInArrow(to_cells, "rep long, times long, cell int, v array<double>"), "cells")
    index.counts, most = np.zeros(index.cells, dtype=np.int64), 1
    for r in entries.groupBy("cell").agg(F.count("*").alias("n"), F.max("times").alias("t")).collect():  # a row for each cell
        index.counts[r["cell"]], most = r["n"], max(most, r["t"])
    if most > 1:
        copied = entries.filter("times > 1").select("v", "rep")
        rows = rows.join(copied, "v", "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), "v")
    else:
        rows = rows.select("vec_id", F.col("vec_id").alias("rep"), "v")
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "rep", "v")
    need = max(k + 1, _calibrate(entries, asked, n // every, index, k, target))  # so that k are found wherever there are k
    shelves, parts = map(np.array, _shelves(index.counts))
    sent = sc.broadcast(index)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            reps, goes, limits, at = batch.column("rep").to_numpy(), [], [], []
            for i, v in enumerate(_matrix(batch.column("v"))):
                cells, limit = index.visit(v, need)
                wide = cells[parts[cells] > 1]
                own = np.unique(np.concatenate([shelves[cells], *(np.arange(shelves[c], shelves[c] + parts[c]) for c in wide)]))
                goes.append(own)
                limits.append(np.full(len(own), limit))
                at.append(np.full(len(own), i))
            if goes:
                at = np.concatenate(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reps[at]), pa.array(np.concatenate(goes).astype(np.int32)), pa.array(np.concatenate(limits)), batch.column("v").take(pa.array(at))],
                    names=["rep", "shelf", "limit", "v"],
                )

    routed = cut(
        asked.dropDuplicates(["rep"])
        .select("rep", "v")
        .repartition(shuffle_partitions(spark))
        .mapInArrow(route, "rep long, shelf int, limit double, v array<double>"),
        "routes",
    )
    copies = {
        r["shelf"]: -(-r["n"] // QUERIES) for r in routed.groupBy("shelf").agg(F.count("*").alias("n")).collect()
    }
    crowded = spark.createDataFrame([*((s, c) for s, c in copies.items() if c > 1)] or [(-1, 1)], "shelf int, copies int")
    copy = F.coalesce(F.col("copies"), F.lit(1))
    routed = (
        routed.join(F.broadcast(crowded), "shelf", "left")
        .withColumn("part", F.pmod(F.xxhash64("rep"), copy).cast("int"))
        .drop("copies")
    )
    placed = spark.createDataFrame(
        [(c, int(shelves[c]), int(parts[c])) for c in np.flatnonzero(index.counts).tolist()], "cell int, s int, p int"
    )  # one row for each cell
    shelved = (
        entries.join(F.broadcast(placed), "cell")
        .withColumn("shelf", (F.col("s") + F.pmod(F.xxhash64("rep"), F.col("p"))).cast("int"))
        .join(F.broadcast(crowded), "shelf", "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0), copy - 1)))
        .select("shelf", "part", F.col("rep").alias("entry"), "cell", F.col("v").alias("e"))
    )

    def rerank(key: tuple, queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(held):
            return pd.DataFrame({"rep": [], "found": [], "scores": []})
        held = held.sort_values(["cell", "entry"])
        ids, e = held["entry"].to_numpy(np.int64), _matrix(held["e"])
        kinds, of = np.unique(held["cell"].to_numpy(np.int64), return_inverse=True)
        out = []
        for lo in range(0, len(queries), 256):
            block = queries.iloc[lo : lo + 256]
            q = _matrix(block["v"])
            far = sent.value.sums(q, kinds) > block["limit"].to_numpy()[:, None]
            scores = q @ e.T
            scores[far[:, of]] = -np.inf  # entries of cells that the query doesn't visit
            for row, rep in zip(scores, block["rep"], strict=True):
                at = _top(row, ids, k + 1)
                at = at[row[at] > -np.inf]
                out.append((rep, ids[at].tolist(), row[at].tolist()))
        return pd.DataFrame(out, columns=["rep", "found", "scores"])

    best = (
        routed.groupBy("shelf", "part")
        .cogroup(shelved.groupBy("shelf", "part"))
        .applyInPandas(rerank, "rep long, found array<long>, scores array<double>")
        .select("rep", F.explode(F.arrays_zip("found", "scores")).alias("x"))
        .select("rep", F.col("x.found").alias("entry"), F.col("x.scores").alias("score"))
    )
    by_score = Window.partitionBy("rep").orderBy(F.desc("score"), "entry")
    best = best.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= k + 1).drop("r")
    if most > 1:  # an entry's smallest ids, one more than a result holds as the query's own may be among them
        ids = Window.partitionBy("rep").orderBy("vec_id")
        held = rows.select("rep", "vec_id").withColumn("r", F.row_number().over(ids)).filter(F.col("r") <= k + 1)
        best = best.join(held.select(F.col("rep").alias("entry"), "vec_id"), "entry")
        near = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
        best = best.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1).drop("r")
    else:
        best = best.withColumn("vec_id", F.col("entry"))
    found = best.join(asked.select("query_id", "rep"), "rep").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrate(entries: DataFrame, asked: DataFrame, expected: int, index: MultiIndex, k: int, target: float) -> int:
    """Entries to visit so that ``target`` of the sample queries' true neighbours lie in the cells visited."""
    sample = sampled(asked, "query_id", CALIBRATION, expected).toPandas()
    if not len(sample):
        return 1
    queries, reps = _matrix(sample["v"]), sample["rep"].to_numpy(np.int64)
    sent = entries.sparkSession.sparkContext.broadcast((queries, reps))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = sent.value
        kept = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
        for batch in batches:
            ids, cells = batch.column("rep").to_numpy(), batch.column("cell").to_numpy()
            scores = q @ _matrix(batch.column("v")).T
            for i in range(len(q)):
                at = _top(scores[i], ids, k + 1)
                s, d, c = (np.concatenate(x) for x in zip(kept[i], (scores[i][at], ids[at], cells[at]), strict=True))
                at = _top(s, d, k + 1)
                kept[i] = s[at], d[at], c[at]
        out = [(i, float(s), int(d), int(c)) for i in range(len(q)) for s, d, c in zip(*kept[i], strict=True) if d != own[i]]
        columns = zip(*out, strict=True) if out else [()] * 4
        kinds = (pa.int32(), pa.float64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=["q", "score", "id", "cell"]
        )

    found = entries.mapInArrow(scan, "q int, score double, id long, cell int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    truth = found.withColumn("r", rank).filter(F.col("r") <= k).select("q", "cell").collect()
    needs = []
    cells: dict[int, list[int]] = {}
    for r in truth:
        cells.setdefault(r["q"], []).append(r["cell"])
    for q, wanted in cells.items():
        before, size = {}, 0
        for cell in index.walk(queries[q]):
            size += int(index.counts[cell])
            before[cell] = size
        needs += [before[c] for c in wanted]
    return int(np.quantile(needs, target, method="higher")) if needs else 1


def _shelves(counts: np.ndarray) -> tuple[list[int], list[int]]:
    """First shelf and number of shelves of each cell; small cells share one."""
    first, parts, at, load = [], [], 0, 0
    for n in counts.tolist():
        if n > SHELF:
            at, load = at + (load > 0), 0
            first.append(at)
            parts.append(-(-n // SHELF))
            at += parts[-1]
        else:
            if load + n > SHELF:
                at, load = at + 1, 0
            first.append(at)
            parts.append(1)
            load += n
    return first, parts


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


QUERY = {"op3_inverted_multi_index": query}
ORACLE: dict[str, str] = {}
