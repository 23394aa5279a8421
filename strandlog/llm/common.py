"""Shared helpers: the folder all executors see, durable cuts of lineage, and vectorised hashing of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.model import cut as cut
from strandlog.model import shared_dir as shared_dir
from strandlog.model import work_folder as new_folder  # noqa: F401

#: Bytes of text that a task works on at once.
PIECE = 8 << 20
U64 = np.uint64
MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2^64
_P_INV = pow(_P, -1, 1 << 64)
#: A-Z become lower case, and ASCII white space a plain space; everything else stays.
SPACED = bytes(0x20 if b in b" \t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As above, and every ASCII byte that is no letter or digit becomes a space.
WORDY = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 0x20 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Cuts:
    """Makes cuts and deletes them all once what was made from them has itself been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, what: str = "cut") -> DataFrame:
        path = new_folder(self.spark, what)
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(conf).delete(path, True)


def local_path(uri: str) -> str:
    return uri.removeprefix("file://") if uri.startswith("file:///") else uri.removeprefix("file:")


def pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most so many bytes in their column ``text``, or one row; other batches whole."""
    for batch in batches:
        if "text" not in batch.schema.names:
            yield batch
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(), dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def arrow_map(
    df: DataFrame, make: Callable[[], Callable[[pa.Table], pa.Table | None]], schema: T.StructType | str
) -> DataFrame:
    """Run ``make()`` once in each task and the function it returns on every slice of its Arrow batches (``pieces``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in pieces(batches):
            if batch.num_rows and (out := step(pa.Table.from_batches([batch]))) is not None:
                yield from out.combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def texts(column: pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, modulo 2^64."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers.get(kind, ())) < n:
        steps = np.full(max(n, 1 << 16), _P if kind == "up" else _P_INV, dtype=U64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=U64)
    return _powers[kind]


def _hash_flat(flat: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(flat, dtype=np.uint8)
    word = np.empty(len(data) + 2, dtype=bool)
    word[0] = word[-1] = False
    np.not_equal(data, 0x20, out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.empty(0, U64), start, end
    terms = (data.astype(U64) + U64(1)) * _power("up", len(data))[: len(data)]
    bounds = np.empty(2 * len(start), dtype=np.int64)
    bounds[::2], bounds[1::2] = start, end
    if bounds[-1] == len(data):
        sums = np.add.reduceat(terms, bounds[:-1])[::2]
    else:
        sums = np.add.reduceat(terms, bounds)[::2]
    return mix(sums * _power("down", len(data))[start] + (end - start).astype(U64)), start, end


def word_hashes(docs: list[bytes], form: bytes = WORDY, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the documents, one after another, and each document's first position in them
    (with the end, so there is one more position than documents).

    ``form`` maps bytes: letters to lower case, separators to a space. A word's hash is a polynomial of its bytes,
    mixed; it depends on nothing but the word. Long texts are handled in pieces cut between words."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(docs) + 1, dtype=np.int64)
    at = 0
    while at < len(docs):
        size, to = 0, at
        while to < len(docs) and (to == at or size + len(docs[to]) < chunk):
            size += len(docs[to]) + 1
            to += 1
        if to == at + 1 and size > 2 * chunk:
            flat, total, lo = docs[at].translate(form), 0, 0
            while lo < len(flat):
                hi = lo + chunk
                hi = len(flat) if hi >= len(flat) or (hi := flat.find(b" ", hi)) < 0 else hi
                h, _, _ = _hash_flat(flat[lo:hi])
                hashes.append(h)
                total += len(h)
                lo = hi
            counts[at + 1] = total
        else:
            flat = b" ".join(docs[at:to]).translate(form)
            h, start, _ = _hash_flat(flat)
            hashes.append(h)
            begins = np.cumsum([0, *(len(d) + 1 for d in docs[at:to])])
            counts[at + 1 : to + 1] = np.diff(np.searchsorted(start, begins))
        at = to
    return np.concatenate(hashes) if hashes else np.empty(0, U64), np.cumsum(counts)


def held_out(column: F.Column | str, modulus: int, remainder: int) -> F.Column:
    """crc32(id as text) mod ``modulus`` equals ``remainder``; a null id counts as the text ``null``."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("null")).cast("binary")) % modulus) == remainder


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sampled(df: DataFrame, column: str, expected: float, rows: int, what: str = "sample") -> DataFrame:
    """About ``expected`` of ``rows`` rows, those whose hash of ``column`` is low; all where there are no more. Every task
    drops the others by itself, so what reaches the driver doesn't grow with the tasks."""
    if rows <= expected:
        return df
    return df.filter(F.pmod(F.xxhash64(column, F.lit(what)), F.lit(1 << 30)) < int((1 << 30) * expected / rows))
