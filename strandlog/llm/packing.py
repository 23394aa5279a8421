"""Packing along a space-filling curve.

A document's hashed word counts are projected to three dimensions, whose cell on a Hilbert curve is its key; copies of
a text share a cell and are told apart by the hash of their id, and rows of one id by their number within a batch, so that
a large group spreads over many ranges. Rows
are dealt into ranges of that key and sorted, and the token stream along the whole curve is cut every ``LENGTH`` tokens:
neighbours share sequences, every sequence but the last is full, and every id lies in exactly one piece.

Ids come from a table written once; the ranges' limits are approximate quantiles of the key and their first positions
are prefix sums of one number each, all that the driver sees. There are at most ``MAX_RANGES``; a range is sorted and cut
as a stream, so that beyond so many they may hold any number of tokens.

Edge cases: a null text counts as empty and has the closing id alone; equal keys are ordered by id, length and ids, so
repeated rows are interchangeable; an empty table has no piece; other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import MASK, cut, mix, pieces, shuffle_partitions, table, texts, word_hashes

LENGTH = 4096
CLOSING = 2
DIMS, BITS = 3, 13
FEATURES = 512
#: Tokens in one range of the curve, at most about so many.
RANGE_TOKENS, MAX_RANGES = 4_000_000, 10_000
#: Words and chunks that are kept one by one, in each of two generations.
MAX_WORDS, MAX_CHUNKS = 150_000, 10_000
#: Of the table of short chunks; the last bounds the text that is looked up at once.
SLOT_BITS, PROBES, MAX_TABLE, AT_ONCE = 21, 4, 1_000_000, 1 << 20
SLOTS = 1 << SLOT_BITS
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], "<u8")
_PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


#: Chunks of Latin letters and closing punctuation: these are two words to the tokenizer. Such letters are whole
#: characters, so that composing them changes nothing, and lose their case one by one (but for the dotted capital I).
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]*)([.,;:!?%*$&#]*)")
#: The tokenizer's letters for bytes: printable ones stand for themselves, the others for what follows 255 in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}


class _Kept(dict):
    """A cache of two generations: when the young one is full it becomes the old one, so what is in use stays."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str | bytes) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}H", *ids)


class Encoder:
    """Ids of whole texts as little-endian 16-bit numbers.

    The tokenizer never joins what white space parts, so each chunk between spaces and line feeds is encoded once and
    its ids are kept. A chunk of plain letters with punctuation after them goes to the tokenizer's model as the two
    words that it is; any other chunk goes through all of the tokenizer.

    Chunks of up to 16 bytes are looked up all at once: two numbers hold their bytes, so that with the length they are
    compared as a whole. They lie in a hash table, where a chunk that finds ``PROBES`` slots taken replaces another and
    which is emptied before it has more than ``MAX_TABLE`` chunks. What it doesn't have, and longer chunks, are looked up one
    by one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = _Kept(self._word, MAX_WORDS)
        self.chunks = _Kept(self._chunk, MAX_CHUNKS)
        self.slots = np.zeros(SLOTS, np.int32)  # each slot's entry; entry 0 is none, as no chunk is empty
        self.low, self.high, self.length, self.first, self.n = (np.zeros(MAX_TABLE, t) for t in ("<u8", "<u8", np.uint8, np.int32, np.uint16))
        self.pool = np.empty(4 * MAX_TABLE, "<u2")
        self.used, self.pooled = 1, 0

    def _empty(self) -> None:
        self.slots[:] = 0
        self.used, self.pooled = 1, 0

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
        return _packed([t.id for t in self.model.tokenize(letters)])

    def _chunk(self, raw: bytes) -> bytes:
        chunk = raw.decode()
        plain = _PLAIN.fullmatch(chunk)
        if plain is None:
            return _packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        letters, marks = plain.groups()
        return (self.words[letters.lower()] if letters else b"") + (self.words[marks] if marks else b"")

    def _found(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Each chunk's entry, 0 where the table doesn't have it."""
        entry = self.slots[slot]
        entry[(self.low[entry] != low) | (self.high[entry] != high) | (self.length[entry] != length)] = 0
        rest = np.flatnonzero(entry == 0)
        for k in range(1, PROBES):
            if not len(rest):
                break
            own = self.slots[slot[rest] + k]
            same = (self.low[own] == low[rest]) & (self.high[own] == high[rest]) & (self.length[own] == length[rest])
            entry[rest[same]] = own[same]
            rest = rest[~same]
        return entry

    def _add(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, slot: np.ndarray, ids: list[bytes]) -> None:
        """Add distinct chunks that the table doesn't have."""
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        if self.used + len(n) > MAX_TABLE or self.pooled + n.sum() > len(self.pool):
            self._empty()
        m = min(len(n), MAX_TABLE - 1, int(np.searchsorted(np.cumsum(n), len(self.pool), side="right")))
        ends, own = self.pooled + np.cumsum(n[:m]), slice(self.used, self.used + m)
        self.low[own], self.high[own], self.length[own], self.first[own], self.n[own] = low[:m], high[:m], length[:m], ends - n[:m], n[:m]
        new = b"".join(ids[:m])
        self.pool[self.pooled : self.pooled + len(new) // 2] = np.frombuffer(new, "<u2")
        entry, slot = np.arange(self.used, self.used + m, dtype=np.int32), slot[:m]
        for _ in range(PROBES):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = entry[free]
            left = self.slots[slot] != entry
            entry, slot = entry[left], slot[left] + 1
        self.slots[slot - PROBES] = entry  # instead of others
        self.used, self.pooled = self.used + m, self.pooled + len(new) // 2

    def __call__(self, text: str) -> bytes:
        return self.many([text.encode()])[0].tobytes()

    def many(self, raw: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, given in UTF-8."""
        if not raw:
            return []
        flat = b"\n".join(raw).replace(b"\n", b" ")
        data = np.frombuffer(flat + bytes(24), np.uint8)
        inside = np.zeros(len(flat) + 2, dtype=bool)
        np.not_equal(data[: len(flat)], 0x20, out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        length = end - start
        eights = np.ndarray((len(flat) + 16,), "<u8", data, 0, (1,))  # the eight bytes from each byte on
        low, high = eights[start] & _MASKS[np.minimum(length, 8)], eights[start + 8] & _MASKS[np.clip(length - 8, 0, 8)]
        slot = low * np.uint64(0x9E3779B97F4A7C15) ^ (high + length.astype("<u8")) * np.uint64(0xC2B2AE3D27D4EB4F)
        slot = ((slot ^ slot >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        slot = np.minimum(slot, SLOTS - PROBES)
        entry = self._found(low, high, length, slot)
        entry[length > 16] = 0
        first, n = self.first[entry].astype(np.int64), self.n[entry].astype(np.int64)
        rest = np.flatnonzero(entry == 0)
        raws = [flat[x:y] for x, y in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]
        place = {chunk: k for k, chunk in enumerate(dict.fromkeys(raws))}
        found = list(map(self.chunks.__getitem__, place))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 2
        which = np.fromiter(map(place.__getitem__, raws), np.int64, len(raws))
        first[rest], n[rest] = (self.pooled + np.cumsum(sizes) - sizes)[which], sizes[which]
        pool = np.concatenate((self.pool[: self.pooled], np.frombuffer(b"".join(found), "<u2")))
        lone = rest[np.unique(which, return_index=True)[1]]  # the first place of each of those chunks
        short = length[lone] <= 16
        self._add(low[lone[short]], high[lone[short]], length[lone[short]], slot[lone[short]], [found[k] for k in np.flatnonzero(short)])
        ends = np.cumsum(n)
        ids = pool[np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        begins = np.cumsum([len(r) + 1 for r in raw[:-1]])
        return np.split(ids, np.concatenate(([0], ends))[np.searchsorted(start, begins)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of cell numbers below 2^bits."""
    x = [c.astype(np.uint64) for c in cells.T]
    one, n = np.uint64(1), len(x)
    for level in range(bits - 1, 0, -1):  # undo the rotations of the curve, from the coarsest level
        bit, below = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(n):
            turned = (x[i] & bit) != 0
            swap = (x[0] ^ x[i]) & below
            x[0] = np.where(turned, x[0] ^ below, x[0] ^ swap)
            if i:
                x[i] = np.where(turned, x[i], x[i] ^ swap)
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    parity = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        parity = np.where((x[n - 1] & np.uint64(1 << level)) != 0, parity ^ np.uint64((1 << level) - 1), parity)
    x = [c ^ parity for c in x]
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for c in x:
            key = key << one | (c >> np.uint64(level) & one)
    return key


def curve_keys(docs: list[bytes], seed: int = 0) -> np.ndarray:
    """Hilbert keys of the documents' projected hashed word counts."""
    hashes, at = word_hashes(docs)
    projection = np.random.default_rng(seed).standard_normal((FEATURES, DIMS))
    feature = (hashes % np.uint64(FEATURES)).astype(np.int64)
    cells = np.empty((len(docs), DIMS), dtype=np.int64)
    for i in range(len(docs)):
        v = np.log1p(np.bincount(feature[at[i] : at[i + 1]], minlength=FEATURES))
        y = v @ projection / max(1e-12, float(np.sqrt(v @ v)))
        cells[i] = np.minimum((0.5 + 0.5 * np.tanh(0.8 * y)) * (1 << BITS), (1 << BITS) - 1)
    return hilbert(cells)


def _occurrence(ids: np.ndarray) -> np.ndarray:
    """How many times each id came before; 0 for most."""
    order = np.argsort(ids, kind="stable")
    first = np.searchsorted(ids[order], ids[order])
    out = np.empty(len(ids), dtype=np.uint64)
    out[order] = np.arange(len(ids)) - first
    return out


def _at_once(raw: list[bytes], most: int = AT_ONCE) -> Iterator[list[bytes]]:
    """The texts in order, in lists of at most so many bytes or one text."""
    lo = 0
    while lo < len(raw):
        size, hi = 0, lo
        while hi < len(raw) and (hi == lo or size + len(raw[hi]) <= most):
            size, hi = size + len(raw[hi]), hi + 1
        yield raw[lo:hi]
        lo = hi


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, curve, n, ids) of every row, from a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, closing = encoder(path), np.array([CLOSING], "<u2").tobytes()
        for batch in pieces(batches):
            raw = texts(pa.chunked_array([batch.column("text")]))
            ids = [i.tobytes() + closing for own in _at_once(raw) for i in encode.many(own)]
            number = np.array([x or 0 for x in batch.column("doc_id").to_pylist()], dtype=np.int64)
            spread = mix(number.view(np.uint64) + _occurrence(number) * np.uint64(MASK // 3)) >> np.uint64(40)
            curve = (curve_keys(raw) << np.uint64(24) | spread).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(curve),
                    pa.array([len(x) // 2 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "curve", "n", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(run, "doc_id long, curve long, n long, ids binary"), "tokens")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every row."""
    spark = docs.sparkSession
    rows = tokenised(docs, path or default_tokenizer())
    tokens = rows.agg(F.sum("n")).head()[0] or 0
    ranges = max(1, shuffle_partitions(spark), min(MAX_RANGES, -(-tokens // RANGE_TOKENS)))
    shares = [k / ranges for k in range(1, ranges)]
    # a document counts once for each sequence that it fills, so that ranges hold about equally many tokens
    weighted = rows.select("curve", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / length))))
    limits = weighted.agg(F.percentile_approx("curve", shares, 10 * ranges)).head()[0] if tokens and shares else []
    limits = np.array(sorted(set(limits or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(curve: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, curve.to_numpy(), side="right").astype(np.int32))

    dealt = rows.withColumn("range", range_of("curve"))
    totals = {r["range"]: r["n"] for r in dealt.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    first, at = [], 0
    for k in range(len(limits) + 1):
        first.append(at)
        at += totals.get(k, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = first[TaskContext.get().partitionId()] if TaskContext.get().partitionId() < len(first) else 0
        for batch in batches:
            out: list[tuple[int | None, ...]] = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    take = min(len(ids) - start, length - at % length)
                    crc = zlib.crc32(ids[start : start + take].tobytes())
                    out.append((doc_id, start, take, crc, len(ids), at // length, at % length))
                    start, at = start + take, at + take
            columns = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in columns], names=[x.split()[0] for x in _PIECE.split(", ")]
            )

    return (
        dealt.repartitionById(len(limits) + 1, F.col("range"))
        .sortWithinPartitions("curve", "doc_id", "n", "ids")
        .mapInArrow(run, _PIECE)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERY = {"op2_hilbert_packing": query}
ORACLE: dict[str, str] = {}
