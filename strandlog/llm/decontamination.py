"""Benchmark decontamination: one Aho-Corasick automaton over normalised test questions and answers.

Words are runs of letters and digits, A-Z in lower case; the automaton's symbols are the benchmark's words, so it has
at most one state for each word of each window, and a document's words are mapped to symbols by hash in one vectorised
pass. A window is ``WINDOW`` consecutive words of an item, or the whole of a shorter one. A scan marks every document
word inside an occurrence and keeps the words' byte offsets, so that hits can be given as spans of the original text.

The automaton goes to every task, so its windows are counted first. Up to ``MAX_WINDOWS`` it is one automaton;
beyond, the items are dealt into as many automata as needed, which the documents pass one after another, each time
from a table in the shared folder. Each is built when its turn has come and given up before the next, so the driver holds
one at a time, whatever the benchmark's size.

Edge cases: a null or empty text has no words, no hits and no items; a null item text has no window; items with a null
id hit words but are listed as the empty string; repeated items count once; an empty benchmark hits nothing; other
columns pass through ``keep_clean`` untouched, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.llm.common import WORDY, arrow_map, cut, table, texts, word_hashes

WINDOW = 13
#: Windows in one automaton: some 13 states each, about 100 bytes a state.
MAX_WINDOWS = 200_000
#: A document is contaminated if this share of its words is hit.
ONE_IN = 20


class Automaton:
    """Windows of ``items`` ((id, text) pairs) over word symbols."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        symbols: dict[int, int] = {}
        for item_id, text in items:
            hashes, _ = word_hashes([(text or "").encode()])
            words = [symbols.setdefault(int(h), len(symbols) + 1) for h in hashes]
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                owners[tuple(words[i : i + size])].add("" if item_id is None else str(item_id))
        order = sorted(symbols)
        self.known = np.array(order, dtype=np.uint64)
        self.symbol = np.array([symbols[h] for h in order], dtype=np.int64)
        self.least = min(map(len, owners), default=0)
        self.windows = list(owners)
        self.owners = [owners[w] for w in self.windows]
        self._machine = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    @property
    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            self._machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for k, w in enumerate(self.windows):
                self._machine.add_word(w, (k, len(w)))
            self._machine.make_automaton()
        return self._machine

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The benchmark's number of each word, 0 for words that it doesn't have."""
        if not len(self.known):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.symbol[at], 0)

    def hits(self, symbols: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Which words lie inside an occurrence; the ids of the items whose windows occur.

        Only runs of known words at least as long as the shortest window go through the automaton."""
        inside, found = np.zeros(len(symbols), dtype=bool), set()
        known = np.concatenate(([False], symbols > 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start >= self.least:
                for last, (k, size) in self.machine.iter(tuple(symbols[start:end].tolist())):
                    inside[start + last - size + 1 : start + last + 1] = True
                    found |= self.owners[k]
        return inside, found


def spans(text: str, inside: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of the original text, from the first to the last word of each run of hit words."""
    flat = np.frombuffer(text.encode().translate(WORDY), dtype=np.uint8) != 0x20
    flat = np.concatenate(([False], flat, [False]))
    edges = np.flatnonzero(flat[1:] != flat[:-1])
    start, end = edges[::2], edges[1::2]
    marked = np.concatenate(([False], inside, [False]))
    runs = np.flatnonzero(marked[1:] != marked[:-1])
    return [(int(start[a]), int(end[b - 1])) for a, b in zip(runs[::2], runs[1::2], strict=True)]


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def automata(benchmark: DataFrame, window: int = WINDOW, most: int = MAX_WINDOWS) -> tuple[int, Callable[[int], Automaton]]:
    """How many automata there are, about ``most`` windows in each, and what builds one of them. Windows are counted before
    anything is collected; an item is never split, so a single one of more windows is an automaton of its own."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    words = F.size(F.regexp_extract_all("text", F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1)))
    windows = F.when(words > 0, F.greatest(words - (window - 1), F.lit(1)))
    parts = max(1, -(-int(items.agg(F.sum(windows)).head()[0] or 0) // most))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return parts, lambda p: Automaton([tuple(r) for r in (items if parts == 1 else items.filter(part == p)).toLocalIterator()], window)


def _run(docs: DataFrame, benchmark: DataFrame, window: int, most: int, schema: T.StructType, finish) -> DataFrame:
    """``finish(batch, word counts, hit words, items)`` makes the result's rows once the last automaton has passed.
    What earlier ones found travels in three columns."""
    sc = docs.sparkSession.sparkContext
    names = ["_n_words", "_inside", "_found"]
    while set(names) & set(docs.columns):
        names = [f"_{n}" for n in names]
    kinds = (T.LongType(), T.BinaryType(), T.ArrayType(T.StringType()))
    marks = [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]
    (parts, build), rows = automata(benchmark, window, most), docs
    for k in range(parts):
        sent = sc.broadcast(build(k))

        def make(sent=sent, first=k == 0, last=k + 1 == parts):
            def step(t: pa.Table) -> pa.Table:
                one, sizes, insides, items = sent.value, [], [], []
                raw = texts(t["text"])
                hashes, at = word_hashes(raw)
                symbols = one.symbols(hashes)
                before = None if first else (t[names[1]].to_pylist(), t[names[2]].to_pylist())
                for i in range(len(raw)):
                    inside, found = one.hits(symbols[at[i] : at[i + 1]])
                    if before and before[0][i] is not None:
                        inside |= np.unpackbits(np.frombuffer(before[0][i], np.uint8))[: len(inside)].astype(bool)
                    if before:
                        found = found | set(before[1][i])
                    sizes.append(int(at[i + 1] - at[i]))
                    insides.append(inside)
                    items.append(found)
                plain = t if first else t.drop_columns(names)
                if last:
                    return finish(plain, sizes, insides, items)
                bits = [np.packbits(x).tobytes() if x.any() else None for x in insides]
                for m, kind, values in zip(
                    marks, (pa.int64(), pa.binary(), pa.list_(pa.string())), (sizes, bits, map(sorted, items)), strict=True
                ):
                    plain = plain.append_column(m.name, pa.array(list(values), kind))
                return plain

            return step

        if k + 1 == parts:
            return arrow_map(rows, make, schema)
        rows = cut(arrow_map(rows, make, T.StructType([*docs.schema.fields, *marks])), "decontamination")
        sent.unpersist()
    raise AssertionError


def is_contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and ONE_IN * n_hit >= n_words


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

    def finish(t: pa.Table, sizes: list, insides: list, items: list) -> pa.Table:
        n_hit = [int(x.sum()) for x in insides]
        return pa.table(
            {
                "doc_id": t["doc_id"],
                "n_words": pa.array(sizes, pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "n_items": pa.array(list(map(len, items)), pa.int64()),
                "items_sha256": pa.array(list(map(_digest, items)), pa.string()),
                "contaminated": pa.array(list(map(is_contaminated, sizes, n_hit)), pa.bool_()),
            }
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _run(rows, benchmark, window, most, T.StructType.fromDDL(schema), finish)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MAX_WINDOWS) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""

    def finish(t: pa.Table, sizes: list, insides: list, items: list) -> pa.Table:
        bad = [is_contaminated(n, int(x.sum())) for n, x in zip(sizes, insides, strict=True)]
        return t.filter(pa.array([not x for x in bad], pa.bool_()))

    return _run(docs, benchmark, window, most, docs.schema, finish)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Words, windows and verdicts of (doc_id, text) rows of a table, as DuckDB SQL with the table's name for {docs}.
VERDICTS_SQL = r"""
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
il AS (SELECT item, w, least(13, len(w)) AS l FROM iw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, l, array_to_string(w[i : i + l - 1], ' ') AS win
         FROM (SELECT item, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM il)),
dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {docs}),
dwin AS (SELECT r, l, i, array_to_string(w[i : i + l - 1], ' ') AS win
         FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i
               FROM dw, (SELECT DISTINCT l FROM wins) WHERE len(w) >= l)),
hit AS (SELECT dwin.r, dwin.l, dwin.i, wins.item FROM dwin JOIN wins USING (l, win)),
nh AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hit) GROUP BY r),
ni AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
       FROM hit GROUP BY r),
verdicts AS (SELECT dw.r, dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN nh USING (r) LEFT JOIN ni USING (r))
"""
QUERY = {"op9_aho_corasick_decontamination": query}
ORACLE = {
    "op9_aho_corasick_decontamination": f"WITH {VERDICTS_SQL.format(docs='documents')}"
    "SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM verdicts"
}
