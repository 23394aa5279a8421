"""Document log-likelihood under a gated recurrent language model with a class-factored softmax.

Tokens are runs of characters other than ASCII white space, A-Z in lower case, then one end. Counts of all training
tokens are gathered from the whole corpus into a table keyed by a 64-bit hash of the token. The most frequent tokens
make classes of equal size in order of frequency; the end is a class, and all other tokens, seen or not, are the rare
class, in which a token has probability (c + 1) / (N_rare + V_rare + 1). So

    p(token | history) = p(class | state) * p(token | class, state)

sums to at most one over all strings, and the rare class makes what the model knows grow with the corpus.

The words in classes are ``total ** GROWTH`` of ``total`` training tokens (at least ``CLASSES * PER_CLASS``, at most
``HEAD``), so the network's vocabulary grows with the corpus.

The network (one gated recurrent layer) is trained in numpy by backpropagation truncated to ``STEPS`` tokens, on every
token of every training row, once: whole texts with their ends, the state carried from window to window. Training goes in
rounds over disjoint rows, chosen by hash. In a round each task trains a copy of the last round's network on its own
rows, and the copies' mean, weighted by their tokens, is the round's network. So it depends, a little, on how the rows
are dealt to tasks. Scoring covers every token of every document: documents run in lockstep, longest first, in windows
whose last state starts the next.

Counts of the at most ``HEAD`` most frequent tokens are sent to all tasks; the others' are joined by a shuffle, one row
for each document and token, so nothing that grows with the corpus goes to one machine.

Edge cases: null and empty texts are the end alone; without training rows the base is (0 + 1) / (0 + 0 + 1); repeated
rows are rows of their own; a null doc_id counts as the text ``null`` for the split; other columns are not read.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import SPACED, cut, held_out, pieces, table, texts, word_hashes

HEAD = 1 << 18
CLASSES, PER_CLASS = 32, 31
RARE_INPUTS = 64
GROWTH = 0.45
HIDDEN, STEPS, STREAMS = 16, 16, 512
RATE, DECAY = 0.01, 200
#: Eighths of the training rows in each round.
ROUNDS = (range(1), range(1, 8))
#: Tokens that training deals to its streams at once, and numbers of a network that are averaged as one row.
DEALT, BLOCK = 1 << 20, 4096
#: Numbers that a step of the descent changes at once; scores below SAFE need no care before the exponential.
STEP, SAFE = 1 << 13, 40
LOCKSTEP, WINDOW = 1024, 32
#: Cases whose classes are computed at once, so that their scores stay near the processor.
CASES = 2048
_LN10 = np.log(10)


class _Index:
    """Finds numbers that are spread over all 64 bits, as hashes are, in a sorted array of them: from where the numbers with
    the same first bits begin, it goes on step by step."""

    def __init__(self, numbers: np.ndarray):
        bits = max(4, len(numbers).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(numbers, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.numbers = np.append(numbers, np.uint64((1 << 64) - 1))

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """For each wanted number, the place of the first that isn't smaller."""
        at = self.starts[(wanted >> self.shift).astype(np.int32)]
        rest = np.flatnonzero(self.numbers[at] < wanted)
        while len(rest):
            at[rest] += 1
            rest = rest[self.numbers[at[rest]] < wanted[rest]]
        return at


@dataclass
class Vocabulary:
    """Counts of the head, sorted by hash, and the classes of its most frequent tokens."""

    hashes: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    ends: int
    known: np.ndarray = field(init=False)
    known_word: np.ndarray = field(init=False)
    word_counts: np.ndarray = field(init=False)
    size: int = field(init=False)
    per_class: int = field(init=False)
    classes: int = field(init=False)
    members: list[int] = field(init=False)
    rare_total: int = field(init=False)
    indices: dict[str, _Index] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        most = max(CLASSES * PER_CLASS, int(self.total**GROWTH))
        order = np.lexsort((self.hashes, -self.counts))[:most]
        self.size = len(order)
        by_hash = np.argsort(order)  # the head is sorted by hash
        self.known, self.known_word, self.word_counts = self.hashes[order][by_hash], by_hash, self.counts[order]
        self.per_class = max(PER_CLASS, int(self.size**0.5))
        self.members = [min(self.per_class, self.size - lo) for lo in range(0, self.size, self.per_class)]
        self.classes = len(self.members)
        words = int(self.counts[order].sum())
        rare_tokens, rare_kinds = self.total - self.ends - words, self.distinct - (self.ends > 0) - self.size
        self.rare_total = rare_tokens + rare_kinds + 1
        self.indices = {}
        self.frequencies = np.concatenate((self.counts[order], [self.ends, rare_tokens])).astype(float)

    @property
    def end(self) -> int:
        return self.size

    def _places(self, numbers: str, wanted: np.ndarray) -> np.ndarray:
        """Where each hash is in ``known`` or ``hashes`` if it is there, else some other place; the index is made when needed."""
        held = getattr(self, numbers)
        if numbers not in self.indices:
            self.indices[numbers] = _Index(held)
        return np.minimum(self.indices[numbers].places(wanted), len(held) - 1)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Each token's symbol: a word, or beyond the end for rare ones."""
        rare = self.size + 1 + (hashes % np.uint64(RARE_INPUTS)).astype(np.int64)
        if not self.size:
            return rare
        at = self._places("known", hashes)
        return np.where(self.known[at] == hashes, self.known_word[at], rare)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's symbol and count, -1 where the head doesn't have it."""
        symbols, counts = self.symbols(hashes), np.full(len(hashes), -1)
        word = symbols < self.size
        counts[word] = self.word_counts[symbols[word]]
        rest = np.flatnonzero(~word)
        if len(self.hashes) and len(rest):  # most tokens are words, so few are looked for in all of the head
            wanted = hashes[rest]
            at = self._places("hashes", wanted)
            counts[rest] = np.where(self.hashes[at] == wanted, self.counts[at], -1)
        return symbols, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Takes the place of x."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _by_gate(x: np.ndarray) -> np.ndarray:
    """The numbers of the two gates and the candidate, which lie side by side in each row, as three arrays."""
    return np.ascontiguousarray(x.reshape(len(x), 3, -1).transpose(1, 0, 2))


def _pick(x: np.ndarray, at: np.ndarray, derive: bool, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """For scores with a column for each case: the log-probability of each case's row ``at``, and, to ``derive``, the
    derivatives of minus their sum by the scores. ``safe`` scores are small enough for the exponential as they are. ``x`` is
    used up."""
    flat, place = x.reshape(-1), at * x.shape[1] + np.arange(x.shape[1])
    if not safe:
        x -= x.max(axis=0)
    own = flat[place]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    if derive:
        x /= total
        flat[place] -= 1
    return own - np.log(total), x


def _descend(p: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, scale: float, rate: float, done: int) -> None:
    """One step of Adam in place, a few thousand numbers after another so that they stay near the processor."""
    p, g, m, v = (x.reshape(-1) for x in (p, g, m, v))
    m_all, v_all = rate / (1 - 0.9**done), 1 / (1 - 0.99**done)
    for lo in range(0, len(p), STEP):
        own, gs, ms, vs = (x[lo : lo + STEP] for x in (p, g, m, v))
        gs = gs * scale
        ms *= 0.9
        ms += 0.1 * gs
        vs *= 0.99
        gs *= gs
        gs *= 0.01
        vs += gs
        np.multiply(vs, v_all, out=gs)
        np.sqrt(gs, out=gs)
        gs += 1e-8
        np.divide(ms, gs, out=gs)
        gs *= m_all
        own -= gs


class Network:
    """Symbols: words 0 .. size-1, the end, then rare inputs. Classes: those of words, the end's, the rare."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 0):
        v, rng = vocabulary, np.random.default_rng(seed)
        self.size, self.per_class, self.classes, self.members = v.size, v.per_class, v.classes, v.members
        self.tokens = 0  # that it was trained on
        f = v.frequencies + 0.5
        mass = [f[lo : lo + v.per_class].sum() for lo in range(0, v.size, v.per_class)] + [f[-2], f[-1]]
        draw = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
        self.p = {
            "in": draw(v.size + 1 + RARE_INPUTS, 3 * HIDDEN),
            "bias": np.zeros(3 * HIDDEN, np.float32),
            "state": draw(HIDDEN, 3 * HIDDEN),
            "class": draw(HIDDEN, v.classes + 2) * 0,
            "class_bias": np.log(np.array(mass) / sum(mass)).astype(np.float32),
            "word": draw(HIDDEN, v.size) * 0,
            "word_bias": np.log(f[: v.size]).astype(np.float32),
        }

    def class_of(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(
            symbols < self.size, symbols // self.per_class, np.where(symbols == self.size, self.classes, self.classes + 1)
        )

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        return self._step(_by_gate(x), h, _by_gate(self.p["state"]))

    def _step(self, x: np.ndarray, h: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """As ``step``, of inputs and weights by gate: each operation then runs over memory without gaps."""
        u = np.matmul(h, state)
        z, r = _sigmoid(x[:2] + u[:2])
        n = r * u[2]
        n += x[2]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, u[2]

    def log_outputs(self, hs: np.ndarray, targets: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Natural-log probabilities of the targets' classes and words; with ``grad``, also d(-sum)/d(states)."""
        p, c, derive = self.p, self.class_of(targets), grad is not None
        # states lie between -1 and 1, so this bounds all scores
        safe = all(np.abs(p[k]).sum(axis=0).max(initial=0) + np.abs(p[f"{k}_bias"]).max(initial=0) < SAFE for k in ("class", "word"))
        # biases are weights of a state that is always 1
        hs = np.concatenate((hs, np.ones((len(hs), 1), hs.dtype)), axis=1)
        weights, words = (np.ascontiguousarray(np.vstack((p[k], p[f"{k}_bias"])).T) for k in ("class", "word"))
        out, back = np.empty(len(hs)), np.empty((len(hs), HIDDEN), hs.dtype) if derive else None
        by_class, by_word = (np.zeros_like(x) for x in (weights, words)) if derive else (None, None)
        for lo in range(0, len(hs), CASES):
            own = hs[lo : lo + CASES]
            out[lo : lo + CASES], d = _pick(weights @ own.T, c[lo : lo + CASES], derive, safe)
            if derive:
                by_class += d @ own
                np.matmul(d.T, weights[:, :-1], out=back[lo : lo + CASES])
        order = np.argsort(c.astype(np.int16), kind="stable")  # cases of one class lie together from here on
        edges = np.searchsorted(c[order], np.arange(self.classes + 1)).tolist()
        order = order[: edges[-1]]
        own_states, own_targets = np.take(hs, order, axis=0), (targets - c * self.per_class)[order]
        own_out, own_back = np.empty(len(order)), np.empty((len(order), HIDDEN), hs.dtype) if derive else None
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a == b:
                continue
            lo, hi = k * self.per_class, k * self.per_class + self.members[k]
            own = own_states[a:b]
            own_out[a:b], d = _pick(words[lo:hi] @ own.T, own_targets[a:b], derive, safe)
            if derive:
                np.matmul(d, own, out=by_word[lo:hi])
                np.matmul(d.T, words[lo:hi, :-1], out=own_back[a:b])
        if derive:
            for k, g in (("class", by_class), ("word", by_word)):
                grad[k], grad[f"{k}_bias"] = np.ascontiguousarray(g[:, :-1].T), g[:, -1].copy()
        out[order] += own_out
        if derive:
            back[order] += own_back
        return out, back

    def train(self, docs: Iterable[np.ndarray], epochs: int = 1) -> int:
        """Train on every token of the documents and tell how many there were. Documents run whole, one after another, in
        streams side by side; the state starts anew after each end."""
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        done = tokens = 0
        for _ in range(epochs):
            for before, targets, h, real in self._windows(docs):
                done += 1
                tokens += int(real.sum())
                h[:] = self._update(before, targets, h, moments, done, done + DECAY, None if real.all() else real)
        return tokens

    def _windows(self, docs: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        """(symbols before, targets, states to be replaced, which targets are real) of each window of the streams. All
        streams run while each has a window of tokens; what is left at the end runs in longer windows of fewer streams."""
        queues: list[np.ndarray] = []
        for dealt in _dealt(docs):
            if not queues:
                wide = min(STREAMS, max(1, sum(map(len, dealt)) // (64 * STEPS)))
                queues = [np.empty(0, np.int64)] * wide
                states, last = np.zeros((wide, HIDDEN), np.float32), np.full(wide, self.size)
            heap = [(len(q), i) for i, q in enumerate(queues)]
            heapq.heapify(heap)
            parts = [[q] for q in queues]
            for d in sorted(dealt, key=len, reverse=True):
                n, i = heap[0]
                parts[i].append(d)
                heapq.heapreplace(heap, (n + len(d), i))
            queues = [np.concatenate(x) for x in parts]
            long = min(map(len, queues)) // STEPS * STEPS
            rows = np.stack([q[:long] for q in queues])
            queues = [q[long:].copy() for q in queues]
            for lo in range(0, long, STEPS):
                targets = rows[:, lo : lo + STEPS]
                yield np.column_stack((last, targets[:, :-1])), targets, states, np.ones(targets.shape, bool)
                last = targets[:, -1]
        live = [i for i, q in enumerate(queues) if len(q)]
        while live:
            live.sort(key=lambda i: -len(queues[i]))
            steps = min(STEPS * (len(queues) // len(live)), len(queues[live[0]]))
            targets, real = np.full((len(live), steps), self.size), np.zeros((len(live), steps), bool)
            for k, i in enumerate(live):
                own = queues[i][:steps]
                targets[k, : len(own)], real[k, : len(own)] = own, True
                queues[i] = queues[i][steps:]
            h = states[live]
            yield np.column_stack((last[live], targets[:, :-1])), targets, h, real
            states[live], last[live] = h, targets[:, -1]
            live = [i for i in live if len(queues[i])]

    def _update(self, before, targets, h, moments, done, total, real=None) -> np.ndarray:
        p, (wide, steps) = self.p, before.shape
        symbols = before.T
        keep = (symbols != self.size)[:, :, None].astype(h.dtype)
        inputs, state = _by_gate(p["in"] + p["bias"]), _by_gate(p["state"])
        prev, z, r, n, u, hs = (np.empty((steps, wide, HIDDEN), h.dtype) for _ in range(6))
        for t in range(steps):
            prev[t] = h * keep[t]
            h, z[t], r[t], n[t], u[t] = self._step(np.take(inputs, symbols[t], axis=1), prev[t], state)
            hs[t] = h
        grad: dict[str, np.ndarray] = {}
        rows = slice(None) if real is None else real.T.reshape(-1)
        flat = hs.reshape(-1, HIDDEN)
        back = np.zeros_like(flat)
        _, back[rows] = self.log_outputs(flat[rows], targets.T.reshape(-1)[rows], grad)
        back = back.reshape(hs.shape)
        by_n = (1 - z) * (1 - n * n)  # what a state's derivative is multiplied by for its candidate, gates and inputs
        by_u = np.stack(((prev - n) * z * (1 - z), by_n * u * r * (1 - r), by_n * r), axis=1)
        gus, state = np.empty((steps, 3, wide, HIDDEN), h.dtype), np.ascontiguousarray(state.transpose(0, 2, 1))
        carry = np.zeros((wide, HIDDEN), h.dtype)
        for t in reversed(range(steps)):
            carry += back[t]
            np.multiply(carry, by_u[t], out=gus[t])
            by_n[t] *= carry
            carry = (carry * z[t] + np.matmul(gus[t], state).sum(axis=0)) * keep[t]
        gus = gus.transpose(0, 2, 1, 3).reshape(steps, wide, 3 * HIDDEN)
        grad["state"] = prev.reshape(-1, HIDDEN).T @ gus.reshape(-1, 3 * HIDDEN)
        gus[:, :, 2 * HIDDEN :] = by_n
        gus, symbols = gus.reshape(-1, 3 * HIDDEN), symbols.reshape(-1)
        order = np.argsort(symbols.astype(np.uint16 if len(p["in"]) <= 1 << 16 else np.int32), kind="stable")
        kinds = symbols[order]
        first = np.flatnonzero(np.concatenate(([True], kinds[1:] != kinds[:-1])))
        grad["in"] = np.zeros_like(p["in"])
        grad["in"][kinds[first]] = np.add.reduceat(np.take(gus, order, axis=0), first, axis=0)
        grad["bias"] = gus.sum(axis=0)
        scale = np.float32(1 / (wide * steps if real is None else real.sum()))
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grad.values())) * scale
        scale *= np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        rate = RATE * (1 - 0.9 * done / total)
        for k, g in grad.items():
            _descend(p[k], g, *moments[k], scale, rate, done)
        return h

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 of the probability of each document's classes and frequent words, in document order."""
        out = np.zeros(len(docs))
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        inputs, weights = _by_gate(self.p["in"] + self.p["bias"]), _by_gate(self.p["state"])
        for g in range(0, len(order), LOCKSTEP):
            own = order[g : g + LOCKSTEP]
            n = sizes[own]
            flat = np.concatenate([docs[i] for i in own])
            first = np.concatenate(([0], np.cumsum(n)[:-1]))
            h = np.zeros((len(own), HIDDEN), np.float32)
            last = np.full(len(own), self.size)
            for lo in range(0, int(n[0]), WINDOW):
                live = int((n > lo).sum())
                steps = lo + np.arange(min(WINDOW, int(n[0]) - lo))[:, None]
                symbols = np.take(flat, first[:live] + np.minimum(steps, n[:live] - 1))
                hs = np.empty((*symbols.shape, HIDDEN), np.float32)
                state, before = h[:live], last[:live]
                for t in range(len(steps)):
                    hs[t] = state = self._step(np.take(inputs, before, axis=1), state, weights)[0]
                    before = symbols[t]
                h[:live], last[:live] = state, before
                real = steps < n[:live]
                whole = real.all()
                logs, _ = self.log_outputs(hs.reshape(-1, HIDDEN) if whole else hs[real], symbols.reshape(-1) if whole else symbols[real])
                if whole:
                    out[own[:live]] += logs.reshape(-1, live).sum(axis=0)
                else:
                    out[own[:live]] += np.bincount(np.nonzero(real)[1], weights=logs, minlength=live)
        return out / _LN10


def _dealt(docs: Iterable[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Lists of documents with ``DEALT`` tokens or a little more; the last may have fewer."""
    own, n = [], 0
    for d in docs:
        own.append(d)
        n += len(d)
        if n >= DEALT:
            yield own
            own, n = [], 0
    if n:
        yield own


def count_tokens(docs: DataFrame) -> DataFrame:
    """(h, c): how often each token occurs in the training rows, the end excepted; from a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes, _ = word_hashes(texts(pa.chunked_array([batch.column("text")])), SPACED)
            kinds, times = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(times.astype(np.int64))], names=["h", "c"])

    training = docs.filter(~held_out("doc_id", 7, 2)).select(F.col("text").cast("string").alias("text"))
    return cut(training.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "token-counts")


def vocabulary(counts: DataFrame, ends: int, most: int = HEAD) -> tuple[Vocabulary, int]:
    """The vocabulary, and the least count in its head: the lowest at which the head has at most ``most`` tokens."""
    step = F.floor(F.log2("c") * 16).cast("int")
    groups = (
        counts.groupBy(step.alias("g"))
        .agg(F.count("*").alias("n"), F.sum("c").alias("s"), F.min("c").alias("least"))
        .collect()
    )  # some hundreds of rows at most
    least, size = 1 << 62, 0
    for r in sorted(groups, key=lambda r: -r["g"]):
        size += r["n"]
        if size > most:
            break
        least = r["least"]
    head = counts.filter(F.col("c") >= least).toPandas()
    hashes = head["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    total, distinct = sum(r["s"] for r in groups), sum(r["n"] for r in groups)
    return (
        Vocabulary(
            hashes[order], head["c"].to_numpy(dtype=np.int64)[order], total + ends, distinct + (ends > 0), ends
        ),
        least,
    )


def fit(docs: DataFrame, words: Vocabulary) -> Network:
    """Train a network on all training rows, in ``ROUNDS``."""
    network = Network(words)
    eighth = F.pmod(F.xxhash64("doc_id", F.lit("lm")), F.lit(8))
    training = docs.filter(~held_out("doc_id", 7, 2)).select(eighth.alias("eighth"), F.col("text").cast("string").alias("text"))
    for own in ROUNDS:
        network.tokens += _round(training.filter(F.col("eighth").isin(list(own))).select("text"), words, network)
    return network


def _round(rows: DataFrame, words: Vocabulary, network: Network) -> int:
    """Replace the network by the mean of copies trained by each task on its rows, and tell how many tokens there were.
    Blocks of the copies are averaged by a shuffle, so that the driver gets one network however many tasks there are."""
    sent = rows.sparkSession.sparkContext.broadcast((words, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net = sent.value
        net = copy.deepcopy(net)  # a worker may run several tasks

        def docs() -> Iterator[np.ndarray]:
            for batch in pieces(batches):
                hashes, at = word_hashes(texts(pa.chunked_array([batch.column("text")])), SPACED)
                symbols = v.symbols(hashes)
                for a, b in zip(at[:-1], at[1:], strict=True):
                    yield np.append(symbols[a:b], v.end)

        if n := net.train(docs()):
            flat = np.concatenate([x.ravel() for x in net.p.values()])
            blocks = [flat[lo : lo + BLOCK].tobytes() for lo in range(0, len(flat), BLOCK)]
            k = len(blocks)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(k), pa.int32()), pa.array([part] * k, pa.int32()), pa.array([n] * k, pa.int64()), pa.array(blocks, pa.binary())],
                names=["block", "part", "n", "data"],
            )

    def mean(copies: pa.Table) -> pa.Table:
        total, sums = 0, 0.0
        for x in sorted(copies.to_pylist(), key=lambda x: x["part"]):
            total += x["n"]
            sums = sums + x["n"] * np.frombuffer(x["data"], np.float32).astype(np.float64)
        return pa.table({"block": copies["block"][:1], "n": [total], "data": pa.array([(sums / total).astype(np.float32).tobytes()], pa.binary())})

    copies = rows.mapInArrow(run, "block int, part int, n long, data binary")
    found = sorted(copies.groupBy("block").applyInArrow(mean, "block int, n long, data binary").collect())
    sent.unpersist()
    if not found:
        return 0
    flat = np.frombuffer(b"".join(r["data"] for r in found), np.float32)
    lo = 0
    for k, x in network.p.items():
        network.p[k] = flat[lo : lo + x.size].reshape(x.shape).copy()
        lo += x.size
    return found[0]["n"]


_PARTS = (
    "uid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, n_rare long, rare_logs double, "
    "network double, tail array<struct<h: long, n: int>>"
)


def parts(docs: DataFrame, words: Vocabulary, network: Network) -> DataFrame:
    """One row for each document: what head and network tell, and the tokens that the head doesn't have."""
    sent = docs.sparkSession.sparkContext.broadcast((words, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        v, net = sent.value
        for batch in pieces(batches):
            hashes, at = word_hashes(texts(pa.chunked_array([batch.column("text")])), SPACED)
            symbols, counts = v.look_up(hashes)
            logs = np.where(counts > 0, np.log10(np.maximum(counts, 0) + 1.0), 0.0)
            sums = lambda x, at=at: np.diff(np.concatenate(([0.0], np.cumsum(x)))[at])
            rare = symbols > v.end
            docs_symbols = [np.append(symbols[a:b], v.end) for a, b in zip(at[:-1], at[1:], strict=True)]
            kinds, times, ends = [], [], [0]
            for a, b in zip(at[:-1], at[1:], strict=True):
                k, n = np.unique(hashes[a:b][counts[a:b] < 0], return_counts=True)
                kinds.append(k)
                times.append(n)
                ends.append(ends[-1] + len(k))
            h = np.concatenate(kinds).astype(np.uint64).view(np.int64)
            tail = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()),
                pa.StructArray.from_arrays([pa.array(h), pa.array(np.concatenate(times).astype(np.int32))], ["h", "n"]),
            )
            n = len(at) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(uid, uid + n)),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(np.diff(at) + 1),
                    pa.array(sums((counts > 0).astype(float)).round().astype(np.int64)),
                    pa.array(sums(logs)),
                    pa.array(sums(rare.astype(float)).round().astype(np.int64)),
                    pa.array(sums(np.where(rare, logs, 0.0))),
                    pa.array(net.score(docs_symbols)),
                    tail,
                ],
                names=[x.split()[0] for x in _PARTS.split(", ")[:9]] + ["tail"],
            )
            uid += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 7, 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(run, _PARTS), "lm-parts")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    ends = docs.filter(~held_out("doc_id", 7, 2)).count()
    counts = count_tokens(docs)
    words, least = vocabulary(counts, ends)
    rows = parts(docs, words, fit(docs, words))
    tail = rows.select("uid", F.explode("tail").alias("x")).select("uid", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    # a token that training doesn't have adds log10(0 + 1), so only those that it has are joined
    found = (
        tail.join(counts.filter(F.col("c") < least), "h")
        .groupBy("uid")
        .agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("tail_logs"), F.sum("n").alias("tail_known"))
    )
    tail_logs = F.coalesce(F.col("tail_logs"), F.lit(0.0))
    base = float(np.log10(words.total + words.distinct + 1))
    rare = float(np.log10(words.rare_total))
    end = float(np.log10(ends + 1))
    return (
        rows.drop("tail")
        .join(found, "uid", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + F.coalesce(F.col("tail_known"), F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
            F.lit(words.total).cast("long").alias("train_tokens"),
            (F.col("logs") + tail_logs + F.lit(end) - F.col("n_tokens") * F.lit(base)).alias("base_score"),
            (F.col("network") + F.col("rare_logs") + tail_logs - F.col("n_rare") * F.lit(rare)).alias("score"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERY = {"op10_gated_recurrent_lm": query}
ORACLE: dict[str, str] = {}
