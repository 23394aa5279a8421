"""Secret scan: patterns find candidates, a random forest removes the false ones.

Candidates are keys of known form (private keys in PEM blocks and web tokens as a whole), values assigned to telling names
(quoted or not), passwords in URLs, and long runs that mix letters and digits. The forest's features are the candidate's
length, its character transitions (changes between kinds of character, and the mean log-probability of its letter pairs in
ordinary words), its coverage by dictionary words, its path (the row's ``source``) and the words beside it. The dictionary
and the letter pairs are the corpus's own: its ``MOST_WORDS`` most frequent words, counted over all rows, beside some of
ordinary identifiers.

It is trained from labelled findings: rows of (text, start, end, path, secret), by default the rule-made ones of
``labelled_findings``, since no table of the corpus labels findings.

Edge cases: null and empty texts have no findings; a null source is an empty path; repeated rows have findings of their
own; overlapping candidates count once, known forms before assignments before runs; candidates are found in whole texts,
however long, and judged by their neighbourhood, so a long text's are those of its parts; without findings to learn from
all candidates are kept, with score 1, and findings of one kind alone give that kind; an empty table has the built-in
dictionary and gives no rows; other columns pass through ``redact`` untouched, and ``n_chars``, where there is one,
follows the text.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import arrow_map, cut, table

KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24,}"
    r"|xox[baprs]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9])"
    r"|-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=:,.\s\\-]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"
)
#: A known form holds one of these.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk_live_", "xox", "AIza", "eyJ", "PRIVATE KEY-----")
ASSIGNED = re.compile(
    r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)"
    r"[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([^\s\"'<>,;]{6,})"
)
#: scheme://user:password@host
URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@\"'<>]*:([^\s/@\"'<>]+)@")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Words that speak for a secret beside a candidate, and against one; words of ordinary identifiers and placeholders.
TELLING = frozenset("password passwd pwd secret token key api apikey access auth bearer credential private".split())
HARMLESS = frozenset(
    "commit sha sha1 sha256 md5 checksum hash digest uuid guid id revision version etag build ref blob request trace "
    "example sample placeholder dummy number order isbn session".split()
)
DICTIONARY = frozenset(
    "access account action admin application archive array author backup base batch buffer build button cache change "
    "client cloud code column commit config connection content control count data database date default delete demo "
    "document dummy element empty error event example factory field file filter form format function group handler "
    "header hello here image index input insert item javascript language level library list load local login manager "
    "message method model module name network node number object option order output package page parent password "
    "path place placeholder port private process product project property public query queue read record request reset "
    "response result sample schema script search secret select server service session simple source start state static "
    "status stream string style system table target task template test text time title token type update user valid "
    "value version view window word world your".split()
)
PATHS = re.compile(r"(?i)test|example|sample|doc|fixture|mock|demo|spec")
MARK = "[SECRET]"
CUT = 0.5
TREES, DEPTH, FINDINGS = 40, 10, 3000
#: Words of the corpus in the dictionary, at most, and their lengths.
MOST_WORDS, SHORTEST_WORD, LONGEST_WORD = 20_000, 4, 16


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind), in order."""
    found: list[tuple[int, int, str]] = []
    digits = re.search(r"\d", text)
    for kind, pattern, group, possible in (
        ("known", KNOWN, 0, any(p in text for p in PREFIXES)),
        ("assigned", URL, 1, "://" in text and "@" in text),
        ("assigned", ASSIGNED, 1, "=" in text or ":" in text),
        ("run", RUN, 0, digits),
    ):
        if not possible:
            continue
        for m in pattern.finditer(text):
            start, end = m.span(group)
            if kind == "run":
                value = m.group()
                if value.isalpha() or value.isdigit() or not re.search(r"\d", value) or not re.search(r"[A-Za-z]", value):
                    continue
            found.append((start, end, kind))
    found.sort(key=lambda x: (("known", "assigned", "run").index(x[2]), x[0]))
    return sorted(_apart(found))


def _apart(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Earlier ones win over later ones that overlap them."""
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for x in found:
        k = bisect.bisect_left(starts, x[1])
        if k and ends[k - 1] > x[0]:
            continue
        k = bisect.bisect_left(starts, x[0])
        starts.insert(k, x[0])
        ends.insert(k, x[1])
        out.append(x)
    return out


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _coverage(value: str, words: frozenset[str]) -> float:
    """Share of the characters inside dictionary words of at least four letters, longest first."""
    low, at, covered = value.lower(), 0, 0
    while at < len(low):
        for size in range(min(LONGEST_WORD, len(low) - at), SHORTEST_WORD - 1, -1):
            if low[at : at + size] in words:
                covered, at = covered + size, at + size
                break
        else:
            at += 1
    return covered / max(1, len(low))


class Language:
    """The dictionary, and smoothed log-probabilities of the second of two characters in its words."""

    def __init__(self, counts: dict[str, int]):
        self.words = frozenset(counts) | DICTIONARY
        self.pairs, self.firsts = Counter(), Counter()
        for word in sorted(self.words):
            n = math.log2(counts.get(word, 1) + 1)  # a word's weight grows slowly with its count
            for p in zip(word, word[1:], strict=False):
                self.pairs[p] += n
                self.firsts[p[0]] += n

    def mean(self, value: str) -> float:
        low = value.lower()
        logs = [math.log((self.pairs[p] + 0.5) / (self.firsts[p[0]] + 20)) for p in zip(low, low[1:], strict=False)]
        return sum(logs) / max(1, len(logs))


def language(docs: DataFrame | None, most: int = MOST_WORDS) -> Language:
    """The most frequent words of all rows, down to the count at which there would be more than ``most``."""
    if docs is None:
        return Language({})
    words = F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(f"([a-z]{{{SHORTEST_WORD},}})"), F.lit(1))
    counts = docs.select(F.explode(words).alias("w")).filter(F.length("w") <= LONGEST_WORD).groupBy("w").agg(F.count("*").alias("c"))
    counts = cut(counts.filter("c > 1"), "words")
    groups = counts.groupBy(F.floor(F.log2("c") * 16).alias("g")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()
    least, size = None, 0
    for r in sorted(groups, key=lambda r: -r["g"]):  # some hundreds at most
        size += r["n"]
        if size > most:
            break
        least = r["least"]
    if least is None:
        return Language({})
    return Language({r["w"]: r["c"] for r in counts.filter(F.col("c") >= least).collect()})


def features(text: str, start: int, end: int, kind: str, path: str, known: Language) -> list[float]:
    value = text[start:end]
    kinds = [_kind(c) for c in value]
    n = max(1, len(value))
    counts = Counter(value)
    before = re.findall(r"\w+", text[max(0, start - 40) : start].lower())[-3:]
    after = re.findall(r"\w+", text[end : end + 30].lower())[:2]
    left = text[max(0, start - 3) : start]
    return [
        math.log(n),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        known.mean(value),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        kinds.count(2) / n,
        kinds.count(1) / n,
        kinds.count(3) / n,
        _coverage(value, known.words),
        float(len(counts)) / n,
        float(bool(PATHS.search(path))),
        float(sum(w in TELLING for w in before)),
        float(sum(w in HARMLESS for w in before)),
        float(sum(w in HARMLESS for w in after)),
        float("=" in left or ":" in left),
        float('"' in left or "'" in left),
        float(("known", "assigned", "run").index(kind)),
        float(all(c in "0123456789abcdef" for c in value.lower())),
        float(value.count("-")),
    ]


class Forest:
    """Decision trees on bootstrap samples, each split over some features; flat arrays, so that rows go down together."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            own = rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[own], y[own], depth, rng))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, value = [], [], [], [], []

        def node(rows: np.ndarray, level: int) -> int:
            k = len(feature)
            share = float(y[rows].mean())
            feature.append(-1), cut.append(0.0), left.append(k), right.append(k), value.append(share)
            if level == 0 or len(rows) < 6 or share in (0.0, 1.0):
                return k
            best = (1e-9, -1, 0.0)
            n, whole = len(rows), share * (1 - share)
            for f in rng.choice(x.shape[1], 5, replace=False):
                v = x[rows, f]
                for t in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 13))):
                    low = v <= t
                    a = int(low.sum())
                    if 2 <= a <= n - 2:
                        p, q = y[rows[low]].mean(), y[rows[~low]].mean()
                        gain = whole - (a * p * (1 - p) + (n - a) * q * (1 - q)) / n
                        if gain > best[0]:
                            best = (gain, int(f), float(t))
            if best[1] >= 0:
                low = x[rows, best[1]] <= best[2]
                feature[k], cut[k] = best[1], best[2]
                left[k] = node(rows[low], level - 1)
                right[k] = node(rows[~low], level - 1)
            return k

        node(np.arange(len(y)), depth)
        return tuple(np.array(a) for a in (feature, cut, left, right, value))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                low = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(f < 0, at, np.where(low, left[at], right[at]))
            total += value[at]
        return total / len(self.trees)


def labelled_findings(n: int = FINDINGS, seed: int = 0) -> list[tuple[str, int, int, str, bool]]:
    """(text, start, end, path, secret) findings made by rule, half of them secrets: random values in the places where
    keys and passwords stand, against digests, identifiers, placeholders and ordinary words."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    hexa, upper, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    )
    words, vowels, rest = sorted(DICTIONARY), "aeiou", "bcdfghlmnprstvwy"
    filler = lambda: chars(rest, 1) + "".join(pick(vowels) + pick(rest) for _ in range(int(rng.integers(1, 4))))
    some = lambda: " ".join(filler() for _ in range(int(rng.integers(1, 8))))
    named = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth")
    placeholders = (
        "changeme123", "example123", "your_password_here", "test1234", "xxxxxxxxxxxx", "placeholder", "password123",
        "your-api-key-here", "sample_token_1", "dummy_secret",
    )
    password = lambda: pick((chars(mixed + "!$%^_-", int(rng.integers(8, 21))), filler() + filler()[:3] + chars("0123456789", int(rng.integers(1, 4))) + filler()[:3]))
    url = lambda: f"{pick(('https', 'http', 'ftp', 'postgres', 'mysql', 'redis', 'amqp'))}://{pick((filler(), 'admin', 'user', ''))}:"
    plain = ("commit", "sha1", "sha256", "md5", "checksum", "revision", "etag", "digest", "build", "ref")

    def secret() -> tuple[str, str, str]:
        how = int(rng.integers(12))
        if how == 10:
            part = lambda: chars(mixed + "_-", int(rng.integers(16, 60)))
            return pick(("", "token: ", "Authorization: Bearer ", "session=")), f"eyJ{part()}.{part()}.{part()}", ""
        if how == 11:
            kind = pick(("", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "))
            lines = "\n".join(chars(mixed + "+/", 64) for _ in range(int(rng.integers(2, 9))))
            return pick(("", "key:\n")), f"-----BEGIN {kind}PRIVATE KEY-----\n{lines}\n-----END {kind}PRIVATE KEY-----", ""
        if how == 0:
            return pick(("", "key ", "aws_access_key_id=", some() + " ")), pick(("AKIA", "ASIA")) + chars(upper, 16), ""
        if how == 1:
            return f'{pick(named)}{pick((" = ", "=", ": "))}"', chars(hexa, pick((32, 40, 64))), '"'
        if how == 2:
            return f"{pick(named[:4])}=", chars(hexa, int(rng.integers(12, 41))), ""
        if how == 3:
            return f"{pick(named[:4])}{pick((': ', '='))}", chars(mixed + "!$%^_-", int(rng.integers(8, 21))), ""
        if how == 4:
            return "Authorization: Bearer ", chars(mixed + "_-", int(rng.integers(24, 65))), ""
        if how == 5:
            return "", pick(("ghp_", "gho_")) + chars(mixed, 36), ""
        if how == 6:
            return pick(("", "key=")), "sk_live_" + chars(mixed, int(rng.integers(24, 33))), ""
        if how == 7:
            return f'{pick(named[3:])}{pick(("=", ": "))}"', chars(mixed + "+/", int(rng.integers(20, 65))), '"'
        if how == 8:
            return f'"{pick(named)}"{pick((": ", ":"))}"', password(), '"'
        return url(), password(), f"@{filler()}.net/{filler()}"

    def other() -> tuple[str, str, str]:
        how = int(rng.integers(11))
        if how == 0:
            return pick(plain) + pick((" ", ": ", "=")), chars(hexa, pick((32, 40, 64))), ""
        if how == 1:
            return pick(("id ", "uuid=", "request ", "trace ")), str(uuid.UUID(bytes=rng.bytes(16))), ""
        if how == 2:
            return some() + " ", "".join(pick(words).title() for _ in range(int(rng.integers(2, 5)))) + chars("0123456789", 2), ""
        if how == 3:
            return some() + " ", "_".join(pick(words) for _ in range(int(rng.integers(3, 5)))) + f"_{chars('0123456789', 1)}", ""
        if how == 4:
            return pick(named) + pick(("=", ": ")), pick(placeholders), ""
        if how == 5:
            return pick(("", "key ")), "AKIA" + pick(("IOSFODNN7EXAMPLE", "XXXXXXXXXXXXXXXX", "1234567890EXAMPL")), ""
        if how == 6:
            return pick(named) + ": ", filler() + filler(), ""
        if how == 7:
            return some() + " ", f"2024-0{pick('123456789')}-1{pick('0123456789')}T10-{chars('012345', 2)}Z", ""
        if how == 8:
            return f'"{pick(named)}": "', pick((pick(placeholders), filler() + filler())), '"'
        if how == 9:
            return url(), pick((pick(placeholders), "password", "pass")), f"@{filler()}.net/{filler()}"
        return some() + " ", "/".join(pick(words) for _ in range(4)) + f"-v{chars('0123456789', 2)}", ""

    found = []
    for k in range(n):
        real = k % 2 == 0
        before, value, after = secret() if real else other()
        head = some() + " " + before
        path = pick((f"src{pick('0123456789')}", filler(), "")) if rng.random() < (0.95 if real else 0.7) else pick(("test/a", "docs/example", "spec/mock"))
        found.append((f"{head}{value}{after} {some()}", len(head), len(head) + len(value), path, real))
    return found


class Keep:
    """What stands for the forest where there is nothing to learn from: every candidate is a finding."""

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.ones(len(x))


Model = tuple[Forest | Keep, Language]


def train(findings: list[tuple[str, int, int, str, bool]], known: Language | None = None) -> Model:
    """A forest from labelled findings; each must be a candidate's place in its text."""
    known = known or Language({})
    if not findings:
        return Keep(), known
    rows = []
    for text, start, end, path, _ in findings:
        kind = next((k for a, b, k in candidates(text) if a <= start < b), "run")
        rows.append(features(text, start, end, kind, path, known))
    return Forest(np.array(rows), np.array([real for *_, real in findings], dtype=float)), known


@functools.lru_cache(maxsize=1)
def _labelled() -> list[tuple[str, int, int, str, bool]]:
    return labelled_findings()


def default_model(docs: DataFrame | None = None) -> Model:
    """The forest of the rule-made findings, with the documents' own dictionary."""
    return train(_labelled(), language(docs))


def findings(texts: list[str], paths: list[str], model: Model) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, kind, score) of every candidate of each text."""
    forest, known = model
    places = [(i, *c) for i, t in enumerate(texts) for c in candidates(t)]
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    if places:
        scores = forest.score(np.array([features(texts[i], a, b, k, paths[i], known) for i, a, b, k in places]))
        for (i, a, b, k), s in zip(places, scores.tolist(), strict=True):
            out[i].append((a, b, k, s))
    return out


def _read(t: pa.Table) -> tuple[list[str], list[str]]:
    paths = t["source"].to_pylist() if "source" in t.column_names else [None] * t.num_rows
    return [x or "" for x in t["text"].to_pylist()], [str(x or "") for x in paths]


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row for each candidate: doc_id, start and length in characters, kind, value_crc32, score, is_secret."""
    sent = docs.sparkSession.sparkContext.broadcast(model or default_model(docs))

    def make():
        def step(t: pa.Table) -> pa.Table | None:
            texts, paths = _read(t)
            rows = []
            for doc_id, text, own in zip(t["doc_id"].to_pylist(), texts, findings(texts, paths, sent.value), strict=True):
                for a, b, kind, s in own:
                    rows.append((doc_id, a, b - a, kind, zlib.crc32(text[a:b].encode()), s, s >= CUT))
            if not rows:
                return None
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.bool_())
            names = ("doc_id", "start", "length", "kind", "value_crc32", "score", "is_secret")
            return pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*rows, strict=True), kinds, strict=True)})

        return step

    schema = "doc_id long, start long, length long, kind string, value_crc32 long, score double, is_secret boolean"
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", path.alias("source")), make, schema)


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All rows and columns, with a mark in place of each secret."""
    sent = docs.sparkSession.sparkContext.broadcast(model or default_model(docs))

    def make():
        def step(t: pa.Table) -> pa.Table:
            texts, paths = _read(t)
            new, changed = t["text"].to_pylist(), False
            for i, own in enumerate(findings(texts, paths, sent.value)):
                at, parts = 0, []
                for a, b, _, s in own:
                    if s >= CUT:
                        parts += [texts[i][at:a], MARK]
                        at = b
                if parts:
                    new[i], changed = "".join([*parts, texts[i][at:]]), True
            if not changed:
                return t
            before = t["text"].to_pylist()
            t = t.set_column(t.column_names.index("text"), t.schema.field("text"), pa.array(new, t.schema.field("text").type))
            if "n_chars" in t.column_names:
                field = t.schema.field("n_chars")
                old = t["n_chars"].to_pylist()
                sizes = [n if x == y else len(y) for n, x, y in zip(old, before, new, strict=True)]
                t = t.set_column(t.column_names.index("n_chars"), field, pa.array(sizes, field.type))
            return t

        return step

    return arrow_map(docs, make, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERY = {"op1_forest_secret_scan": query}
ORACLE: dict[str, str] = {}
