"""Similarity join of texts by the Jaccard index of their five-word shingles: a MinHash LSH forest, then exact checks.

Every distinct text has ``TREES`` labels of up to ``LONGEST`` minhashes. A tree of the forest is the sorted trie of the
texts' labels; texts under one node share a prefix. Matching starts with the longest prefixes, which find the close copies
cheaply, and takes one minhash off them at a time:

* at the longest, each text is first compared with the first one under its node, and those that match form components;
* at every length, under nodes that still hold several components, small nodes give all pairs across components that were
  not compared before, large ones stars around two members; matches join components;
* matching ends at the length at which a pair as little similar as the least similar match so far shares a prefix in some
  tree with probability ``TARGET``, if no large node is open there (``enough``). Close copies alone need no short
  prefixes; links near the threshold shorten them to the length that ``TARGET`` asks for at the threshold itself, where
  what is left of large nodes is compared block against block.

A link less similar than all matches is lost only if every such link was missed: by the longest prefixes with probability
0.003 each, if it lies at the threshold. All matches are verified on the texts themselves. Equal texts are one vertex
throughout, found by digest. Components of at most ``EDGES`` edges are found on the driver, others come from alternating large
and small stars, each step cut in the shared folder.
Links are then counted within components, where all links lie: small components share a task, large ones are compared in
blocks against each other as matrix products, so that pairs of a large group are counted but never made rows. A block has
about ``BLOCK`` texts or ``BLOCK_SHINGLES`` shingles, whichever are fewer, so that groups of long texts need no more memory
than others. A text that is compared with very many others is copied for each ``RAYS`` of them. The tables between the steps
are deleted once the result is written.

Results: one row for each row of the table with the class (its smallest doc_id) and the number of other rows whose text
is equal or at least ``THRESHOLD`` similar. Edge cases: words are runs of letters, digits and non-ASCII characters, A-Z
in lower case; a text of fewer than five words has one shingle, all its words; equal texts are linked even if they have
no word, but null and empty texts are linked to nothing and are classes of their own; a null doc_id is never the
smallest unless a class has no other; repeated rows are copies like any other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import MASK, Cuts, mix, table, texts, word_hashes
from strandlog.llm.common import cut as write_cut

SHINGLE, THRESHOLD = 5, 0.8
#: The number of trees is a power of two and at most 32, as a node's last bits are its tree.
TREES, LONGEST, TARGET = 32, 8, 0.9999
#: Nodes up to this size give all their pairs.
SMALL_NODE = 32
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
#: Comparisons with one text that one task makes, about.
RAYS = 4096
#: Edges that the driver joins to components by itself, 16 bytes each.
EDGES = 1_000_000
#: Bytes of text whose shingles are held at once.
PIECE = 2 << 20
_BYTES = 2


def recall(prefix: int, similarity: float = THRESHOLD, trees: int = TREES) -> float:
    """Probability that two texts of this similarity share a prefix of this length in some tree."""
    return 1 - (1 - similarity**prefix) ** trees


def shortest_prefix(target: float = TARGET) -> int:
    length = LONGEST
    while length > 1 and recall(length) < target:
        length -= 1
    return length


def enough(prefix: int, least: float | None, target: float = TARGET) -> bool:
    """Whether pairs as similar as the least similar match are found at this length; without matches there are none to find."""
    return least is None or recall(prefix, least) >= target


def shingle_sets(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all documents' shingles, sorted and distinct within each, and where each document's begin."""
    words, at = word_hashes(docs)
    sizes = np.diff(at)
    spread = [mix(words + np.uint64(0x632BE59BD9B4E019 * (k + 1) & MASK)) for k in range(SHINGLE)]
    out, ends = [], [0]
    n = len(words)
    rolled = np.zeros(max(0, n - SHINGLE + 1), dtype=np.uint64)
    for k in range(SHINGLE if len(rolled) else 0):
        rolled += spread[k][k : k + len(rolled)]
    for i, size in enumerate(sizes.tolist()):
        if size >= SHINGLE:
            own = np.unique(rolled[at[i] : at[i + 1] - SHINGLE + 1])
        elif size:
            own = sum((spread[k][at[i] + k : at[i] + k + 1] for k in range(size)), np.zeros(1, np.uint64))
        else:
            own = np.empty(0, np.uint64)
        out.append(own)
        ends.append(ends[-1] + len(own))
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.array(ends)


_seeds = np.random.default_rng(20240229)
_A = _seeds.integers(0, 1 << 32, TREES * LONGEST, dtype=np.uint32) | np.uint32(1)
_B = _seeds.integers(0, 1 << 32, TREES * LONGEST, dtype=np.uint32)


def signatures(sets: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """Labels of every document, tree after tree; None for documents without words."""
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return [None] * (len(at) - 1)
    x = ((sets >> np.uint64(32)) ^ sets).astype(np.uint32)
    labels = np.empty((len(full), TREES * LONGEST), dtype=">u2")
    bounds = at[:-1][full]
    for lo in range(0, len(full), 256):
        hi = min(lo + 256, len(full))
        part = x[bounds[lo] : bounds[hi] if hi < len(full) else len(x)]
        first = bounds[lo:hi] - bounds[lo]
        for k in range(TREES * LONGEST):
            least = np.minimum.reduceat(part * _A[k] + _B[k], first)
            labels[lo:hi, k] = (least ^ (least >> np.uint32(16))) & np.uint32(0xFFFF)
    out: list[bytes | None] = [None] * (len(at) - 1)
    for i, row in zip(full.tolist(), labels, strict=True):
        out[i] = row.tobytes()
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text); the key is the text's digest, null for null and empty texts."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.length(text) > 0, F.unhex(F.md5(text.cast("binary")))).alias("key"),
        text.alias("text"),
    )


def _signed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, labels, sizes, lo = texts(pa.chunked_array([batch.column("text")])), [], [], 0
            while lo < len(raw):  # some megabytes of text at once, whatever the batch holds
                size, hi = 0, lo
                while hi < len(raw) and (hi == lo or size + len(raw[hi]) <= PIECE):
                    size, hi = size + len(raw[hi]), hi + 1
                sets, at = shingle_sets(raw[lo:hi])
                labels += signatures(sets, at)
                sizes += np.diff(at).tolist()
                lo = hi
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(labels, pa.binary()), pa.array(sizes, pa.int64())],
                names=["doc_id", "key", "labels", "shingles"],
            )

    return _keyed(docs).mapInArrow(run, "doc_id long, key binary, labels binary, shingles long")


def _nodes(vertices: DataFrame, prefix: int) -> DataFrame:
    """(node, rid): the trie node of this depth in each of the text's ``trees``, a mask. A node's last bits are its tree."""
    tree = vertices.select("rid", "labels", "trees", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    tree = tree.filter("(trees & shiftleft(1L, tree)) <> 0")
    label = F.substring("labels", F.col("tree") * (LONGEST * _BYTES) + 1, F.lit(prefix * _BYTES))
    node = F.shiftleft(F.xxhash64("tree", label), TREES.bit_length() - 1).bitwiseOR(F.col("tree").cast("long"))
    return tree.select(node.alias("node"), "rid")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sets of shingles where it reaches the threshold, else 0."""
    if not len(a) or not len(b) or min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)) - 1e-9:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if both >= THRESHOLD * either - 1e-9 else 0.0


def _compared(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The (a, b) pairs with the similarity of their texts. The first of a pair may be in very many, so its text is salted."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / RAYS).cast("int").alias("salts")).filter("salts > 1")
    some = F.coalesce("salts", F.lit(1))
    dealt = pairs.join(salts, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), some).cast("int")).select("a", "b", "salt")
    first = held.select(F.col("rid").alias("a"), F.col("text").alias("ta")).join(salts, "a", "left")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), some - 1))).select("a", "salt", "ta")
    rows = (
        dealt.join(first, ["a", "salt"])
        .join(held.select(F.col("rid").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            alike = []
            for lo in range(0, len(a), 256):
                raw: dict[int, bytes] = {}
                for ids, name in ((a, "ta"), (b, "tb")):
                    part = pa.chunked_array([batch.column(name).slice(lo, 256)])
                    raw.update(zip(ids[lo : lo + 256], texts(part), strict=True))
                order = {r: k for k, r in enumerate(raw)}
                sets, at = shingle_sets(list(raw.values()))
                own = lambda r, o=order, s=sets, p=at: s[p[o[r]] : p[o[r] + 1]]
                alike += [similarity(own(x), own(y)) for x, y in zip(a[lo : lo + 256], b[lo : lo + 256], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(alike, pa.float64())], names=["a", "b", "similarity"]
            )

    return rows.mapInArrow(run, "a long, b long, similarity double")


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All vertices of the edges between a and b, sorted, and the least vertex of each one's component."""
    vertices, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    least = np.arange(len(vertices))
    while True:
        x, y = least[u], least[v]
        apart = x != y
        if not apart.any():
            return vertices, vertices[least]
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(least, further := least[least]):
            least = further


def components(edges: DataFrame, cut: Cuts) -> DataFrame:
    """(rid, comp) of all vertices with an edge; comp is the component's least vertex."""
    if edges.count() <= EDGES:
        few = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").toArrow()
        vertices, least = least_reached(few["a"].to_numpy(), few["b"].to_numpy())
        found = pd.DataFrame({"rid": vertices.astype(np.int64), "comp": least.astype(np.int64)})
        return edges.sparkSession.createDataFrame(pa.Table.from_pandas(found, preserve_index=False))
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        # large star: every larger neighbour gets the least of the neighbourhood
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).filter("u <> v").distinct()
        # small star: a vertex and its smaller neighbours get the least of them
        large = cut(large, "large-star")
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.filter("u <> v").union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
        edges = cut(small, "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
    members = edges.select(F.col("u").alias("rid"), F.col("v").alias("comp"))
    return members.union(edges.select(F.col("v").alias("rid"), F.col("v").alias("comp")).distinct())


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs. Shingles that few of the sets hold are counted pair by pair, the others
    by a product of their incidence matrix."""
    n = len(sets)
    out = np.zeros((n, n), dtype=np.float32)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets) if n else np.empty(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(flat)))
    for k in range(2, 13):
        own = first[times == k]
        if len(own):
            who = owner[own[:, None] + np.arange(k)]
            for i in range(k):
                for j in range(k):
                    if i != j:
                        np.add.at(out, (who[:, i], who[:, j]), 1)
    often = np.flatnonzero(times > 12)
    for lo in range(0, len(often), 4096):
        part = often[lo : lo + 4096]
        held = np.zeros((n, len(part)), dtype=np.float32)
        for c, k in enumerate(part.tolist()):
            held[owner[first[k] : first[k] + times[k]], c] = 1
        out += held @ held.T
    return out


def _links(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs are similar; none with itself."""
    both = intersections(sets).astype(np.float64)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    linked = (both > 0) & (both >= THRESHOLD * (sizes[:, None] + sizes[None, :] - both) - 1e-9)
    np.fill_diagonal(linked, False)
    return linked


def _count_blocks(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(rid, links): copies behind the similar texts of the same component. rows: rid, comp, size, weight (the component's
    shingles), shingles, copies."""
    total, shingles = rows.agg(F.count("*"), F.sum("shingles")).head()
    bins = max(1, -(-total // (BLOCK // 2)), -(-(shingles or 0) // (BLOCK_SHINGLES // 2)))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    placed = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "rid", "comp", "copies", "own",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        F.when(F.col("blocks") > 1, F.col("comp")).otherwise(-1 - F.pmod(F.xxhash64("comp"), F.lit(bins))).alias("bin"),
    )

    def count(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        i, j = key[1], key[2]
        found = []
        for _, own in group.groupby("comp"):
            if len(own) > 1:
                sets, at = shingle_sets([t.encode() for t in own["text"]])
                linked = _links([sets[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
                side, copies = own["own"].to_numpy(), own["copies"].to_numpy()
                if i != j:  # pairs within a block are counted where it meets itself
                    linked &= side[:, None] != side[None, :]
                found.append(pd.DataFrame({"rid": own["rid"].to_numpy(), "links": linked @ copies}))
        return pd.concat(found) if found else pd.DataFrame({"rid": [], "links": []})

    return (
        placed.join(held, "rid")
        .groupBy("bin", "i", "j")
        .applyInPandas(count, "rid long, links long")
        .groupBy("rid")
        .agg(F.sum("links").alias("links"))
    )


def _join_blocks(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all similar members, of different components, of each node. rows: node, rid, comp, n, shingles."""
    weights = rows.groupBy("node").agg(F.sum("shingles").alias("weight"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    placed = rows.join(weights, "node").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("node", "rid", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def edges(group: pd.DataFrame) -> pd.DataFrame:
        sets, at = shingle_sets([t.encode() for t in group["text"]])
        linked = _links([sets[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
        comp, rid = group["comp"].to_numpy(), group["rid"].to_numpy()
        linked &= comp[:, None] != comp[None, :]
        a, b = np.nonzero(np.triu(linked))
        pairs = pd.DataFrame({"a": rid[a], "b": rid[b], "ca": comp[a], "cb": comp[b]})
        return pairs.drop_duplicates(["ca", "cb"])[["a", "b"]]  # one link between two components is enough

    return placed.join(held, "rid").groupBy("node", "i", "j").applyInPandas(edges, "a long, b long").distinct()


def _open_nodes(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of nodes that hold several components, with the node's size, its first and last text and their components."""
    rows = nodes.select("node", "rid").join(members, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    several = rows.groupBy("node").agg(
        F.count("*").alias("n"),
        F.min("comp").alias("c1"),
        F.max("comp").alias("c2"),
        F.min("rid").alias("least"),
        F.min_by("comp", "rid").alias("least_comp"),
        F.max("rid").alias("most"),
        F.max_by("comp", "rid").alias("most_comp"),
    )
    return rows.join(several.filter("c1 <> c2").drop("c1", "c2"), "node")


def _across(met: DataFrame, before: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components under open nodes, without those compared before: all of small nodes, of large
    ones stars around the first and the last text."""
    small = met.filter(F.col("n") <= SMALL_NODE)
    left = small.select("node", F.col("rid").alias("a"), F.col("comp").alias("ca"))
    right = small.select("node", F.col("rid").alias("b"), F.col("comp").alias("cb"))
    pairs = left.join(right, "node").filter("a < b and ca <> cb").select("a", "b")
    large = met.filter(F.col("n") > SMALL_NODE)
    for centre in ("least", "most"):
        rays = large.filter(F.col("comp") != F.col(f"{centre}_comp"))
        pairs = pairs.union(rays.select(F.col(centre).alias("a"), F.col("rid").alias("b")))
    lower, upper = F.least("a", "b").alias("lower"), F.greatest("a", "b").alias("upper")
    pairs = pairs.groupBy(lower, upper).agg(F.min("a").alias("a"), F.min_by("b", "a").alias("b"))
    return pairs.join(before.select(lower, upper), ["lower", "upper"], "left_anti").select("a", "b")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, class_id, n_links, stays) of every row, from a table in the shared folder; see the module's text."""
    cut = Cuts(docs.sparkSession)
    try:
        return write_cut(_classes(docs, cut), "classes")
    finally:
        cut.drop()


def _classes(docs: DataFrame, cut: Cuts) -> DataFrame:
    signed = cut(_signed(docs), "labels")
    copies = signed.filter("key is not null").groupBy("key")
    vertices = copies.agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("labels").alias("labels"), F.first("shingles").alias("shingles")
    )
    vertices = cut(vertices.withColumn("rid", F.monotonically_increasing_id()), "vertices")
    worded = vertices.filter("labels is not null").withColumn("trees", F.lit((1 << TREES) - 1).cast("long"))
    last = shortest_prefix()
    nodes = _nodes(worded, last)
    shared = nodes.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    nodes = cut(nodes.join(shared, "node"), "nodes")  # texts that share no node at the shortest prefix have no match
    # nor do they share one at a longer prefix in a tree where they share none at the shortest
    trees = F.expr(f"bit_or(shiftleft(1L, CAST(node & {TREES - 1} AS INT)))").alias("trees")
    wanted = worded.drop("trees").join(nodes.groupBy("rid").agg(trees), "rid")
    wanted = wanted.select("rid", F.col("rep").alias("doc_id"), F.col("key").alias("own"), "labels", "trees", "copies", "shingles")
    wanted = cut(wanted, "wanted")
    full = _keyed(docs).filter("key is not null")
    held = (
        full.join(wanted.select("rid", F.col("doc_id").alias("rep"), "own"),
                  full["doc_id"].eqNullSafe(F.col("rep")) & (full["key"] == F.col("own")))
        .select("rid", "text")
    )
    if not signed.groupBy("doc_id", "key").count().filter("count > 1 and key is not null").isEmpty():
        held = held.groupBy("rid").agg(F.first("text").alias("text"))  # rows repeated under one id
    held = cut(held, "texts")

    # stars around the first text under each node of the longest prefixes
    deep = cut(_nodes(wanted, LONGEST), "nodes")
    centres = deep.groupBy("node").agg(F.min("rid").alias("a"), F.count("*").alias("n")).filter("n > 1")
    stars = deep.join(centres, "node").filter("rid <> a").select("a", F.col("rid").alias("b")).distinct()
    compared = cut(_compared(stars, held), "compared")
    members = cut(components(compared.filter("similarity > 0").select("a", "b"), cut), "components")

    def joined(members: DataFrame, edges: DataFrame) -> DataFrame:
        known = members.select(F.col("rid").alias("a"), F.col("comp").alias("b"))
        return cut(components(known.union(edges.select("a", "b")), cut), "components")

    for prefix in range(LONGEST, last - 1, -1):
        level = {LONGEST: deep, last: nodes}.get(prefix)
        level = _nodes(wanted, prefix) if level is None else level
        met = cut(_open_nodes(level, members), "meetings")
        now = cut(_compared(_across(met, compared), held), "compared")
        compared = compared.union(now)
        matches = now.filter("similarity > 0")
        if not matches.isEmpty():
            members = joined(members, matches)
        large = met.filter(F.col("n") > SMALL_NODE)
        if prefix > last:
            least = compared.filter("similarity > 0").agg(F.min("similarity")).head()[0]
            if enough(prefix, least) and (large.isEmpty() or _open_nodes(large, members).isEmpty()):
                break
        elif not large.isEmpty():
            rest = _open_nodes(large, members).select("node", "rid", "comp", "n")
            rest = cut(rest.join(wanted.select("rid", "shingles"), "rid"), "open")
            members = joined(members, cut(_join_blocks(rest, held), "matches"))

    rows = members.join(wanted.select("rid", "copies", "shingles"), "rid")
    grouped = rows.groupBy("comp").agg(F.count("*").alias("size"), F.sum("shingles").alias("weight"))
    rows = rows.join(grouped, "comp")
    links = _count_blocks(cut(rows, "members"), held)
    named = vertices.select("rid", "key", "rep", "copies").join(members, "rid", "left")
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep"), F.col("key"))).alias("first")
    least = named.filter("comp is not null").groupBy("comp").agg(first)
    named = (
        named.join(least, "comp", "left")
        .join(links, "rid", "left")
        .select(
            F.col("key").alias("k"),
            F.when(F.col("first").isNull(), F.col("rep")).otherwise(F.col("first.rep")).alias("class"),
            F.coalesce("first.key", "key").alias("kept"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
    )
    result = signed.select("doc_id", "key").join(named, F.col("key") == F.col("k"), "left")
    grouped = F.col("k").isNotNull()
    return result.select(
        "doc_id",
        "key",
        F.when(grouped, F.col("class")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(grouped, (F.col("key") == F.col("kept")) & F.col("doc_id").eqNullSafe(F.col("class"))).otherwise(True).alias("stays"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class, that with the smallest doc_id; null and empty texts all stay. Columns stay as they are."""
    found = classes(docs)
    surplus = found.filter("not stays").select(F.col("doc_id").alias("_dropped"), F.col("key").alias("_own")).distinct()
    text = docs["text"].cast("string")
    digest = F.when(F.length(text) > 0, F.unhex(F.md5(text.cast("binary"))))
    same = docs["doc_id"].cast("long").eqNullSafe(surplus["_dropped"]) & (digest == surplus["_own"])
    rows = docs.join(surplus, same, "left_anti")
    again = found.filter("stays and key is not null").groupBy("doc_id", "key").count().filter("count > 1")
    if again.isEmpty():
        return rows
    # rows repeated under one id; texts without a class are set aside
    return rows.filter(digest.isNotNull()).dropDuplicates(["doc_id", "text"]).unionByName(rows.filter(digest.isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


QUERY = {"op5_lsh_forest_ngram_join": query}
#: All pairs of distinct texts that share a shingle, and the closure of those that are similar.
ORACLE = {
    "op5_lsh_forest_ngram_join": r"""
WITH RECURSIVE d AS (SELECT md5(text) AS id, min(doc_id) AS rep, count(*) AS copies, any_value(text) AS text FROM documents WHERE text <> '' GROUP BY text),
w AS (SELECT id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
s AS (SELECT DISTINCT id, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
walk AS (SELECT id, id AS other FROM d UNION SELECT walk.id, sides.b FROM walk JOIN sides ON walk.other = sides.a),
c AS (SELECT walk.id, min(rep) AS class_id FROM walk JOIN d ON d.id = other GROUP BY walk.id),
l AS (SELECT a AS id, CAST(sum(copies) AS BIGINT) AS links FROM sides JOIN d ON d.id = b GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(copies - 1, 0) + coalesce(links, 0) AS n_links
FROM documents LEFT JOIN d ON documents.text = d.text LEFT JOIN c ON c.id = d.id LEFT JOIN l ON l.id = d.id"""
}
