"""SimHash near-duplicates: 64-bit fingerprints, linked within a Hamming radius by BK-trees.

Texts with equal fingerprints form one class, so trees hold distinct fingerprints only. Fingerprints
within radius r agree on at least one of r + 1 blocks of bits; each block value is a shard, and the
links of a shard come from its BK-tree: children are keyed by their integer Hamming distance to the
parent, and a search follows only the edges within the radius. A shard with more than `shard_size`
fingerprints is split into trees of about that size, and its searches are sent to each of them. That
replaces a broadcast of all trees, whose size would grow with the corpus.

A shard gives a spanning forest of its links instead of all of them, and components follow by
alternating large-star and small-star steps over the forests' edges.

near_copies links texts of a given shingle similarity, which differ in more bits than blocks can
shard: there, shards are the texts that share a least shingle hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm._shared import groups, join_sized, lean, materialize, whole_groups

ROWS = 256
#: Searches that go down a forest at a time.
SEARCHES = 1 << 14
#: Bytes of rows that a task takes at a time.
SEARCH_BYTES = 1 << 22


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), 42)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(words) - shingle + 1, 1 << 16):
        part = words[at : at + (1 << 16) + shingle - 1]
        joined = map(b" ".join, zip(*[part[k:] for k in range(shingle)]))
        h = np.array([digest(s, 42) for s in joined], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(words) - shingle + 1
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                fps = np.array([fingerprint(x.as_py(), shingle) for x in some.column(1)], "<u8").view("<i8")
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(fps)], schema=schema)

    keys = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return keys.mapInArrow(run, "doc_id long, fp long")


class Forest:
    """BK-trees over the fingerprints of many shards at once, held in arrays."""

    def __init__(self, shard: np.ndarray, fps: np.ndarray):
        """Each shard's first fingerprint is its root; a shard's fingerprints are distinct."""
        self.fps = fps
        names, root_of = np.unique(shard, return_inverse=True)
        self.shards, self.roots = names, np.full(len(names), -1, np.int64)
        edge_parent, edge_key, edge_child = [], [], []
        left, group, level = np.arange(len(fps)), root_of, 0
        while len(left):
            # left: nodes without a place yet, by the group that will be one subtree; the first is its root
            order = np.argsort(group, kind="stable")
            left, group = left[order], group[order]
            first = np.r_[True, group[1:] != group[:-1]]
            heads, which = left[first], np.cumsum(first) - 1
            if level == 0:
                self.roots[group[first]] = heads
            else:
                edge_parent.append(parents[order][first])
                edge_key.append(keys[order][first])
                edge_child.append(heads)
            parents = heads[which][~first]
            left = left[~first]
            keys = np.bitwise_count(fps[left] ^ fps[parents]).astype(np.int64)
            group = parents * 65 + keys
            level += 1
        none = np.zeros(0, np.int64)
        edge = np.concatenate([none, *edge_parent]) * 65 + np.concatenate([none, *edge_key])
        order = np.argsort(edge)
        self._edges, self._children = edge[order], np.concatenate([none, *edge_child])[order]

    def search(self, shard: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the search, node) of all nodes within the radius in the search's shard."""
        at = np.minimum(np.searchsorted(self.shards, shard), max(0, len(self.shards) - 1))
        there = np.flatnonzero(self.shards[at] == shard) if len(self.shards) else np.zeros(0, np.int64)
        found_q, found_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(there), SEARCHES):
            q = there[k : k + SEARCHES]
            node = self.roots[at[q]]
            while len(q):
                d = np.bitwise_count(fps[q] ^ self.fps[node]).astype(np.int64)
                near = d <= radius
                found_q.append(q[near])
                found_n.append(node[near])
                next_q, next_n = [], []
                for key in range(-radius, radius + 1):
                    want = d + key
                    edge = node * 65 + want
                    slot = np.minimum(np.searchsorted(self._edges, edge), max(0, len(self._edges) - 1))
                    hit = (want >= 0) & (want <= 64) & (self._edges[slot] == edge) if len(self._edges) else np.zeros(len(q), bool)
                    next_q.append(q[hit])
                    next_n.append(self._children[slot[hit]] if len(self._edges) else node[hit])
                q, node = np.concatenate(next_q), np.concatenate(next_n)
        return np.concatenate(found_q), np.concatenate(found_n)


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, least value of its component) of the values that links a-b join, roots left out."""
    values, ends = np.unique(np.r_[a, b], return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(values))
    return values[moved], values[label[moved]]


def blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of the radius + 1 blocks of bits."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def links(distinct: DataFrame, radius: int = 2, shard_size: int = 20_000) -> DataFrame:
    """Edges (a, b), b < a, whose components are those of all links within the radius.

    distinct: column fp without repeats or nulls. No link is lost: two fingerprints within the radius
    share a block, both are in that shard, and each is searched in every tree of it.
    """
    keyed = distinct.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.col("fp"), s).bitwiseAND(F.lit((1 << w) - 1)).alias("value")) for k, (s, w) in enumerate(blocks(radius))])).alias("b"),
    ).select("fp", (F.col("b.value") * F.lit(radius + 1) + F.col("b.block")).alias("shard"))
    large = keyed.groupBy("shard").count().where(F.col("count") > shard_size)
    large = large.select("shard", F.ceil(F.col("count") / F.lit(shard_size)).cast("int").alias("trees"))
    spread = keyed.join(large, "shard", "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    tree = F.pmod(F.xxhash64("fp"), F.col("trees").cast("long")).cast("int")
    sent = spread.select("fp", "shard", tree.alias("own"), F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"))
    sent = sent.select("fp", "shard", "tree", (F.col("own") == F.col("tree")).alias("member")).repartition("shard", "tree")
    sent = sent.sortWithinPartitions("shard", "tree", F.desc("member"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a tree's own fingerprints come first, so those searched later find all of them in `kept`
        kept = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for t in groups(batches, SEARCH_BYTES):
            fps, shard, tree, member = (t.column(k).to_numpy() for k in range(4))
            mine = [fps.view(np.uint64)[member], shard[member], tree.astype(np.int64)[member]]
            inside = [np.concatenate(pair) for pair in zip(kept, mine)]
            # a number for each (shard, tree)
            both = np.stack([np.r_[inside[1], shard], np.r_[inside[2], tree.astype(np.int64)]])
            _, name = np.unique(both, axis=1, return_inverse=True)
            name, n = name.reshape(-1), len(inside[0])
            q, at = Forest(name[:n], inside[0]).search(name[n:], fps.view(np.uint64), radius)
            a, b = fps[q], inside[0][at].view(np.int64)
            a, b = spanning_forest(a[a != b], b[a != b])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)
            last = (inside[1] == shard[-1]) & (inside[2] == tree[-1])
            kept = [x[last] for x in inside]

    return sent.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and root (the least node of its component) for each node of the edges (a, b).

    Large-star and small-star steps alternate until nothing changes; each pair of steps is written to
    the shared folder, so lineage stays short and a lost executor repeats one step at most.
    """

    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = None
    for _ in range(most):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("m", "u").alias("m"), "n")
        large = join_sized(both, materialize(low, "least"), "u", "n").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: neighbours below u, and u itself, go to the least of them
        large = materialize(large, "large-stars")
        down = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "down")
        small = join_sized(large, down, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        edges = materialize(small.where("a <> b").distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError(f"components didn't settle in {most} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3, shard_size: int = 20_000) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, class_size.

    component_id is the least doc_id reachable over links of at most `radius` differing bits.
    A null text has no words, like an empty one: fingerprint zero. Rows with a null id have their
    component's id, null if no member has one. Rows that are repeated are each returned. Other
    columns aren't read; an empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("class_size"))
    roots = components(links(classes.select("fp"), radius, shard_size)).withColumnRenamed("node", "fp")
    linked = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = materialize(linked, "linked")
    least = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "components")
    named = materialize(join_sized(linked, least, "root", "n").select("fp", "component_id", "class_size"), "named")
    out = join_sized(fps, named, "fp", "class_size")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_size")


#: Words of 64 bits in a long fingerprint, and least shingles taken as a text's shards.
WORDS, KEYS = 8, 6
#: Rows of a shard that a task searches against one another; a larger shard is cut into such pieces,
#: and the pieces are compared two by two.
PIECE, LEADERS = 1024, 32
#: Standard deviations of an estimate within which a pair is looked at.
SIGMAS = 4.5
#: Classes of a candidate component that a task verifies against one another; a larger component is cut
#: into parts of half as many, and any two parts meet in a task.
GROUP = 512
#: Pairs that one slice of a partition's pieces may have.
SLICE = 1 << 20


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of 64-bit hashes of 64-bit hashes."""
    x = h ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_key(text: Column) -> Column:
    """A 64-bit key of a text; that of a null text is of no other."""
    return F.xxhash64(text.isNull(), text)


def shingle_set(text: str | None, shingle: int = 5) -> tuple[int, np.ndarray]:
    """(hash of the word sequence, sorted hashes of its distinct shingles) of a whole text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0, np.zeros(0, np.uint64)
    digest, n, found = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1), []
    for at in range(0, n, 1 << 14):
        part = words[at : min(at + (1 << 14), n) + shingle - 1]
        joined = map(b" ".join, zip(*[part[k:] for k in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
        found.append(np.unique(np.array([digest(s, 42) for s in joined], np.uint64)))
    return digest(b" ".join(words), 43), np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def long_fingerprint(text: str | None, shingle: int = 5) -> tuple[int, np.ndarray, np.ndarray]:
    """(hash of the word sequence, SimHash of WORDS x 64 bits, KEYS least hashes) of a whole text's
    distinct shingles; all zero for a text without words. Each of the KEYS is least by its own hash."""
    same, h = shingle_set(text, shingle)
    if not len(h):
        return 0, np.zeros(WORDS, np.uint64), np.zeros(KEYS, np.uint64)
    least = np.array([_mixed(h, WORDS + k).min() for k in range(KEYS)], np.uint64)
    ones = np.zeros(64 * WORDS, np.int64)
    for a in range(0, len(h), 255):  # so many ones fit into a byte
        bits = np.stack([_mixed(h[a : a + 255], k) for k in range(WORDS)], axis=1)
        ones += np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return same, np.packbits(2 * ones > len(h), bitorder="little").view("<u8"), least


def _radius(similarity: float, bits: int, sigmas: float) -> int:
    """Differing bits that texts of this shingle similarity (Jaccard) have at most, but for so many
    standard deviations: the angle between two sets is arccos(2 s / (1 + s)) at most."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * p + sigmas * (bits * p * (1 - p)) ** 0.5)


def copy_links(classes: DataFrame, similarity: float = 0.8, piece: int = PIECE, leaders: int = LEADERS) -> DataFrame:
    """Edges (a, b) between the classes (same, f0.., k0..) whose long fingerprints are near enough to be
    looked at: every class of a pair at `similarity` has an edge, and they are in one component.

    A shard is what has one of its KEYS in common: texts of similarity s share each with chance s. Its
    BK-tree is searched by the fingerprint's first word, and what is found is compared by all words.
    A shard of more than `piece` rows is cut into pieces by hash, each with the same few leaders, so
    that most of a group of near copies hangs together at once. Then any two pieces of a shard are
    compared row by row, but for rows that hang together already: no pair of a shard is left out.
    """
    first, whole = _radius(similarity, 64, SIGMAS), _radius(similarity, 64 * WORDS, SIGMAS)
    fs = [f"f{k}" for k in range(WORDS)]
    keyed = classes.select("same", *fs, F.explode(F.array_distinct(F.array(*[f"k{k}" for k in range(KEYS)]))).alias("shard"))
    # a shard of one row has no link, so most rows stop here
    sizes = keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = keyed.join(sizes, "shard").withColumn("pieces", F.ceil(F.col("n") / F.lit(piece)).cast("int"))
    lead = (F.col("pieces") > 1) & (F.pmod(F.xxhash64("same", F.lit(1)), F.col("n")) < leaders)
    own = F.pmod(F.xxhash64("same", "shard"), F.col("pieces").cast("long")).cast("int")
    spread = sized.select("same", *fs, "shard", F.explode(F.when(lead, F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array(own))).alias("piece"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["shard", "piece"]):
            same, shard, part = (t.column(c).to_numpy() for c in ("same", "shard", "piece"))
            fps = np.stack([t.column(c).to_numpy() for c in fs], axis=1).view(np.uint64)
            name = np.cumsum(np.r_[True, (np.diff(shard) != 0) | (np.diff(part) != 0)]) - 1
            begin = np.r_[np.flatnonzero(np.r_[True, np.diff(name) != 0]), len(name)]
            pairs = np.cumsum(np.diff(begin).astype(np.int64) ** 2)
            at = 0
            while at < len(pairs):
                done = int(pairs[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(pairs, done + SLICE, "right")))
                lo, hi = int(begin[at]), int(begin[to])
                f, s = fps[lo:hi], same[lo:hi]
                q, n = Forest(name[lo:hi], f[:, 0]).search(name[lo:hi], f[:, 0], first)
                q, n = q[q < n], n[q < n]
                apart = np.zeros(len(q), np.int64)
                for k in range(WORDS):
                    apart += np.bitwise_count(f[q, k] ^ f[n, k])
                near = (apart <= whole) & (s[q] != s[n])
                a, b = spanning_forest(s[q[near]], s[n[near]])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)
                at = to

    inside = materialize(spread.repartition("shard", "piece").sortWithinPartitions("shard", "piece").mapInArrow(run, "a long, b long"), "piece-links")
    large = materialize(sized.where("pieces > 1").select("same", *fs, "shard", "pieces", own.alias("own")), "large-shards")
    if large.isEmpty():
        return inside
    roots = components(inside).withColumnRenamed("node", "same")
    rooted = large.join(roots, "same", "left").withColumn("root", F.coalesce("root", "same"))
    return inside.unionByName(_across(rooted, fs, first, whole))


def _runs(t: pa.Table, keys: list[str]) -> list[np.ndarray]:
    """Numbers of a table's rows by groups of equal keys; its rows are sorted by them."""
    new = np.zeros(t.num_rows - 1, bool)
    for k in keys:
        new |= np.diff(t.column(k).to_numpy()) != 0
    return np.split(np.arange(t.num_rows), np.flatnonzero(new) + 1)


def _across(rows: DataFrame, fs: list[str], first: int, whole: int) -> DataFrame:
    """Edges (a, b) between the roots of near rows (same, f0.., shard, pieces, own, root) that are in
    two pieces of a shard. A task holds the two pieces only, so a large shard has many tasks."""
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")
    pairs = rows.select("root", *fs, "shard", "own", other).where("own <> other")
    pairs = pairs.select("root", *fs, "shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") < F.col("other")).alias("side"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["shard", "low", "high"]):
            root, side = t.column("root").to_numpy(), t.column("side").to_numpy()
            fps = np.stack([t.column(c).to_numpy() for c in fs], axis=1).view(np.uint64)
            for group in _runs(t, ["shard", "low", "high"]):
                x, y = group[side[group]], group[~side[group]]
                ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                step = max(1, SLICE // max(1, len(y)))
                for at in range(0, len(x), step):
                    some = x[at : at + step]
                    i, j = np.nonzero((np.bitwise_count(fps[some, :1] ^ fps[y, 0]) <= first) & (root[some, None] != root[y]))
                    i, j = some[i], y[j]
                    apart = np.zeros(len(i), np.int64)
                    for k in range(WORDS):
                        apart += np.bitwise_count(fps[i, k] ^ fps[j, k])
                    ends[0].append(root[i[apart <= whole]])
                    ends[1].append(root[j[apart <= whole]])
                a, b = spanning_forest(np.concatenate(ends[0]), np.concatenate(ends[1]))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return pairs.repartition("shard", "low", "high").sortWithinPartitions("shard", "low", "high").mapInArrow(run, "a long, b long")


def _exact_links(fps: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (i, j) of sets with a Jaccard similarity of `similarity` or more, enough of them for the components."""
    m, whole = len(sets), _radius(similarity, 64 * WORDS, SIGMAS)
    size, at = np.array([len(x) for x in sets]), np.cumsum([0, *map(len, sets)])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark, label, links = np.zeros(len(values), bool), np.arange(m), []
    for i in range(m - 1):
        maybe = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        apart = np.bitwise_count(fps[maybe] ^ fps[i]).sum(axis=1, dtype=np.int64)
        maybe = maybe[apart <= whole]
        if not len(maybe):
            continue
        mine = flat[at[i] : at[i + 1]]
        mark[mine] = True
        if 4 * len(maybe) > m:
            both = np.add.reduceat(mark[flat], at[:-1], dtype=np.int64)[maybe]
        else:
            both = np.array([np.count_nonzero(mark[flat[at[j] : at[j + 1]]]) for j in maybe])
        mark[mine] = False
        for j in maybe[both >= similarity * (size[maybe] + size[i] - both)]:
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return tuple(np.array(links, np.int64).reshape(-1, 2).T)


def _verified(keys: DataFrame, classes: DataFrame, roots: DataFrame, shingle: int, similarity: float, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between classes of one candidate component (same, root) by their exact shingle sets,
    which are made again from one text of each such class only."""
    fs = [f"f{k}" for k in range(WORDS)]
    # a root has no row of its own
    members = materialize(roots.unionByName(roots.select(F.col("root").alias("same"), "root")).distinct(), "members")
    sizes = materialize(members.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    parts = F.when(F.col("n") <= group, F.lit(1)).otherwise(F.ceil(2 * F.col("n") / F.lit(group))).cast("long")
    one = join_sized(members, sizes, "root", "n").select("root", "same", parts.alias("parts"))
    one = materialize(one.join(classes.select("same", "least", *fs), "same").select("root", "same", "parts", *fs, F.col("least.doc_id").alias("of_id"), F.col("least.txt").alias("txt")), "candidates")
    side = F.broadcast(one) if one.count() <= 200_000 else one
    texts = keys.join(side, (keys["txt"] == side["txt"]) & keys["id"].eqNullSafe(side["of_id"])).select("root", "same", "parts", *fs, "text")
    # a row that is repeated has its text again
    texts = texts.dropDuplicates(["same"])
    names = ["root", "same", "parts", *fs]
    schema = pa.schema([*[(c, pa.int64()) for c in names], ("hashes", pa.large_binary())])

    @lean
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                hashes = [shingle_set(x.as_py(), shingle)[1].tobytes() for x in some.column(len(names))]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(names)], pa.array(hashes, pa.large_binary())], schema=schema)

    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["root", "low", "high"]):
            same, hashes = t.column("same").to_numpy(), [np.frombuffer(x.as_py(), np.uint64) for x in t.column("hashes")]
            fps = np.stack([t.column(c).to_numpy() for c in fs], axis=1).view(np.uint64)
            for group in _runs(t, ["root", "low", "high"]):
                i, j = _exact_links(fps[group], [hashes[k] for k in group], similarity)
                yield pa.RecordBatch.from_arrays([pa.array(same[group[i]]), pa.array(same[group[j]])], schema=out)

    made = texts.mapInArrow(sets, ", ".join([*[f"{c} long" for c in names], "hashes binary"]))
    own, parts = F.pmod(F.xxhash64("same"), F.col("parts")), F.col("parts")
    # two parts meet in a task; there, each is compared with itself as well
    other = F.when(parts == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), parts - 1), lambda k: k != own))
    made = made.withColumns({"own": own, "other": F.explode(other)}).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    return made.select("root", "low", "high", "same", *fs, "hashes").repartition("root", "low", "high").sortWithinPartitions("root", "low", "high").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id, txt (text_key of its text), component_id, the least doc_id
    reachable over links between texts whose sets of word shingles have a Jaccard similarity of
    `similarity` or more, and first: whether the row's doc_id and text are the least of its component.

    Pairs are found by least shingles and by a SimHash of 512 bits with a margin of SIGMAS standard
    deviations, and linked by their exact sets only. Texts of equal words are one class, whatever their
    number. Null texts and ids, repeated rows, other columns and empty tables go as in near_duplicates.
    A null id comes after all others; rows with the same id and text are first, or not, together.
    """
    names = ["doc_id", "same", *[f"f{k}" for k in range(WORDS)], *[f"k{k}" for k in range(KEYS)], "txt"]
    schema = pa.schema([(c, pa.int64()) for c in names])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                made = [long_fingerprint(x.as_py(), shingle) for x in some.column(1)]
                rows = np.array([np.r_[np.uint64(s), f, k] for s, f, k in made], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([some.column(0), *[pa.array(rows[:, k]) for k in range(rows.shape[1])], some.column(2)], schema=schema)

    keys = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keys = keys.withColumn("txt", text_key(F.col("text")))
    prints = materialize(keys.mapInArrow(run, ", ".join(f"{c} long" for c in names)), "long-fingerprints")
    # columns are equal within a class; of a class's rows the one of the least id comes first
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "txt")
    classes = prints.groupBy("same").agg(F.min(rank).alias("least"), F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in names[2:-1]])
    classes = materialize(classes, "classes")
    maybe = components(copy_links(classes, similarity)).withColumnRenamed("node", "same")
    roots = components(_verified(keys, classes, maybe, shingle, similarity)).withColumnRenamed("node", "same")
    linked = materialize(classes.select("same", "least", "n").join(roots, "same", "left").withColumn("root", F.coalesce("root", "same")), "linked")
    least = materialize(linked.groupBy("root").agg(F.min("least").alias("top"), F.count(F.lit(1)).alias("members")), "components")
    named = materialize(join_sized(linked.select("same", "root", "n"), least, "root", "members").select("same", "top", "n"), "named")
    out = join_sized(prints.select("doc_id", "txt", "same"), named, "same", "n")
    first = F.col("top.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("top.txt") == F.col("txt"))
    return out.select("doc_id", "txt", F.col("top.doc_id").alias("component_id"), first.alias("first"))
