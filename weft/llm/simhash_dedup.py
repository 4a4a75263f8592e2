"""SimHash near-dedup with a Gray-order hierarchical index of the fingerprints.

Fingerprints of 64 bits link at `distance` or fewer differing bits. The index is a forest. Its top nodes
are masked bit patterns: the bits are cut into n blocks, of which n - distance at least are free of
differences in any link, so each choice of n - distance blocks is a mask, and fingerprints that agree
under it share a top node. n grows with the number of fingerprints, so that a top node has no more than
`FULL` of them on average; up to `HOT` fingerprints are one list under the empty mask.

Below a top node all fingerprints are sorted by Gray rank and grouped, 16 to a node, level by level. A
node keeps the bits that all its fingerprints share and that no node above has factored out. A search
starts at the top for many fingerprints at a time, adds up the differences to the factored patterns and
prunes a whole group once they exceed `distance`, once all of the group is linked to the fingerprint
already, or if it comes before it. So every link between different fingerprints is found or already
implied, and a top node emits one link per fingerprint at most, not all pairs.

Top nodes are dealt by key to tasks. One with over `HOT` fingerprints is cut into stretches of its Gray
order; the bits that a stretch shares are factored out again, a pair of stretches whose patterns differ
too much is pruned, and each pair that is left becomes a node of its own, so that none grows beyond two
stretches. Links are joined to components by rounds of large-star and small-star steps on DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import settle, table

DISTANCE, SHINGLE, SEED = 4, 4, 42
#: Fingerprints of a stretch of a hot top node, those of a top node on average, fan-out of the nodes.
HOT, FULL, FAN = 1 << 14, 1 << 12, 16
#: Pairs of fingerprint and node that a search has in memory; fingerprints that a task gathers before it searches.
FRONT, GATHER = 1 << 20, 1 << 16
#: Shares into which the edges of a node, and a component's fingerprints, are dealt.
SHARES = 256
_STEP = 1 << 16


def _counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set."""
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _STEP):  # bounded memory for long texts
        bits = np.unpackbits(hashes[i : i + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 128 * 128
        total += bits[:full].reshape(-1, 128, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[full:].sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's shingles of lower-cased words, unsigned; 0 without words."""
    import xxhash

    found = (text or b"").lower().split()  # bytes: A-Z only, and split at [\x20\x09-\x0D]
    if not found:
        return 0
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    digest, grams = xxhash.xxh64_intdigest, map(b" ".join, zip(*(found[i:] for i in range(shingle))))
    hashes = np.fromiter((digest(g, SEED) for g in grams), dtype="<u8", count=len(found) - shingle + 1)
    return int.from_bytes(np.packbits(2 * _counts(hashes) > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row of docs: id and fp, the fingerprint as a signed long. A null text is one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long")


def masks(n: int, distance: int = DISTANCE) -> list[int]:
    """The masks of the top nodes for n fingerprints: all choices of blocks that a link leaves at least, as few as keep nodes of FULL."""
    if n <= HOT:
        return [0]
    k = distance + 1
    while n >> (64 // k * (k - distance)) > FULL and k < 16:
        k += 1
    edges = [64 * i // k for i in range(k + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, k - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(fp: Column) -> Column:
    """The place of a fingerprint in the Gray sequence, as a signed long."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


class Forest:
    """Top nodes side by side, each with its fingerprints in Gray order and their groups, level by level up to one root."""

    def __init__(self, fps: np.ndarray, first: np.ndarray, tops: np.ndarray) -> None:
        """first: where each top node's fingerprints start; tops: its mask."""
        self.fps, self.tops = fps, tops
        #: From the leaves up: where a node's children start, with their end; its last fingerprint; its factored bits and their pattern.
        self.children: list[np.ndarray] = []
        self.last = [np.arange(len(fps))]
        self.pattern, shared = [fps], [np.full(len(fps), np.uint64(2**64 - 1))]
        start = first
        while len(self.pattern[-1]) > len(first):
            v, m, here = self.pattern[-1], shared[-1], len(self.pattern[-1])
            size = np.diff(np.append(start, here))
            groups = -(-size // FAN)
            begin = np.concatenate([[0], np.cumsum(groups)[:-1]])
            at = np.repeat(start, groups) + FAN * (np.arange(groups.sum()) - np.repeat(begin, groups))
            union, common = np.bitwise_or.reduceat(v & m, at), np.bitwise_and.reduceat(v | ~m, at)
            same = (common | ~union) & np.bitwise_and.reduceat(m, at)
            self.children.append(np.append(at, here))
            self.last.append(self.last[-1][np.append(at[1:], here) - 1])
            self.pattern.append(common & same)
            shared.append(same)
            start = begin
        self.mask = []
        for i, bits in enumerate(shared):
            above = np.repeat(shared[i + 1], np.diff(self.children[i])) if i < len(self.children) else tops
            self.mask.append(bits & ~above)
        #: Nodes looked at and nodes pruned, by levels from the leaves up.
        self.visited, self.pruned = [0] * len(self.mask), [0] * len(self.mask)

    def _uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """The label of a node whose fingerprints all have it, else -1."""
        out = [label]
        for edges in self.children:
            lo, hi = np.minimum.reduceat(out[-1], edges[:-1]), np.maximum.reduceat(out[-1], edges[:-1])
            out.append(np.where(lo == hi, lo, -1))
        return out

    def search(self, distance: int) -> np.ndarray:
        """Per fingerprint the place of the first one of its component within its top node."""
        n, top = len(self.fps), len(self.mask) - 1
        label = np.arange(n)
        root = np.searchsorted(self.last[top], label)  # the top node of each
        uniform, at, step = self._uniform(label), 0, 1024
        while at < n:
            q = np.arange(at, min(n, at + step))
            at, widest = at + len(q), len(q)
            node, differ = root[q], np.zeros(len(q), dtype=np.uint8)
            for level in range(top, -1, -1):
                if level < top:
                    edges = self.children[level]
                    lo, wide = edges[node], edges[node + 1] - edges[node]
                    q, differ = np.repeat(q, wide), np.repeat(differ, wide)
                    node = np.repeat(lo - np.concatenate([[0], np.cumsum(wide)[:-1]]), wide) + np.arange(len(q))
                self.visited[level] += len(q)
                differ = differ + np.bitwise_count((self.fps[q] ^ self.pattern[level][node]) & self.mask[level][node])
                live = (differ <= distance) & (self.last[level][node] > q) & (uniform[level][node] != label[q])
                self.pruned[level] += len(q) - int(live.sum())
                widest = max(widest, len(q))
                q, node, differ = q[live], node[live], differ[live]
            if len(q):
                label = _joined(label, q, node)
                uniform = self._uniform(label)
            step = max(16, min(1 << 16, step * FRONT // widest if widest > FRONT else step * 2))
        return label


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels after a[i] and b[i] are joined: each the least of its component."""
    x, y = label[a], label[b]
    root = np.arange(len(label))
    while True:
        rx, ry = root[x], root[y]
        hi, lo = np.maximum(rx, ry), np.minimum(rx, ry)
        if not (open_ := hi != lo).any():
            return root[label]
        np.minimum.at(root, hi[open_], lo[open_])
        while not np.array_equal(jumped := root[root], root):
            root = jumped


def links(fps: DataFrame, distance: int = DISTANCE, hot: int = HOT, n: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints fps (fp) that connect just those within `distance`, directly or by others.

    n: how many masks are made for, by default as many as there are.
    """
    tops = masks(fps.count() if n is None else n, distance)
    nodes = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in tops))).alias("mask", "key"))
    sizes = nodes.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    sizes = settle(sizes.select("mask", "key", F.ceil(F.col("n") / hot).cast("int").alias("parts")))
    if sizes.isEmpty():
        nodes = nodes.select("mask", "key", F.lit(0).alias("a"), F.lit(0).alias("b"), "fp")
    else:
        nodes = _stretched(nodes, sizes, distance)
    by = ["mask", "key", "a", "b"]
    nodes = nodes.repartition(*by).sortWithinPartitions(*by, gray_rank(F.col("fp")))
    masks_of = np.array(tops, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        gathered = 0
        for batch in batches:
            kept.append(np.stack([batch.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in range(5)]))
            gathered += batch.num_rows
            if gathered >= GATHER:
                whole = np.concatenate(kept, axis=1)
                # the last node may go on in the next batch
                differs = np.flatnonzero((whole[:4] != whole[:4, -1:]).any(axis=0))
                upto = differs[-1] + 1 if len(differs) else 0
                if upto:
                    yield from search(whole[:, :upto])
                kept, gathered = [whole[:, upto:]], 0
        if kept:
            yield from search(np.concatenate(kept, axis=1))

    def search(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        fresh = np.concatenate([[True], (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)])
        first = np.flatnonzero(fresh)
        lone = np.repeat(np.diff(np.append(first, rows.shape[1])) == 1, np.diff(np.append(first, rows.shape[1])))
        rows, first = rows[:, ~lone], np.flatnonzero(fresh[~lone])
        if rows.shape[1]:
            label = Forest(np.ascontiguousarray(rows[4]).view(np.uint64), first, masks_of[rows[0, first]]).search(distance)
            far = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(rows[4][far]), pa.array(rows[4][label[far]])], ["a", "b"])

    found = nodes.mapInArrow(run, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _stretched(nodes: DataFrame, sizes: DataFrame, distance: int) -> DataFrame:
    """nodes (mask, key, fp) as (mask, key, a, b, fp): the hot ones of sizes once for each pair (a, b) of their stretches that may hold a link."""
    nodes = nodes.join(sizes, ["mask", "key"], "left")
    # any cuts are right; ranges of the Gray order make stretches even, as no two ranks are the same
    parts = int(sizes.agg(F.sum("parts")).first()[0])
    hot = nodes.where("parts is not null").select("mask", "key", "fp").repartitionByRange(parts, "mask", "key", gray_rank(F.col("fp")))
    hot = settle(hot.withColumn("own", F.spark_partition_id()))
    shared = hot.groupBy("mask", "key", "own").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("any"))
    same = F.col("ones").bitwiseOR(F.bitwise_not("any"))
    shared = shared.select("mask", "key", F.col("own").alias("a"), "ones", same.alias("same"))
    other = shared.select("mask", "key", F.col("a").alias("b"), F.col("ones").alias("ones_b"), F.col("same").alias("same_b"))
    apart = F.bit_count(F.col("ones").bitwiseXOR(F.col("ones_b")).bitwiseAND(F.col("same")).bitwiseAND(F.col("same_b")))
    pairs = shared.join(other, ["mask", "key"]).where("a <= b").where(apart <= distance).select("mask", "key", "a", "b")
    # a stretch alone is in all its pairs, if it has any
    paired = pairs.where("a < b")
    alone = pairs.where("a = b").join(paired.select("mask", "key", "a").union(paired.select("mask", "key", "b")).distinct(), ["mask", "key", "a"], "left_anti")
    ends = paired.unionByName(alone).select("mask", "key", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("own"))
    cool = nodes.where("parts is null").select("mask", "key", F.lit(0).alias("a"), F.lit(0).alias("b"), "fp")
    return cool.unionByName(hot.join(ends, ["mask", "key", "own"]).select("mask", "key", "a", "b", "fp"))


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with m, the least b of their a. The edges of one a are summed, and get their m, in SHARES of limited size."""
    dealt = edges.withColumn("share", F.pmod(F.xxhash64("b"), F.lit(SHARES)).cast("int"))
    shares = dealt.groupBy("a", "share").agg(F.min("b").alias("m"))
    least = shares.groupBy("a").agg(F.min("m").alias("m"))
    return dealt.join(shares.select("a", "share").join(least, "a"), ["a", "share"]).drop("share")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the least node of its component.

    Alternating large-star and small-star rounds, each written to the checkpoint folder, until every edge
    leads to a root. A star's centre may be hot; no task has more of it than a share of its edges.
    """
    now = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours go to the least of a node and its neighbours
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the least of these
        low = settle(_with_least(large))
        small = low.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = settle(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        # done when no node has two edges and no root has a root
        twice = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if twice.isEmpty() and after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = after


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: the id, fingerprint (16 hex digits), component_id (the least id reachable).

    Null and empty texts have fingerprint 0, linked like any other. Rows that repeat an id are one
    document. A null id is in a component whose id is the least that is not null, if any. An empty table
    gives no rows. Other columns are ignored. Equal fingerprints are one entry of the index.
    """
    # a partition's rows of one fingerprint are a bundle of their own, so that no group of copies meets in one task
    prints = settle(fingerprints(docs, id_col, text_col, shingle).withColumn("run", F.spark_partition_id()))
    bundles = settle(prints.groupBy("fp", "run").agg(F.min("id").alias("least")))
    fps = settle(bundles.groupBy("fp").agg(F.min("least").alias("least")))
    stars = components(links(fps.select("fp"), distance))
    return _named(prints, bundles, fps, stars).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(prints: DataFrame, bundles: DataFrame, fps: DataFrame, stars: DataFrame) -> DataFrame:
    """prints with component_id, the least id of the component. A root's fingerprints, and a fingerprint's rows, meet in shares of limited size only."""
    rooted = fps.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = settle(rooted.withColumn("share", F.when(F.col("fp") == F.col("root"), F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.lit(SHARES)).cast("int"))))
    shares = rooted.groupBy("root", "share").agg(F.min("least").alias("least"))
    named = shares.groupBy("root").agg(F.min("least").alias("component_id"))
    named = shares.select("root", "share").join(named, "root")
    named = rooted.select("fp", "root", "share").join(named, ["root", "share"]).select("fp", "component_id")
    return prints.join(bundles.select("fp", "run").join(named, "fp"), ["fp", "run"])


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))
