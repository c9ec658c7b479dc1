"""Operator 7: SimHash near-duplicates, searched with BK-trees.

1. Every text gets a 64-bit SimHash of its word shingles (XXH64, seed 42, majority of each bit).
2. Distinct fingerprints are dealt into shards: the 64 bits are cut into `blocks` blocks, and a pair
   that differs in at most `radius` bits agrees in at least ``blocks - radius`` of them, so for each
   choice of that many blocks a fingerprint goes to the shard of its bits there. No pair is lost.
   A shard of more than SHARD_ROWS fingerprints is dealt again by its other bits: they are cut into
   ``radius + 2`` parts, of which a pair agrees in two at least.
3. Each shard of two or more is a BK-tree: a node's children are keyed by their Hamming distance to it,
   and a search follows only the edges within the radius of its own distance. In small shards each
   fingerprint searches the tree of those before it and is then put in; in large ones whole sets of
   queries walk the tree at once.
4. A shard returns a spanning forest of the links it finds, one edge at most for each fingerprint, and
   the forests are merged by distributed connected components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import _common as C

#: Words of a shingle, differing bits of a link.
SHINGLE_WORDS, RADIUS = 3, 3
#: Fingerprints of a shard that are aimed at, were they random.
AIM = 512
#: Fingerprints of a shard that isn't dealt again; of one whose tree is walked by one query at a time; shingles hashed at once.
SHARD_ROWS, SMALL, CHUNK = 8_192, 64, 1 << 16


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only


def shingle_hashes(words: list[bytes], width: int) -> Iterator[bytes]:
    """XXH64 of all shingles, 8 bytes each, CHUNK of them at once; fewer words than `width` are one shingle, no words none."""
    n, digest = max(1, len(words) - width + 1), xxhash.xxh64_digest
    for i in range(0, n if words else 0, CHUNK):
        k = min(CHUNK, n - i)
        parts = [words[i + j : i + j + k] for j in range(min(width, len(words)))]
        yield b"".join([digest(b" ".join(s), 42) for s in zip(*parts, strict=True)])


def majority(chunks: Iterable[bytes]) -> int:
    """The bits that are set in over half of the hashes; 0 if there are none."""
    over, n = np.zeros(64, np.int64), 0
    for hashes in chunks:
        over += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(hashes) // 8
    return int.from_bytes(np.packbits(2 * over > n).tobytes(), "big")


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Unsigned SimHash; 0 for a null text or one without words."""
    return majority(shingle_hashes(words_of(text), width))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """(id_col, fp long) of every row; fp holds the unsigned value's bits."""

    def rows(keys, texts):
        return [keys, np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)]

    kind = dict(df.dtypes)[id_col].replace("bigint", "long")
    return C.per_batch(df, [id_col, text_col], f"{id_col} {kind}, fp long", rows)


class Forest:
    """Union-find over positions 0..n-1 that keeps the edges that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def roots(self, at: np.ndarray) -> np.ndarray:
        root = self.up[at]
        while (on := self.up[root] != root).any():
            root[on] = self.up[root[on]]
        self.up[at] = root
        return root

    def link(self, a: int, b: int) -> None:
        """One edge, if it joins two trees."""
        up, ra, rb = self.up, a, b
        while (x := up[ra]) != ra:
            ra = x
        while (x := up[rb]) != rb:
            rb = x
        if ra != rb:
            self.edges.append((a, b))
            up[max(ra, rb)] = min(ra, rb)

    def join(self, center: int, others: np.ndarray) -> None:
        """Links center to all others; only one of each tree that isn't center's yet gives an edge."""
        roots, first = np.unique(self.roots(others), return_index=True)
        own = int(self.roots(np.array([center]))[0])
        for root, i in zip(roots.tolist(), first.tolist(), strict=True):
            if root != own:
                self.edges.append((center, int(others[i])))
                own, gone = min(own, root), max(own, root)
                self.up[gone] = own


class Node:
    """Of a BK-tree: a fingerprint, its place in the shard, its children by their distance to it."""

    __slots__ = ("at", "children", "fp")

    def __init__(self, fp: int, at: int):
        self.fp, self.at, self.children = fp, at, {}


def tree_links(fps: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """(earlier, later) of all pairs within `radius`: each fingerprint searches the tree and is then put in."""
    root = Node(fps[0], 0)
    for i in range(1, len(fps)):
        fp, todo = fps[i], [root]
        while todo:
            node = todo.pop()
            d = (fp ^ node.fp).bit_count()
            if d <= radius:
                yield node.at, i
            for key, child in node.children.items():
                if d - radius <= key <= d + radius:
                    todo.append(child)
        node = root
        while (child := node.children.get(d := (fp ^ node.fp).bit_count())) is not None:
            node = child
        node.children[d] = Node(fp, i)


def bk_links(fps: np.ndarray, members: np.ndarray, queries: np.ndarray, radius: int, forest: Forest) -> None:
    """Links `queries` to the `members` within `radius`; both are positions in fps.

    A node of the BK-tree is made when the queries come to it: its pivot's distances to its members
    key the children, its distances to the queries say which children each query goes on to.
    """
    todo = [(members, queries)]
    while todo:
        m, q = todo.pop()
        if not len(m) or not len(q):
            continue
        pivot, m = m[0], m[1:]
        far_q = np.bitwise_count(fps[q] ^ fps[pivot]).astype(int)
        near = q[far_q <= radius]
        if len(near) > 1:  # it finds itself
            forest.join(int(pivot), near)
        if len(m):
            far_m = np.bitwise_count(fps[m] ^ fps[pivot])
            order = np.argsort(far_m, kind="stable")
            keys, starts = np.unique(far_m[order], return_index=True)
            for key, child in zip(keys.tolist(), np.split(m[order], starts[1:]), strict=True):
                todo.append((child, q[np.abs(far_q - key) <= radius]))


def masked(bits: Iterable[int]) -> Column:
    """The fingerprint's bits at these places."""
    mask = sum(1 << b for b in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def shard_keys(blocks: int, radius: int) -> tuple[Column, Column]:
    """Arrays of a fingerprint's keys: one for each choice of blocks, and of the keys within the shard of its `choice`."""
    cut = [range(64 * b // blocks, 64 * (b + 1) // blocks) for b in range(blocks)]
    choices = list(combinations(range(blocks), blocks - radius))
    within = F.lit(None)
    for k, chosen in enumerate(choices):
        rest = [bit for b in range(blocks) if b not in chosen for bit in cut[b]]
        parts = [rest[len(rest) * i // (radius + 2) : len(rest) * (i + 1) // (radius + 2)] for i in range(radius + 2)]
        within = F.when(F.col("choice") == k, F.array(*(masked([*a, *b]) for a, b in combinations(parts, 2)))).otherwise(within)
    return F.array(*(masked(bit for b in chosen for bit in cut[b]) for chosen in choices)), within


def blocks_for(n: int, radius: int) -> int:
    """Blocks for n fingerprints: more of them make longer shard keys, so smaller shards, but more copies (blocks over radius).

    The fewest with which a shard of random fingerprints has AIM members at most; every choice finds the same links.
    """
    return next((b for b in range(radius + 1, 3 * radius + 4) if n <= AIM << (64 * (b - radius) // b)), 3 * radius + 4)


def links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(src long, dst long): links between distinct fingerprints (fps: fp long, distinct) that connect all within `radius`.

    They connect the same components as all pairs would. blocks: blocks_for() the number of fingerprints, if not given.
    """
    blocks = blocks or blocks_for(fps.count(), radius)
    keys, within = shard_keys(blocks, radius)
    dealt = fps.select("fp", F.posexplode(keys).alias("choice", "key"))
    sizes = dealt.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    kept = dealt.join(sizes, ["choice", "key"])
    # most shards are one task's; a hot one's rows go on to the shards within it
    again = kept.select("fp", "choice", "key", F.posexplode_outer(F.when(F.col("n") > SHARD_ROWS, within)).alias("part", "deeper"))
    tasks = again.select(F.xxhash64("choice", "key", "part", "deeper").alias("task"), "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_task, held_fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            held_task = np.concatenate([held_task, batch.column(0).to_numpy()])
            held_fp = np.concatenate([held_fp, batch.column(1).to_numpy()])
            whole = np.searchsorted(held_task, held_task[-1]) if len(held_task) else 0  # the last task may go on
            if whole:
                yield forests(held_task[:whole], held_fp[:whole], radius)
                held_task, held_fp = held_task[whole:], held_fp[whole:]
        if len(held_task):
            yield forests(held_task, held_fp, radius)

    C.ship(fps.sparkSession)
    return tasks.repartition(n, "task").sortWithinPartitions("task").mapInArrow(search, "src long, dst long")


def forests(tasks: np.ndarray, values: np.ndarray, radius: int) -> pa.RecordBatch:
    """Spanning forests of the shards in sorted rows, each found by its BK-tree."""
    fps = values.view(np.uint64)
    _, starts, sizes = np.unique(tasks, return_index=True, return_counts=True)
    forest, plain = Forest(len(fps)), fps.tolist()
    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        if size > SMALL:
            at = np.arange(start, start + size)
            bk_links(fps, at, at, radius, forest)
        elif size > 1:
            for a, b in tree_links(plain[start : start + size], radius):
                forest.link(start + a, start + b)
    a, b = np.array(forest.edges, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(values[a]), pa.array(values[b])], ["src", "dst"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(id_col, fp long, component_id) of every row: component_id is the smallest id that can be reached by links.

    Null and empty texts have fingerprint 0 and are one group; equal texts are one group; repeated rows
    repeat; a component whose ids are all null has a null id; texts of any length are hashed whole, in
    chunks; further columns, whatever their names, are left out; an empty table gives an empty one.
    """
    made = C.saved(fingerprints(df, id_col, text_col, width))
    distinct = C.saved(made.groupBy("fp").agg(F.min(id_col).alias("low")))
    whole = C.connected_components(links(distinct.select("fp"), radius, blocks))
    of = distinct.join(whole.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    low = of.groupBy("component").agg(F.min("low").alias("component_id"))
    return made.join(of.join(low, "component").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def op7_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(C.dealt(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
