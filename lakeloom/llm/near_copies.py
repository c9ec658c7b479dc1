"""Operator 7 for similar texts: every pair of texts with Jaccard 0.8 or more over shingles of five words is linked.

Copies with some words changed differ in more bits of a 64-bit SimHash than blocks can be dealt by, so
fingerprints find most links here, and an exact search finds the rest:

1. Every text becomes the set of its shingles' XXH64 hashes; equal sets are one node. A node has its
   SimHash, a sketch of BITS bits (each the parity of the shingles that fall on it), and a prefix.
2. Nodes within RADIUS bits of SimHash are found by operator 7's BK-trees.
3. Two sets with Jaccard 0.8 or more share a shingle of both prefixes, whatever the order of all
   shingles is: of n shingles the n - ceil(0.8 n) + 1 first ones. Shingles that come often in a sample
   are put last in the order (HOT of them at most), which changes the work, not the result.
4. Stars: each node also meets the hub with which it shares most of its prefix; a shingle's hub is the node
   with the fewest shingles of its own, in a group of copies the text that they come from. Both kinds
   of pairs are compared as whole sets, and those that are alike are merged, so a large group of near
   copies is merged without comparing all of its pairs.
5. What is left: pairs of a shingle that are in different groups, not both in its largest one, and that pass
   two bounds (sizes; sketches, as two sets differ in at least as many shingles as their sketches in bits)
   are compared as whole sets. No pair is lost.

Before whole texts are moved to be compared, pairs pass the sketches' bound again with WIDE bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import _common as C
from lakeloom.llm import simhash

#: Words of a shingle; least similarity of a link, as a fraction; differing bits that the fingerprints' trees search.
SHINGLE_WORDS, NUMERATOR, DENOMINATOR, RADIUS = 5, 4, 5, 3
#: One of so many texts is sampled; shingles of so many sampled sets are frequent; frequent ones that are kept, at most.
SAMPLED, FREQUENT, HOT = 16, 4, 200_000
#: Bits of a sketch, and of the long one.
BITS, WIDE = 512, 4096
#: Pairs whose whole texts are in a worker's hands at once.
PAIRS = 64
SKETCH = [f"s{i}" for i in range(BITS // 64)]
#: A node's columns besides its number.
NODE = ["fp", "size", "n_prefix", *SKETCH]


def hashes(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Of all shingles of a text, repeats included; a text of fewer words is one shingle, one without words has none."""
    return np.frombuffer(b"".join(simhash.shingle_hashes(simhash.words_of(text), width)), np.int64)


def shingles(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    return np.unique(hashes(text, width))


def node_of(own: np.ndarray) -> int:
    """One number for equal sets; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 42)).view(np.int64)) if len(own) else 0


def least_shared(n):
    """Shingles of a set of n that any set linked to it has too."""
    return -(-NUMERATOR * n // DENOMINATOR)


def least_overlap(a, b):
    """Shingles that linked sets of sizes a and b share."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def sketch(own: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parities of the shingles on each bit, as bits / 64 numbers: of two sketches no more bits differ than shingles of their sets."""
    odd = np.bincount((own & (bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix(own: np.ndarray, hot: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The set's first shingles in the order of all; hot: frequent ones, sorted, and their ranks (from 1) after all others."""
    if not len(own):
        return own
    rank = np.zeros(len(own), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
        rank = np.where(hot[at] == own, ranks[at], 0)
    return own[np.lexsort((own, rank))][: len(own) - least_shared(len(own)) + 1]


def frequent(df: DataFrame, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample, sorted, and their ranks from 1, the most frequent last."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches):
            sets = [shingles(t, width) for t in set(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.empty(0, np.int64)]))], ["token"])

    C.ship(df.sparkSession)
    some = df.select(text_col).where(F.pmod(F.xxhash64(text_col), F.lit(SAMPLED)) == 0).mapInArrow(all_of, "token long")
    often = some.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(HOT).select("token").collect()
    ascending = np.array([r.token for r in reversed(often)], np.int64)
    by = np.argsort(ascending)
    return ascending[by], by + 1


def read(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id_col, node, NODE, wide, tokens) of every row; tokens, the prefix, and wide, the long sketch, are null where a task has met the node before."""
    spark, kind = df.sparkSession, dict(df.dtypes)[id_col].replace("bigint", "long")
    hot = spark.sparkContext.broadcast(frequent(df, text_col, width))  # HOT numbers at most
    schema = f"{id_col} {kind}, node long, fp long, size long, n_prefix long, " + ", ".join(f"{c} long" for c in SKETCH) + ", wide binary, tokens array<long>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        out = C.arrow_schema(schema)
        for batch in C.pieces(batches):
            known: dict = {}
            for text in set(batch.column(1).to_pylist()):
                every = hashes(text, width)
                own = np.unique(every)
                first = prefix(own, *hot.value)
                fp = int(np.uint64(simhash.majority([every.tobytes()])).view(np.int64))
                known[text] = (node_of(own), (fp, len(own), len(first), *sketch(own).tolist()), (sketch(own, WIDE).tobytes(), first))
            columns: list[list] = [[] for _ in range(len(NODE) + 3)]
            for text in batch.column(1).to_pylist():
                node, values, long = known[text]
                for column, v in zip(columns, (node, *values, *((None, None) if node in seen else long)), strict=True):
                    column.append(v)
                seen.add(node)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(out)[1:], strict=True))], schema=pa.schema([batch.schema.field(0), *list(out)[1:]]))

    return df.select(id_col, text_col).mapInArrow(rows, schema)


def common(tokens: DataFrame) -> DataFrame:
    """(token, node), distinct, of the tokens that two nodes or more have. Rows are compared with their neighbours in order: no group is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, node = np.empty(0, np.int64), np.empty(0, np.int64)
        met = None  # the last token that went out: its further nodes do too

        def out(token, node, met, last):
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])  # copies of a text in several tasks
            token, node = token[new], node[new]
            same = np.zeros(len(token) + 1, bool)
            same[1:-1] = token[1:] == token[:-1]
            keep = same[1:] | same[:-1] | (token == met if met is not None else False)
            k = len(token) - (not last)  # the last row waits for its neighbour
            return token[:k][keep[:k]], node[:k][keep[:k]], token[k:], node[k:]

        for batch in batches:
            token, node = np.concatenate([token, batch.column(0).to_numpy()]), np.concatenate([node, batch.column(1).to_numpy()])
            if len(token):
                t, n, token, node = out(token, node, met, False)
                met = t[-1] if len(t) else met
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], ["token", "node"])
        if len(token):
            t, n, _, _ = out(token, node, met, True)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], ["token", "node"])

    C.ship(tokens.sparkSession)
    n = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tokens.repartition(n, "token").sortWithinPartitions("token", "node").mapInArrow(run, "token long, node long")


class Links:
    """Nodes that are compared as whole sets, and the groups of those that were alike."""

    def __init__(self, df: DataFrame, made: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int):
        self.df, self.made, self.id_col, self.text_col, self.width = df, made, id_col, text_col, width
        self.wide = made.where("wide is not null").select("node", "size", "wide")
        self.sketches = {end: nodes.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("size", *SKETCH))) for end in "ab"}
        self.groups: DataFrame | None = None  # (node, group) of merged nodes
        self.tried: DataFrame | None = None  # (a, b), in both orders, of what was compared

    def compare(self, pairs: DataFrame) -> int:
        """Merges the groups of pairs (a, b) that are alike; returns how many pairs were."""
        found = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tried is not None:
            found = found.join(self.tried, ["a", "b"], "left_anti")
        found = C.saved(found.join(self.sketches["a"], "a").join(self.sketches["b"], "b").where(may_be_alike()).select("a", "b"))
        found = self.narrowed(found)
        back = found.select(F.col("b").alias("a"), F.col("a").alias("b"))
        self.tried = found.unionByName(back) if self.tried is None else self.tried.unionByName(found).unionByName(back)
        degrees = C.saved(found.unionByName(back).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n")))
        one = C.saved(self.made.join(degrees, "node").groupBy("node").agg(F.min(self.id_col).alias(self.id_col)))
        texts = C.saved(self.df.select(self.id_col, F.col(self.text_col).alias("t")).join(C.small(one), self.id_col).select("node", "t"))
        if texts.count() > one.count():  # repeated rows
            texts = C.saved(texts.dropDuplicates(["node"]))
        # the text of the end with fewer pairs travels to that of the other, which most of its pairs share
        n = {end: degrees.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}")) for end in "ab"}
        more = F.col("n_a") > F.col("n_b")
        turned = found.join(n["a"], "a").join(n["b"], "b").select(F.when(more, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(more, F.col("a")).otherwise(F.col("b")).alias("b"))
        width = self.width

        def alike(a, b, s, t):
            marks, sets = [], {x: shingles(x, width) for x in {*s, *t}}
            for x, y in zip(s, t, strict=True):
                x, y = sets[x], sets[y]
                marks.append(len(np.intersect1d(x, y, True)) >= least_overlap(len(x), len(y)))
            return [a, b, marks]

        both = turned.join(texts.select(F.col("node").alias("a"), F.col("t").alias("s")), "a").join(texts.withColumnRenamed("node", "b"), "b")
        links = C.saved(C.per_batch(both, ["a", "b", "s", "t"], "src long, dst long, linked boolean", alike, PAIRS).where("linked").select("src", "dst"))
        n = links.count()
        if n:
            self._merge(links)
        return n

    def narrowed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that pass the bound of the long sketches, too."""
        asked = C.saved(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
        known = C.saved(self.wide.join(C.small(asked), "node").groupBy("node").agg(F.first("size").alias("size"), F.first("wide").alias("wide")))
        both = pairs
        for end in "ab":
            both = both.join(known.select(F.col("node").alias(end), F.col("size").alias(f"n_{end}"), F.col("wide").alias(f"w_{end}")), end)

        def passed(a, b, na, nb, wa, wb):
            bits = lambda w: np.frombuffer(b"".join(w), np.uint64).reshape(len(w), -1)
            differ = np.bitwise_count(bits(wa) ^ bits(wb)).sum(1) if a else np.empty(0)
            near = (DENOMINATOR + NUMERATOR) * differ <= (DENOMINATOR - NUMERATOR) * (np.array(na, np.int64) + np.array(nb, np.int64))
            return [a, b, near]

        return C.saved(C.per_batch(both, ["a", "b", "n_a", "n_b", "w_a", "w_b"], "a long, b long, near boolean", passed).where("near").select("a", "b"))

    def _merge(self, links: DataFrame) -> None:
        if self.groups is None:
            self.groups = C.saved(C.connected_components(links).withColumnRenamed("component", "group"))
            return
        named = self.groups
        for end in ("src", "dst"):
            links = links.join(named.withColumnsRenamed({"node": end, "group": "to"}), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        joined = C.saved(C.connected_components(links))
        before = named.join(joined.withColumnRenamed("node", "group"), "group", "left").select("node", F.coalesce("component", "group").alias("group"))
        alone = joined.join(named.select("node"), "node", "left_anti").select("node", F.col("component").alias("group"))
        self.groups = C.saved(before.unionByName(alone))

    def grouped(self, rows: DataFrame) -> DataFrame:
        """rows (node, ...) with the column group: a node that isn't merged is its own."""
        if self.groups is None:
            return rows.withColumn("group", F.col("node"))
        return rows.join(self.groups, "node", "left").withColumn("group", F.coalesce("group", "node"))


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b): forests of the nodes within RADIUS bits of each other's SimHash, by operator 7's trees."""
    first = C.saved(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    found = simhash.links(first.select("fp"), RADIUS)
    far = found.join(first.withColumnsRenamed({"fp": "src", "first": "a"}), "src").join(first.withColumnsRenamed({"fp": "dst", "first": "b"}), "dst").select("a", "b")
    equal = nodes.join(first, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return far.unionByName(equal)


def may_be_alike() -> Column:
    """Bounds that sets a and b with Jaccard 0.8 or more keep: their sizes, and the bits in which their sketches differ."""
    a, b = F.col("size_a"), F.col("size_b")
    differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SKETCH), F.lit(0))
    return (NUMERATOR * a <= DENOMINATOR * b) & (NUMERATOR * b <= DENOMINATOR * a) & ((DENOMINATOR + NUMERATOR) * differ <= (DENOMINATOR - NUMERATOR) * (a + b))


def size_band(size: str) -> Column:
    """Bands each a quarter wider than the one before: sets whose sizes are within DENOMINATOR / NUMERATOR are in one band or in neighbours."""
    return F.floor(F.log(F.greatest(F.col(size), F.lit(1))) / math.log(1.0001 * DENOMINATOR / NUMERATOR))


def near_duplicates(df: DataFrame, id_col: str, text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """(id_col, component_id) of every row: component_id is the smallest id that can be reached by links; ids aren't null.

    Null texts and those without words are one group, texts with equal shingles are one; repeated rows
    repeat; texts of any length are compared whole; further columns, whatever their names, are left out;
    an empty table gives an empty one.
    """
    made = C.saved(read(df, id_col, text_col, width))
    nodes = C.saved(made.groupBy("node").agg(*(F.first(c).alias(c) for c in NODE)))
    links = Links(df, made.select(id_col, "node", "size", "wide"), nodes, id_col, text_col, width)
    shared = C.saved(common(made.where("tokens is not null").select(F.explode("tokens").alias("token"), "node")))
    # shingles of a node's prefix that it has to itself: the base of a group of copies has the fewest
    own = shared.groupBy("node").agg(F.count("*").alias("n"))
    known = C.saved(nodes.select("node", "n_prefix").join(own, "node").select("node", (F.col("n_prefix") - F.col("n")).alias("alone")))
    links.compare(by_fingerprint(nodes.where("size > 0").select("node", "fp")).unionByName(stars(shared.join(C.small(known), "node"))))
    rows, best = mixed(links, known, shared)
    of = {end: rows.join(links.sketches[end].withColumnRenamed(end, "node"), "node").withColumnsRenamed({"node": end, "group": f"group_{end}"}) for end in "ab"}
    outside = of["a"].join(best, "token").where(F.col("group_a") != F.col("hub_group"))
    once = (F.col("group_b") == F.col("hub_group")) | (F.col("group_a") < F.col("group_b"))
    # linked sets are of one band of sizes or of neighbours, so a shingle of many nodes is dealt by bands and never compares sets of far sizes
    outside = outside.withColumn("band", F.explode(F.array(*(size_band("size_a") + k for k in (-1, 0, 1)))))
    near = of["b"].withColumn("band", size_band("size_b")).withColumnRenamed("token", "own_token")
    pairs = outside.join(near, (outside.token == near.own_token) & (outside.band == near.band) & (F.col("group_a") != F.col("group_b")) & once & may_be_alike())
    links.compare(pairs.select("a", "b"))
    every = links.grouped(made.select(id_col, "node"))
    low = every.groupBy("group").agg(F.min(id_col).alias("component_id"))
    return every.join(low, "group").select(id_col, "component_id")


def stars(rows: DataFrame) -> DataFrame:
    """(a, b): each node of rows (token, node, alone) and the hub that it meets at most of its tokens."""
    hubs = rows.groupBy("token").agg(F.min(F.struct("alone", "node")).alias("hub")).select("token", F.col("hub.node").alias("hub"))
    met = rows.join(hubs, "token").where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("n"))
    return met.groupBy("node").agg(F.max(F.struct("n", "hub")).alias("top")).select(F.col("node").alias("a"), F.col("top.hub").alias("b"))


def mixed(links: Links, known: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the tokens whose nodes are in different groups: (token, node, group), and (token, hub_group), its largest group."""
    rows = rows.join(C.small(C.saved(links.grouped(known.select("node")))), "node")
    several = rows.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("token")
    rows = C.saved(rows.join(several, "token", "left_semi"))
    sizes = rows.groupBy("token", "group").agg(F.count("*").alias("n"))
    return rows, C.saved(sizes.groupBy("token").agg(F.max(F.struct("n", "group")).alias("top")).select("token", F.col("top.group").alias("hub_group")))
