import random

import numpy as np
import pytest
import xxhash

from lakeloom.llm import _common as C
from lakeloom.llm import simhash as A
from tests.llm import cases


def slow_fingerprint(text, width=3):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), seed=42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps, radius):
    """Component (smallest position) of each fingerprint."""
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    for _, text in cases.TEXTS:
        assert A.fingerprint(text) == slow_fingerprint(text)
    assert A.fingerprint("One TWO") == slow_fingerprint("one two") and A.fingerprint("É É É") == slow_fingerprint("É É É")


def test_chunks_do_not_show(monkeypatch):
    want = A.fingerprint(cases.LONG)
    monkeypatch.setattr(A, "CHUNK", 100)
    assert A.fingerprint(cases.LONG) == want


def test_documents_equal_brute_force(spark):
    rows = sorted(A.op7_simhash_bktree(spark, "/root/testdata/sf0.01").collect(), key=lambda r: r.doc_id)
    found = brute([int(r.fingerprint, 16) for r in rows], 3)
    assert [r.component_id for r in rows] == [rows[k].doc_id for k in found]
    texts = {r.doc_id: r.text for r in cases.documents(spark, "/root/testdata/sf0.01").collect()}
    assert all(int(r.fingerprint, 16) == slow_fingerprint(texts[r.doc_id]) for r in rows[:100])


@pytest.mark.parametrize(("radius", "blocks", "shard"), [(3, 4, 8192), (3, 5, 8192), (3, 4, 40), (1, 2, 25)])
def test_clusters_hot_shards_and_split_parts(spark, monkeypatch, radius, blocks, shard):
    monkeypatch.setattr(A, "SHARD_ROWS", shard)
    rng = random.Random(radius + blocks + shard)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for center in [rng.getrandbits(64) for _ in range(3)]:  # dense clusters, of which many share a shard
        fps |= {center ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}) for _ in range(200)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = A.links(spark.createDataFrame([(s,) for s in signed], "fp long"), radius, blocks)
    assert edges.where("bit_count(src ^ dst) > " + str(radius)).count() == 0
    comp = {r.node: r.component for r in C.connected_components(edges).collect()}
    got: dict = {}
    for k, s in zip(brute(fps, radius), signed, strict=True):
        got.setdefault(k, set()).add(comp.get(s, s))
    assert all(len(v) == 1 for v in got.values()) and len(set().union(*got.values())) == len(got)


def test_longer_keys_for_more_fingerprints():
    assert [A.blocks_for(n, 3) for n in (0, 10**6, 3 * 10**7, 10**9, 10**12, 10**13)] == [4, 4, 4, 5, 6, 7]
    assert all(n <= A.AIM << (64 * (b - 3) // b) for n in (10**8, 10**10, 10**11) for b in [A.blocks_for(n, 3)])


def test_bk_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    fps[250:] = fps[:250] ^ (np.uint64(1) << rng.integers(0, 64, 250).astype(np.uint64))
    forest = A.Forest(500)
    A.bk_links(fps, np.arange(500), np.arange(500), 3, forest)
    want = brute([int(f) for f in fps], 3)
    roots = forest.roots(np.arange(500)).tolist()
    assert [roots.index(r) for r in roots] == [want.index(w) for w in want]


def test_hard_cases(spark):
    df = cases.frame(spark)
    rows = A.near_duplicates(df).collect()
    assert len(rows) == len(cases.TEXTS)
    by = {r.doc_id: r.component_id for r in rows}
    assert by[1] == by[2] == 1 and by[3] == by[4] == by[5] == 3 and by[6] == 6 and by[None] is None
    assert A.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7, 6)]
    got = {r.node: r.component for r in C.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300))
