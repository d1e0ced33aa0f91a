"""Near copies: cover tree, SimHash and components against brute force."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tagsim.llm import cover_tree
from tagsim.llm.components import components
from tagsim.llm.common import stored
from tagsim.llm.cover_tree import Block, Groups, Tree, dual_traversal, near_vectors, vector_links
from tagsim.llm.simhash import drop_near_copies, fingerprint, hex_fingerprint, near_links, simhash_groups
from tests.helpers import SMALL


def grouped(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [tuple(x) for x in rng.integers(200, 400, (150, 2)).tolist()] + [(7, 7), (-5, 2)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    real = [(a, b) for a, b in chain if a != b]
    assert got == grouped({x for p in real for x in p}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def cloud(seed: int, n: int, dim: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * rng.choice([0.0, 0.01, 0.1, 0.4], (n, 1))
    return x


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 120), st.integers(1, 60))
def test_dual_traversal_counts_and_joins_as_all_pairs_do(seed, n, m):
    raw = cloud(seed, n + m)
    x = raw / np.linalg.norm(raw, axis=1)[:, None]
    w = np.random.default_rng(seed).integers(1, 4, n + m)
    near = (x @ x.T) >= 0.9
    np.fill_diagonal(near, False)
    whole = Block(raw, w)
    order, groups = whole.tree.order, Groups(n + m)
    assert Block.unpacked(whole.packed()).raw.tolist() == raw[order].tolist()
    got, _ = dual_traversal(Block.unpacked(whole.packed()), None, groups, 0.9)
    assert got.tolist() == (near * w).sum(axis=1)[order].tolist()
    assert same_groups({k: v for k, v in enumerate(groups.name)}, grouped(range(n + m), np.argwhere(near[np.ix_(order, order)]).tolist()))
    one, two, groups = Block(raw[:n], w[:n]), Block(raw[n:], w[n:]), Groups(n + m)
    a, b = dual_traversal(one, two, groups, 0.9)
    cross, across, down = near[:n, n:][np.ix_(one.tree.order, two.tree.order)], w[n:][two.tree.order], w[:n][one.tree.order]
    assert a.tolist() == (cross * across).sum(axis=1).tolist() and b.tolist() == (cross.T * down).sum(axis=1).tolist()
    assert same_groups({k: v for k, v in enumerate(groups.name)}, grouped(range(n + m), [(i, n + j) for i, j in np.argwhere(cross).tolist()]))


def same_groups(a: dict, b: dict) -> bool:
    """Whether two namings tell the same groups."""
    return len({(a[k], b[k]) for k in a}) == len(set(a.values())) == len(set(b.values()))


def test_tree_covers():
    x = cloud(5, 300)
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = Tree.of(x)
    rows = x[t.order]
    assert sorted(t.order.tolist()) == list(range(300))
    for k in range(len(t.start)):
        assert np.linalg.norm(rows[t.start[k] : t.end[k]] - rows[t.centre[k]], axis=1).max() <= t.radius[k] + 1e-9


@pytest.mark.parametrize("block", [7, 4096])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "SMALL_BLOCK", block)
    x = cloud(11, 90)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, x[0].tolist()), (201, (x[0] * 3).tolist()), (202, [0.0] * 8), (203, None), (204, [float("nan")] * 8), (205, [None] * 8), (206, []), (207, [1.0]), (208, [2.0]), (209, [1e200] * 8), (210, [1e-200] * 8), (211, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "vec_id long, embedding array<double>, n_links string, uid int")
    got = {r["vec_id"]: r for r in near_vectors(df, block=block).collect()}
    assert len(got) == len(rows)
    whole = {i: np.array(v) for i, v in rows[:92]} | {209: np.ones(8), 210: np.ones(8)}
    ids = list(whole)
    unit = np.array([v / np.linalg.norm(v) for v in whole.values()])
    near = (unit @ unit.T) >= 0.9
    links = [(ids[i], ids[j]) for i, j in np.argwhere(near) if i != j] + [(207, 208)]
    expected = grouped(got, links)
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(a == i for a, _ in links) + (i == 208) for i in got}
    assert all(r["kept"] == (i == expected[i]) for i, r in got.items())


@pytest.mark.parametrize("block", [256, 4096])
def test_vectors_of_64_dimensions_and_few_link_rows(spark, monkeypatch, block):
    """2000 vectors at a cosine of about 0.95 to each other, and groups of others, against all pairs."""
    monkeypatch.setattr(cover_tree, "SMALL_BLOCK", block)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=64)
    x = np.concatenate([centre + rng.normal(size=(2000, 64)) * 0.23, np.repeat(rng.normal(size=(30, 64)), 5, axis=0) + rng.normal(size=(150, 64)) * 0.3, rng.normal(size=(300, 64))])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T) >= 0.9
    np.fill_diagonal(near, False)
    assert near.sum() > 2_000_000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in near_vectors(df, block=block).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(axis=1).tolist()
    forest = []  # enough of the links to join what all join
    for i in range(len(x)):
        forest += [(i, int(j)) for j in np.flatnonzero(near[i])[:1]] + [(i, int(j)) for j in np.flatnonzero(near[i]) if i >= 2000]
    first = np.flatnonzero(near[0])
    forest += [(0, int(j)) for j in first] + [(i, int(np.flatnonzero(near[i] & near[0])[0])) for i in range(2000) if (near[i] & near[0]).any()]
    assert {i: r["component_id"] for i, r in got.items()} == grouped(range(len(x)), forest)
    links = vector_links(stored(df.selectExpr("vec_id AS uid", "1L AS weight", "embedding AS vec"), "test_vectors"), block=block)
    assert links.filter("other IS NOT NULL").count() < len(x) and links.count() < 12 * len(x)


def test_near_vectors_with_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [1.0, 0.001]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors(df).collect()), key=repr)
    assert got == sorted([(None, 2, 3), (None, 2, 3), (3, 2, 3), (None, 0, None)], key=repr)
    assert near_vectors(df.limit(0)).count() == 0


def plain_fingerprint(text) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for text in [None, "", " \t\n", "One", "one TWO", "É É é", "a b c", "a b c a b c a b", "x\u00a0y z\x1cw v", "w " * 40_000 + "end of it"]:
        assert fingerprint(text) == plain_fingerprint(text), text


@pytest.mark.parametrize("seed", range(3))
def test_links_join_what_all_pairs_join(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**63), 2**63, 12)
    fps = set(base.tolist()) | {0, -1}
    for _ in range(220):  # walks of a few bits, so that groups hold chains, and near misses of four bits
        x = int(rng.choice(list(fps))) & (2**64 - 1)
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            x ^= 1 << int(b)
        fps.add(x - 2**64 if x >> 63 else x)
    fps = sorted(fps)
    links = near_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(apart(r["a"], r["b"]) <= 3 for r in links)
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if apart(a, b) <= 3]
    assert grouped(fps, [(r["a"], r["b"]) for r in links]) == grouped(fps, pairs)


def test_simhash_groups(spark):
    body = " ".join(f"word{i}" for i in range(400))
    rows = [(5, body), (3, body), (9, body + " more"), (7, None), (8, ""), (None, body), (None, "alone here"), (5, body), (11, "a completely different text of words")]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, fp string, kept double")
    got = simhash_groups(df).select("doc_id", hex_fingerprint(__import__("pyspark").sql.functions.col("fp")).alias("h"), "component_id", "kept").collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=repr) == sorted([(5, 3), (3, 3), (9, 3), (7, 7), (8, 7), (None, 3), (None, None), (5, 3), (11, 11)], key=repr)
    assert {r["h"] for r in got if r["doc_id"] in (7, 8)} == {"0" * 16} and all(len(r["h"]) == 16 for r in got)
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(3, body), (7, None), (None, "alone here"), (11, rows[-1][1])], key=repr)
    assert simhash_groups(df.limit(0)).count() == 0


def test_query_against_all_pairs(spark):
    from tagsim.llm.simhash import op2_simhash

    got = {r["doc_id"]: r for r in op2_simhash(spark, SMALL).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    fps = {i: int(r["fingerprint"], 16) for i, r in got.items()}
    assert fps == {i: plain_fingerprint(t) for i, t in texts.items()}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    assert {i: r["component_id"] for i, r in got.items()} == grouped(fps, links)
