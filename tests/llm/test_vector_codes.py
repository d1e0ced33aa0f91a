"""Vector codes: trees and rounds against plain arithmetic, odd rows, SQL."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagsim.llm import vector_codes as codes
from tagsim.llm.vector_codes import PartTree, squared, vector_codes, whole_numbers

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    """Without trees, in Python's numbers: {(vec_id, vector): (code, error)}, errors by label, digest. rows: (vec_id, vector, label)."""
    ordered = sorted(((i, v, y) for i, v, y in rows), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    numbers = [[int(np.floor(x * 1024)) for x in v] for _, v, _ in ordered]
    width = len(numbers[0]) // parts
    cut = [[n[p * width : (p + 1) * width] for n in numbers] for p in range(parts)]
    books = [[list(v) for v in c[:entries]] for c in cut]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            taken = [near(v, books[p])[1] for v in cut[p]]
            for k in range(len(books[p])):
                own = [v for v, t in zip(cut[p], taken, strict=True) if t == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found, by_label = [], {}
    for j, (i, _, y) in enumerate(ordered):
        best = [near(cut[p][j], books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        found.append((i, "".join(f"{k:02x}" for _, k in best), error, y))
        by_label[y] = by_label.get(y, 0) + error
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[y], digest) for i, c, e, y in found), key=repr)


def clustered(seed, n, dim, copies=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(5, dim))[rng.integers(0, 5, n)] * 0.2 + rng.normal(size=(n, dim)) * rng.choice([0, 0.002, 0.05], (n, 1))
    same = rng.random(n) < copies
    x[same] = x[0]
    return x


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 150), st.integers(1, 5), st.integers(1, 40), st.sampled_from([1, 1000, 10**12, 10**25]))
def test_a_tree_assigns_as_all_comparisons_do(seed, n, width, entries, scale):
    rng = np.random.default_rng(seed)
    x = whole_numbers(clustered(seed, n, width) * scale)
    book = x[rng.integers(0, n, entries)]
    tree = PartTree.of(x)
    entry, whole, _ = tree.assign(book)
    d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)) for e in book] for p in tree.points]
    assert entry.tolist() == [row.index(min(row)) for row in d]
    count, total = tree.totals(whole, len(book))
    of = np.empty(n, dtype=np.int64)
    of[tree.rows] = np.repeat(entry, np.diff(tree.at))
    for k in range(len(book)):
        assert count[k] == (of == k).sum()
        assert [int(v) for v in total[k]] == [sum(int(v) for v in x[of == k][:, c]) for c in range(width)]


def test_subtrees_are_assigned_whole():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(16, 4))
    x = whole_numbers(np.concatenate([centres, centres[rng.integers(0, 16, 3000)] + rng.normal(size=(3000, 4)) * 0.02, np.tile(centres[:1], (4000, 1))]))
    tree = PartTree.of(x)
    entry, whole, compared = tree.assign(x[:16])
    assert len(tree.points) > 2500 and len(whole) < len(tree.points) / 10
    assert compared < len(tree.points) / 10
    assert entry.tolist() == squared(tree.points, x[:16]).argmin(axis=1).tolist()


def test_codes_are_those_of_plain_rounds(spark, monkeypatch):
    rows = [(int(i), v, int(i) % 3 if i % 5 else None) for i, v in zip(np.random.default_rng(4).permutation(600), clustered(4, 600, 8).tolist(), strict=True)]
    rows += [rows[0], rows[1]]
    want = plain(rows)
    for n, block in ((1, 2048), (5, 37)):
        monkeypatch.setattr(codes, "BLOCK", block)
        got = vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(n))
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_large_components_are_exact(spark):
    rows = [(i, [x * 10.0**17 for x in v], 0) for i, v in enumerate(clustered(6, 40, 4, copies=0).tolist())]
    got = vector_codes(spark.createDataFrame(rows, SCHEMA), entries=5)
    want = plain(rows, entries=5)
    most = (1 << 63) - 1
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(((i, c, min(e, most), min(t, most), g) for i, c, e, t, g in want), key=repr)


def test_odd_rows(spark):
    good = [(i, v, None) for i, v in enumerate(clustered(7, 9, 8).tolist())]
    bad = [(100, None, 1), (101, [], 1), (102, [None] + [0.0] * 7, 1), (103, [float("nan")] * 8, 1), (104, [float("inf")] + [1.0] * 7, 1), (105, [1.0] * 4, 1)]
    none = [(None, [0.5] * 8, 2)]
    df = spark.createDataFrame(bad + good + none, SCHEMA).selectExpr("*", "'x' AS data", "1 AS code", "2 AS ids", "3 AS error")
    assert sorted((tuple(r) for r in vector_codes(df).collect()), key=repr) == plain(good + none)
    empty = vector_codes(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes(spark.createDataFrame(bad[:5], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes(spark.createDataFrame([(1, [1.0] * 6, 0)], SCHEMA))
