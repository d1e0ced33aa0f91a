"""What keeps work small at size: filters of candidates, split tags, stored indexes, masks of words, skipped cells, removed tables."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagsim.functions.similarity import word_cosine
from tagsim.operators import dense, sets, vocab
from tagsim.operators.corpus import corpus_related, signature_edges
from tagsim.operators.dense import embedding_top_k
from tagsim.operators.search import SearchIndex, search
from tagsim.operators.sets import TagSets, best_candidates, dealt, heavy_tags, overlap_scores, similar_candidates, similar_sets, tag_join
from tagsim.operators.vocab import Vocabulary, build_vocab, in_vocab, tag_words, vocab_list, word_tags
from tagsim.plans.workloads import Corpus
from tagsim.sources import tables
from tagsim.sources.tables import read_query_stream, scratch_root, scratch_scope, tag_rules, written
from tagsim.streaming.stream import rank_stream

TAGS = "tags array<string>"


def skewed(seed: int, n: int, tags: int = 300, most: int = 14) -> dict[int, set[str]]:
    """Tag sets in which few tags are very frequent; groups of sets are alike, and some are equal."""
    draw = random.Random(seed)
    weights = [1 / (i + 1) for i in range(tags)]
    found: dict[int, set[str]] = {}
    for i in range(n):
        if i % 3 and found:
            own = set(found[draw.randrange(max(0, i - 30), i)])
            for _ in range(draw.randint(0, 3)):
                own.add(f"t{draw.randrange(tags)}")
                own.discard(draw.choice(sorted(own)))
        else:
            own = {f"t{t}" for t in draw.choices(range(tags), weights, k=draw.randint(1, most))}
        found[i] = own
    return found


def frame(spark, by: dict[int, set[str]], key: str = "case_id"):
    return spark.createDataFrame([(i, sorted(t)) for i, t in by.items()], f"{key} long, {TAGS}")


def cosine(a: set, b: set) -> float:
    return len(a & b) / (len(a) ** 0.5 * len(b) ** 0.5) if a and b else 0.0


@pytest.fixture(scope="module")
def corpus(spark):
    by = skewed(1, 400)
    cases = frame(spark, by)
    known = Vocabulary.of(build_vocab(cases))
    return by, cases, known, TagSets.of(cases, known, "case_id")


def named(by: dict[int, set[str]]) -> dict[frozenset, int]:
    return {frozenset(t): i for i, t in sorted(by.items(), reverse=True) if t}


@pytest.mark.parametrize(("threshold", "heavy"), [(0.35, 20_000), (0.6, 5), (0.8, 20_000), (1.0, 5)])
def test_similar_sets_are_those_of_all_pairs_with_far_fewer_candidates(spark, corpus, monkeypatch, threshold, heavy):
    monkeypatch.setattr(sets, "HEAVY", heavy)
    by, _, _, own = corpus
    least = {r["sig"]: r["least"] for r in own.members.groupBy("sig").agg(F.min("case_id").alias("least")).collect()}
    different = list(named(by))
    name = named(by)
    want = {(min(name[a], name[b]), max(name[a], name[b])): cosine(a, b) for a in different for b in different if cosine(a, b) >= threshold}
    got = {tuple(sorted((least[r["a_sig"]], least[r["b_sig"]]))): r["score"] for r in similar_sets(own, threshold).collect()}
    assert got == want and len(got) == similar_sets(own, threshold).count()
    sharing = sum(bool(a & b) for i, a in enumerate(different) for b in different[: i + 1])
    candidates = similar_candidates(own, threshold).count()
    assert len(want) <= candidates < sharing * {0.35: 0.75, 0.6: 0.35, 0.8: 0.12, 1.0: 0.05}[threshold]


def test_wide_edges_and_neighbours_are_those_of_all_pairs(corpus):
    by, cases, known, _ = corpus
    tags = vocab_list(known.table)
    mask = {t: i for i, t in enumerate(tags)}
    edges = signature_edges(cases, known, 0.5).select(word_tags(F.col("mask_a")).alias("a"), word_tags(F.col("mask_b")).alias("b"), "n_a", "n_b", "sim", (F.col("mask_a") <= F.col("mask_b")).alias("ordered")).collect()
    count: dict[frozenset, int] = {}
    for t in by.values():
        count[frozenset(mask[x] for x in t)] = count.get(frozenset(mask[x] for x in t), 0) + 1
    got = {frozenset([(frozenset(r["a"]), r["n_a"]), (frozenset(r["b"]), r["n_b"])]): r["sim"] for r in edges}
    want = {frozenset([(a, n), (b, m)]): cosine(a, b) for a, n in count.items() for b, m in count.items() if cosine(a, b) >= 0.5}
    assert got == want and all(r["ordered"] for r in edges)
    near = {}
    for r in corpus_related(cases, known, 3).orderBy("case_id", "pos").collect():
        near.setdefault(r["case_id"], []).append((r["related_id"], r["sim"]))
    for i, t in by.items():
        others = sorted((-cosine(t, u), j) for j, u in by.items() if j != i and t & u)[:3]
        assert near.get(i, []) == [(j, -s) for s, j in others]


@pytest.mark.parametrize("k", [1, 6])
def test_wide_search_scores_few_pairs_and_finds_the_same_rows(spark, corpus, k):
    by, cases, known, own = corpus
    asked = skewed(2, 60, most=6) | {1000: {"nowhere"}, 1001: {"t0"}, 1002: set(), 1003: {"t0", "nowhere", "t1"}, 1004: by[3]}
    queries = frame(spark, asked, "query_id")
    got: dict[int, list] = {}
    for r in search(queries, cases, known, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["case_id"], r["score"]))
    everything = set().union(*by.values())
    for q, t in asked.items():
        want = sorted((-cosine(t & everything, u), i) for i, u in by.items() if t & u)[:k]
        assert got.get(q, []) == [(i, -s) for s, i in want]
    index, q = SearchIndex.of(cases, known, k), TagSets.of(queries, known, "query_id")
    scored = best_candidates(q, index.sets, index.postings, index.frequencies, k).count()
    different = {frozenset(t & everything) for t in asked.values() if t & everything}
    sharing = sum(bool(a & b) for a in different for b in named(by))
    assert scored < sharing * (0.25 if k == 6 else 0.2)
    with pytest.raises(ValueError, match="holds"):
        index.search(queries, k + 1)


def test_a_tag_of_half_the_rows_is_split(spark):
    """No part of a tag has many more rows than others, and the tasks of the join have about as many each."""
    rows = [(i, "hot" if i % 2 else f"t{i % 997}") for i in range(12_000)]
    left = written(spark.createDataFrame(rows, "a long, tag string"), "left")
    right = written(spark.createDataFrame([(i, "hot" if i % 2 else f"t{i % 997}") for i in range(900)], "b long, tag string"), "right")
    cuts = heavy_tags(left, right, 150, "tag")
    assert [tuple(r) for r in cuts.collect()] == [("hot", 40, 3)]
    a, b = dealt(left, right, cuts, "tag")
    assert max(r["count"] for r in a.groupBy("tag", "left_part", "right_part").count().collect()) < 230
    assert max(r["count"] for r in b.groupBy("tag", "left_part", "right_part").count().collect()) < 230
    for side in (a, b):
        tasks = [r["count"] for r in side.repartition(12, "tag", "left_part", "right_part").groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(tasks) == 12 and max(tasks) < 2.5 * np.median(tasks)
    # light tags are not repeated
    assert a.filter("tag <> 'hot'").count() == 6_000 and b.filter("tag <> 'hot'").count() == 450
    whole = tag_join(left, right, "tag", 150).groupBy("a", "b").count()
    assert whole.filter("count > 1").count() == 0 and whole.count() == left.join(right, "tag").count()


def test_split_scores_are_plain_scores(spark):
    by = skewed(4, 120, tags=80)
    long = written(spark.createDataFrame([(i, t) for i, ts in by.items() for t in ts], "x long, tag string"), "long")
    plain = {(a, b): cosine(s, t) for a, s in by.items() for b, t in by.items() if s & t}
    for heavy in (20_000, 7):
        got = overlap_scores(long.withColumnRenamed("x", "query_id"), long.withColumnRenamed("x", "case_id"), heavy=heavy)
        assert {(r["query_id"], r["case_id"]): r["score"] for r in got.collect()} == plain


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 400)), st.sets(st.integers(0, 400))), min_size=1, max_size=20))
def test_masks_of_words(spark, pairs):
    known = Vocabulary.listed(spark, [f"t{i}" for i in range(401)])
    assert known.tags is None
    rows = [(i, [f"t{x}" for x in a] + ["unknown"] + [f"t{x}" for x in a], [f"t{x}" for x in b]) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "id long, x array<string>, y array<string>")
    both = df.select("id").join(tag_words(df, known, "id", "x", "a"), "id").join(tag_words(df, known, "id", "y", "b"), "id")
    got = {r["id"]: r for r in both.select("id", word_tags(F.col("a")).alias("a"), word_cosine(F.col("a"), F.col("b")).alias("score")).collect()}
    assert set(got) == {i for i, (a, b) in enumerate(pairs) if a and b}
    for i, r in got.items():
        a, b = pairs[i]
        assert r["a"] == sorted(a) and r["score"] == cosine(a, b)


def test_a_vocabulary_of_200_000_tags(spark, monkeypatch):
    monkeypatch.setattr(vocab, "MAX_BROADCAST", 1000)  # numbered by ranges, joined as a table
    own = F.expr("transform(sequence(0, 49), i -> concat('t', cast((id * 40 + i) * 7919 % 200000 AS string)))")
    cases = written(spark.range(5000).select(F.col("id").alias("case_id"), own.alias("tags")).repartition(6), "cases")
    known = Vocabulary.of(build_vocab(cases))
    assert known.size == 200_000 and known.tags is None
    # the k-th new tag of the table, by case and place
    seen: dict[str, int] = {}
    for i in range(5000):
        for j in range(50):
            seen.setdefault(f"t{(i * 40 + j) * 7919 % 200000}", len(seen))
    assert {r["tag"]: r["idx"] for r in known.table.collect()} == seen
    with pytest.raises(ValueError, match="used as a table"):
        vocab_list(known.table)
    some = spark.createDataFrame([(1, ["x", "t15838", "t0", "t7919", "t0"]), (2, ["x"]), (3, None)], f"case_id long, {TAGS}").selectExpr("*", "'other' AS tag")
    assert [(r["case_id"], r["tags"], r["tag"]) for r in in_vocab(some, known).orderBy("case_id").collect()] == [(1, ["t0", "t7919", "t15838"], "other"), (2, [], "other"), (3, [], "other")]
    found = search(some.filter("case_id = 1").select(F.col("case_id").alias("query_id"), "tags"), cases, known).collect()
    assert found[0]["case_id"] == 0 and found[0]["score"] == 3 / (3**0.5 * 50**0.5)


def test_batches_of_a_stream_share_one_index(spark, tmp_path, monkeypatch):
    for part in range(3):
        spark.createDataFrame([(10 * part + i, t) for i, t in enumerate(["<a> <b>", "<b>", "none", None])], "query_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "queries"))
    for wide in (False, True):
        rules = tag_rules(spark, {t: [f"<{t}>"] for t in ("a", "b", *[f"c{i}" for i in range(70)])})
        tagged = {1: {"a"}, 2: {"a", "b"}, 3: {"b"}} | ({100 + i: {f"c{i}"} for i in range(70)} if wide else {})
        names: list[str] = []
        real = tables.scratch_path
        monkeypatch.setattr(tables, "scratch_path", lambda s, name: names.append(name) or real(s, name))
        stream = read_query_stream(spark, str(tmp_path / "queries"))
        stream = spark.readStream.schema(stream.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "queries"))
        corpus, out = Corpus.of(frame(spark, tagged)), tmp_path / f"out{wide}"
        before = set(os.listdir(scratch_root(spark).removeprefix("file://")))
        rank_stream(stream, corpus, rules, str(out), str(tmp_path / f"state{wide}")).awaitTermination()
        monkeypatch.setattr(tables, "scratch_path", real)
        batches = [p for p in os.listdir(out) if p.startswith("batch=") and p != "batch=-1"]
        assert len(batches) == 3 and names.count("search_index") == 1 and names.count("tagged_cases") == 1
        # what the batches wrote on their way is gone, what they share is still there
        left = {p.split("-")[0] for p in set(os.listdir(scratch_root(spark).removeprefix("file://"))) - before}
        assert "search_index" in left and not left & {"query_signatures", "search_candidates", "members_of_queries", "query_prefixes"}
        got = sorted((r["query_id"], r["case_id"]) for r in spark.read.parquet(str(out)).collect())
        assert got == sorted((10 * p + q, c) for p in range(3) for q, c in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3)))


def near_rows(queries: dict, vectors: dict, k: int) -> list[tuple]:
    out = []
    for q, a in queries.items():
        scores = sorted((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), i) for i, b in vectors.items())
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate([x for x in scores if x[0] < 0][:k])]
    return sorted(out)


@pytest.mark.parametrize("clustered", [True, False])
def test_dense_cells_that_cannot_hold_a_result_are_skipped(spark, monkeypatch, clustered):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, 16))
    x = centres[rng.integers(0, 25, 1500)] * (3 if clustered else 0) + rng.normal(size=(1500, 16)) * (0.3 if clustered else 1)
    vectors = dict(enumerate(x))
    queries = {i: v for i, v in vectors.items() if i % 20 == 0} | {9000: centres[0] * -1.0}
    schema = "vec_id long, embedding array<double>"
    v, q = (spark.createDataFrame([(i, a.tolist()) for i, a in rows.items()], schema) for rows in (vectors, queries))
    sent: dict[str, int] = {}
    real = dense.written

    def counted(df, name):
        table = real(df, name)
        sent[name] = table.count()
        return table

    monkeypatch.setattr(dense, "written", counted)
    for block in (8192, 40):
        monkeypatch.setattr(dense, "BASE_BLOCK", block)
        monkeypatch.setattr(dense, "QUERY_BLOCK", block // 2)
        got = embedding_top_k(q, v, 6, cells=25)
        assert sorted(tuple(r) for r in got.collect()) == near_rows(queries, vectors, 6)
        if clustered:
            assert sent["dense_near"] + sent["dense_far"] < 0.25 * 25 * len(queries)
    assert embedding_top_k(q.limit(0), v).count() == embedding_top_k(q, v.limit(0)).count() == 0


def test_dense_odd_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [1.0, 0.0]), (1, [1.0]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [0.0, 0.0]), (5, []), (6, None), (7, [1e200, 1e200]), (8, [-1.0, 0.0]), (None, [2.0, 0.0])]
    v = spark.createDataFrame(rows, schema)
    got = {(r["query_id"], r["vec_id"], r["score"]) for r in embedding_top_k(v.filter("vec_id < 8"), v).collect()}
    assert got == {(0, 0, 1.0), (0, 7, 0.707107), (0, None, 1.0), (1, 1, 1.0), (7, 7, 1.0), (7, 0, 0.707107), (7, None, 0.707107)}


def test_a_scope_removes_its_tables_also_after_an_error(spark):
    root = scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    with scratch_scope(spark):
        outer = written(spark.range(3), "outer")
        with pytest.raises(ZeroDivisionError), scratch_scope(spark):
            written(spark.range(3), "inner")
            raise ZeroDivisionError
        assert {p.split("-")[0] for p in set(os.listdir(root)) - before} == {"outer"} and outer.count() == 3
    assert set(os.listdir(root)) == before
    kept = written(spark.range(2), "kept")
    assert kept.count() == 2 and len(set(os.listdir(root)) - before) == 1
