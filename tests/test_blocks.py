"""Sets that meet in blocks: what is found is what all pairs give, and what is written grows with the sets and the result, not with the pairs that share a tag."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tagsim.operators import blocks, sets
from tagsim.operators import search as search_module
from tagsim.operators.corpus import corpus_related, signature_edges
from tagsim.operators.search import SearchIndex, score, score_counts, search
from tagsim.operators.sets import TagSets, numbered_by_hash, similar_sets
from tagsim.operators.vocab import Vocabulary, build_vocab
from tests.test_scale import cosine, frame, skewed


@pytest.fixture
def small_blocks(monkeypatch):
    """Many blocks of few sets, and rows given out in small batches."""
    for name, value in (("BLOCK_SETS", 40), ("LEAST_SETS", 40), ("BLOCK_TAGS", 200), ("BATCH", 50)):
        monkeypatch.setattr(blocks, name, value)


@pytest.fixture
def rows_written(monkeypatch):
    """How many rows each table that is written on the way has, by name."""
    count: dict[str, int] = {}
    real = sets.written

    def counted(df, name):
        table = real(df, name)
        count[name] = count.get(name, 0) + table.count()
        return table

    for module in (sets, search_module, blocks):
        monkeypatch.setattr(module, "written", counted)
    return count


def ranks(by, asked, k):
    everything = set().union(*by.values())
    return {(q, i, n + 1, -s) for q, t in asked.items() for n, (s, i) in enumerate(sorted((-cosine(t & everything, u), i) for i, u in by.items() if t & u)[:k])}


@pytest.mark.parametrize("by_hash", [False, True])
@pytest.mark.parametrize("k", [1, 6])
def test_a_search_writes_a_query_s_k_best_and_no_other_pair(spark, small_blocks, rows_written, by_hash, k):
    by, asked = skewed(1, 400), skewed(2, 60, most=6) | {1000: {"nowhere"}, 1001: {"t0"}, 1002: set(), 1003: {"t0", "nowhere", "t1"}}
    cases, queries = frame(spark, by), frame(spark, asked, "query_id")
    index = SearchIndex.by_hash(cases, k) if by_hash else SearchIndex.of(cases, Vocabulary.of(build_vocab(cases)), k)
    assert index.postings.blocks > blocks.ROUNDS
    rows_written.clear()
    got = {(r["query_id"], r["case_id"], r["rank"], r["score"]) for r in index.search(queries).collect()}
    assert got == ranks(by, asked, k)
    assert max(rows_written.values()) <= max(k, 6) * len(asked) and rows_written["search_candidates"] <= k * len(asked)


def test_neighbours_write_as_many_rows_as_there_are_results(spark, small_blocks, rows_written):
    by = skewed(5, 500)
    cases = frame(spark, by)
    got = {(r["case_id"], r["related_id"], r["pos"], r["sim"]) for r in corpus_related(cases, Vocabulary.of(build_vocab(cases)), 3).collect()}
    assert got == {(i, j, n + 1, -s) for i, t in by.items() for n, (s, j) in enumerate(sorted((-cosine(t, u), j) for j, u in by.items() if j != i and t & u)[:3])}
    assert max(rows_written.values()) <= 4 * len(by)


@pytest.mark.parametrize("threshold", [0.35, 0.8])
def test_pairs_at_a_threshold_are_not_written_on_the_way(spark, small_blocks, rows_written, threshold):
    by = skewed(7, 400)
    cases = frame(spark, by)
    different = {frozenset(t): i for i, t in sorted(by.items(), reverse=True)}
    want = {(min(different[a], different[b]), max(different[a], different[b])): cosine(a, b) for a in different for b in different if cosine(a, b) >= threshold}
    known = Vocabulary.of(build_vocab(cases))
    for own in (TagSets.of(cases, known, "case_id"), TagSets.by_hash(cases, "case_id", numbered_by_hash(cases)[1])):
        rows_written.clear()
        found = similar_sets(own, threshold).collect()
        assert {(min(r["a_sig"], r["b_sig"]), max(r["a_sig"], r["b_sig"])): r["score"] for r in found} == want and len(found) == len(want)
        # blocks only
        assert sum(rows_written.values()) < len(by) / 4
    rows_written.clear()
    assert signature_edges(cases, known, threshold).count() == len(want) and max(rows_written.values()) <= len(by)


def test_scores_are_counted_without_a_row_for_each_pair(spark, small_blocks, rows_written):
    by, asked = skewed(8, 300), skewed(9, 80, most=6) | {1000: {"nowhere"}, 1001: {"t0", "nowhere"}, 1002: set()}
    cases, queries = frame(spark, by), frame(spark, asked, "query_id")
    known = Vocabulary.of(build_vocab(cases))
    everything = set().union(*by.values())
    want: dict[tuple, int] = {}
    for t in asked.values():
        for u in by.values():
            if own := t & everything & u:
                key = (len(t & everything), len(own) / (len(t & everything) ** 0.5 * len(u) ** 0.5))
                want[key] = want.get(key, 0) + 1
    rows_written.clear()
    assert {(r["n_tags"], r["score"]): r["n_pairs"] for r in score_counts(queries, cases, known).collect()} == want
    assert max(rows_written.values()) <= len(by) + len(asked)
    listed = score(queries, cases, known).select(F.aggregate("q_sig", F.lit(0), lambda n, w: n + F.bit_count(w["bits"])).alias("n"), "score", (F.col("n_queries") * F.col("n_cases")).alias("pairs"))
    assert {(r["n"], r["score"]): r["pairs"] for r in listed.groupBy("n", "score").agg(F.sum("pairs").alias("pairs")).collect()} == want


def test_equal_numbers_of_different_tags_are_seen(spark, monkeypatch):
    by = skewed(3, 60)
    cases = frame(spark, by)
    real = sets._number
    monkeypatch.setattr(sets, "_number", lambda tag, seed: F.pmod(real(tag, seed), F.lit(50)) if seed < 2 else real(tag, seed))
    numbers, seed = numbered_by_hash(cases)
    assert seed == 2 and numbers.count() == len(set().union(*by.values()))
    assert {(r["query_id"], r["case_id"], r["rank"], r["score"]) for r in SearchIndex.by_hash(cases).search(frame(spark, by, "query_id")).collect()} == ranks(by, by, 6)


def test_many_copies_of_a_set_are_one_row_of_a_block(spark, small_blocks):
    draw = random.Random(4)
    by = {i: {"a", "b", "c"} if i % 4 else {f"t{draw.randrange(90)}", "a"} for i in range(2000)} | {5000 + i: {f"t{i}"} for i in range(90)}
    cases = frame(spark, by).repartition(7)
    own = TagSets.by_hash(cases, "case_id", numbered_by_hash(cases)[1])
    table = own.blocks().table
    assert table.select(F.sum(F.length("sigs") / 8)).first()[0] == own.table.count() == len({frozenset(t) for t in by.values()})
    assert own.members.count() == len(by) and own.table.agg(F.sum("n")).first()[0] == len(by)
    assert {r["case_id"] for r in search(frame(spark, {1: {"b"}}, "query_id"), cases, Vocabulary.of(build_vocab(cases)), 6).collect()} == {1, 2, 3, 5, 6, 7}


def test_empty_sides(spark):
    cases, none = frame(spark, skewed(6, 30)), frame(spark, skewed(6, 30)).limit(0)
    known = Vocabulary.of(build_vocab(frame(spark, {i: {f"t{i}"} for i in range(100)})))
    queries = cases.withColumnRenamed("case_id", "query_id")
    assert SearchIndex.by_hash(none).search(queries).count() == SearchIndex.by_hash(cases).search(queries.limit(0)).count() == 0
    assert search(queries, none, known).count() == corpus_related(none, known).count() == signature_edges(none, known).count() == score_counts(queries, none, known).count() == 0
