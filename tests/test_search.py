"""The golden corpus: eleven invented cases, two of them alike, whose tags are codes in the order in which the corpus shows them first."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tagsim.functions import rules as rules_module
from tagsim.functions.rules import infer_tags
from tagsim.functions.similarity import cosine, mask_cosine, match_pct
from tagsim.operators import search as search_module
from tagsim.operators.corpus import corpus_related, signature_edges
from tagsim.operators.dense import embedding_top_k
from tagsim.operators.relations import graph_edges, graph_nodes, pair_edges, related
from tagsim.operators.search import case_detail, has_results, no_results, score, search, signed, untagged_queries, with_details, with_query_tags
from tagsim.operators.sets import overlap_scores
from tagsim.operators.vocab import build_vocab, explode_tags, in_vocab, multi_hot, tag_mask, vocab_list
from tagsim.plans.workloads import Corpus, ranked_search
from tagsim.sources.tables import CASES, read_cases, read_queries, read_query_stream, tag_rules, write_graph, write_ranked
from tagsim.streaming.stream import rank_stream

GOLDEN = {1: "1 2 3 4", 2: "5 6 7 2", 3: "8 9", 4: "5 6 10 11 12", 5: "13 7 14 6", 6: "1 3 15", 7: "16", 8: "5 12 17 8", 9: "14 13 18 6 7", 10: "10 12 5 19", 11: "1 2 3 4"}
#: Queries: tags of two, three and three codes; none.
ASKED = ("1 3", "5 6 12", "7 13 6", "")


def tags(codes: str) -> list[str]:
    return [f"t{int(c):02d}" for c in codes.split()]


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(i, f"title of case {i}", "field", f"problem {i}", None, None, tags(t)) for i, t in GOLDEN.items()]
    return spark.createDataFrame(rows, CASES)


@pytest.fixture(scope="module")
def vocab(cases):
    return vocab_list(build_vocab(cases))


def asked(spark, *queries: str):
    return spark.createDataFrame([(i, tags(q)) for i, q in enumerate(queries)], "query_id long, tags array<string>")


def test_vocabulary_is_in_first_seen_order(vocab):
    assert vocab == [f"t{i:02d}" for i in range(1, 20)]


@pytest.mark.parametrize("wide", [False, True])
def test_rankings(spark, cases, vocab, wide):
    vocab = vocab + [f"x{i}" for i in range(40)] * wide  # over 63 tags: arrays and the join on tags
    got = search(asked(spark, *ASKED), cases, vocab).orderBy("query_id", "rank").collect()
    found = [[(r["case_id"], r["score"], r["pct"]) for r in got if r["query_id"] == q] for q in range(4)]
    assert found[0] == [(6, 0.8164965809277259, 82), (1, 0.7071067811865475, 71), (11, 0.7071067811865475, 71)]
    assert found[1] == [(4, 0.7745966692414834, 77), (2, 0.5773502691896258, 58), (8, 0.5773502691896258, 58), (10, 0.5773502691896258, 58), (5, 0.2886751345948129, 29), (9, 0.2581988897471611, 26)]
    assert found[2] == [(5, 0.8660254037844387, 87), (9, 0.7745966692414834, 77), (2, 0.5773502691896258, 58), (4, 0.2581988897471611, 26)]
    assert found[3] == []


def test_result_does_not_depend_on_partitioning(spark, cases, vocab):
    q = asked(spark, *ASKED[:3])
    plain = search(q, cases, vocab, 3).orderBy("query_id", "rank").collect()
    assert plain == search(q.repartition(5), cases.orderBy(F.desc("case_id")).repartition(7), vocab, 3).orderBy("query_id", "rank").collect()


def test_beyond_the_bound_signatures_join_on_tags(spark, cases, vocab, monkeypatch):
    q = asked(spark, *ASKED[:3])
    plain = sorted(map(tuple, search(q, cases, vocab).collect()))
    monkeypatch.setattr(search_module, "MAX_PAIRS", 0)
    assert plain == sorted(map(tuple, search(q, cases, vocab).collect()))


@pytest.mark.parametrize("wide", [False, True])
def test_related_and_edges_break_ties_by_rank(spark, cases, vocab, wide):
    vocab = vocab + [f"x{i}" for i in range(60)] * wide  # over 63 tags: arrays instead of numbers
    ranked = search(asked(spark, *ASKED[:3]), cases, vocab)
    masks = signed(cases, vocab).select("case_id", F.col("sig").alias("mask"))
    rel = related(ranked, masks).orderBy("query_id", "case_id", "pos").collect()

    def of(q, c):
        return [r["related_id"] for r in rel if (r["query_id"], r["case_id"]) == (q, c)]

    # cases 8 and 2 are alike to 4, and their order is that of the list; 1 and 11 are alike to 6
    assert (of(0, 6), of(0, 2), of(1, 4), of(1, 2), of(1, 5), of(2, 9), of(2, 4)) == ([1, 11], [], [10, 2, 8], [5, 4, 9], [9, 2, 4], [5, 2, 4], [2, 5, 9])
    edges = {(r["query_id"], r["src"], r["dst"]) for r in pair_edges(ranked, masks).collect()}
    assert edges == {(0, 6, 1), (0, 6, 11), (0, 1, 11), (1, 4, 2), (1, 4, 8), (1, 4, 10), (1, 2, 5), (1, 2, 9), (1, 8, 10), (1, 5, 9), (2, 5, 9), (2, 5, 2), (2, 9, 2), (2, 2, 4)}
    assert graph_edges(ranked, masks).filter("kind = 'star'").count() == ranked.count()
    assert {r["label"] for r in graph_nodes(ranked, cases).collect()} == {"title of ca…"}


def test_details_and_flags(spark, cases, vocab):
    q = asked(spark, "1 3", "")
    ranked = search(q, cases, vocab)
    assert {r["summary"] for r in with_details(ranked, cases).collect()} == {"field・problem 1", "field・problem 6", "field・problem 11"}
    assert case_detail(ranked, cases, 0, 6).count() == 1
    beside = [(r["query_id"], r["tags"], r["case_id"]) for r in with_query_tags(ranked, q).orderBy("query_id", "rank").collect()]
    assert beside == [(0, tags("1 3"), 6), (0, tags("1 3"), 1), (0, tags("1 3"), 11), (1, [], None)]
    assert {r["query_id"]: r["has_results"] for r in has_results(q, ranked).collect()} == {0: True, 1: False}
    assert [r["query_id"] for r in no_results(q, ranked).collect()] == [r["query_id"] for r in untagged_queries(q).collect()] == [1]


@pytest.mark.parametrize("most", [500, 0])
def test_rules(spark, monkeypatch, most):
    monkeypatch.setattr(rules_module, "MAX_KEYWORDS", most)  # compiled into the plan, or one automaton
    rules = {"a": ["ui", "a.c"], "b": ["UI", "50%_["], "c": ["ui", "zz"], "d": ["long phrase"], "e": ["phrase"]}
    texts = ["UI", "qui", "abc", "a.c", "50%_[", "ZZ ui zz", "a LONG phrase", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = tag_rules(spark, rules)
    forms = [table, tag_rules(spark, table), tag_rules(spark, table.groupBy("tag", "pos").agg(F.collect_list("keyword").alias("keywords"))), tag_rules(spark, spark.createDataFrame([(rules,)], "rules map<string, array<string>>"))]
    for form in forms:
        got = infer_tags(df, form).orderBy("id").collect()
        assert [r["tags"] for r in got] == [["a", "c"], ["a", "c"], [], ["a"], ["b"], ["a", "c"], ["d", "e"], [], []]
    assert [r["tags"] for r in infer_tags(df, tag_rules(spark, {"all": [""], "none": []})).collect()] == [["all"]] * 9


def test_vectors(spark, cases, vocab):
    df = spark.createDataFrame([(1, ["t02", "t01", "t02", "other"]), (2, None)], "case_id long, tags array<string>")
    hot = multi_hot(df, vocab).orderBy("case_id").collect()
    assert [sum(r["vector"]) for r in hot] == [2, 0] and hot[0]["vector"][:2] == [1, 1]
    assert [r["mask"] for r in tag_mask(df, vocab).orderBy("case_id").collect()] == [3, 0]
    assert [r["tags"] for r in in_vocab(df, vocab).orderBy("case_id").collect()] == [["t01", "t02"], []]
    assert explode_tags(df, "case_id").count() == 3
    with pytest.raises(ValueError):
        tag_mask(df, [str(i) for i in range(64)])


def test_a_query_tag_that_no_case_has_does_not_lower_the_score(spark, cases, vocab):
    q = spark.createDataFrame([(0, ["t03"]), (1, ["t03", "nowhere"]), (2, ["nowhere"])], "query_id long, tags array<string>")
    got = {(r["query_id"], r["case_id"]): r["score"] for r in search(q, cases, vocab).collect()}
    assert got[(0, 1)] == got[(1, 1)] and not any(k[0] == 2 for k in got)


@pytest.mark.parametrize("na,nb,shared,expected", [(6, 6, 6, 1.0000000000000002), (20, 20, 7, 0.3499999999999999), (4, 4, 2, 0.5), (2, 2, 1, 0.4999999999999999), (3, 0, 0, 0.0)])
def test_three_forms_agree_bit_for_bit(spark, na, nb, shared, expected):
    a, b = list(range(na)), list(range(na - shared, na - shared + nb))
    df = spark.createDataFrame([(sum(1 << i for i in a), sum(1 << i for i in b), [int(i in a) for i in range(40)], [int(i in b) for i in range(40)])], "a long, b long, x array<int>, y array<int>")
    r = df.select(mask_cosine(F.col("a"), F.col("b")).alias("m"), cosine(F.col("x"), F.col("y")).alias("c"), match_pct(F.lit(expected)).alias("p")).first()
    assert r["m"] == r["c"] == expected and r["p"] == math.floor(expected * 100 + 0.5)
    if shared:
        q = spark.createDataFrame([(0, str(i)) for i in a], "query_id long, tag string")
        c = spark.createDataFrame([(0, str(i)) for i in b], "case_id long, tag string")
        assert overlap_scores(q, c).first()["score"] == expected


def test_more_than_six_cases_are_cut_by_id(spark):
    many = spark.createDataFrame([(i, ["a"]) for i in range(20, 0, -1)], "case_id long, tags array<string>")
    q = spark.createDataFrame([(1, ["a"])], "query_id long, tags array<string>")
    assert [r["case_id"] for r in search(q, many, ["a"]).orderBy("rank").collect()] == [1, 2, 3, 4, 5, 6]


def test_corpus_relations(spark, cases, vocab):
    got = corpus_related(cases, vocab).orderBy("case_id", "pos").collect()
    near = {c: [r["related_id"] for r in got if r["case_id"] == c] for c in GOLDEN}
    assert near[2] == [5, 4, 9] and near[1] == [11, 6, 2] and near[3] == [8] and near[7] == []
    for known in (vocab, vocab + [f"x{i}" for i in range(60)]):
        edges = signature_edges(cases, known)
        assert edges.filter("mask_a = mask_b").count() == 10 and edges.filter("mask_a < mask_b").count() == 9
    found = score(cases.select(F.col("case_id").alias("query_id"), "tags"), cases, vocab)
    assert found.filter("q_sig = c_sig").agg(F.sum("n_cases")).first()[0] == 11


def test_dense(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0]), (5, None), (6, [1.0])], "vec_id long, embedding array<double>")
    got = embedding_top_k(v.filter("vec_id = 0"), v).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(0, 1.0), (1, 1.0), (4, 0.707107)]


def test_sources_sinks_and_stream(spark, cases, tmp_path):
    cases.write.parquet(str(tmp_path / "cases"))
    read = read_cases(spark, str(tmp_path / "cases"))
    rules = tag_rules(spark, {t: [f"<{t}>"] for t in tags("1 3 5 6 12")})
    texts = ["<t01><T03>", "<t05> <t06> <t12>", "none", None]
    for part in range(2):  # two files
        spark.createDataFrame([(10 * part + i, t) for i, t in enumerate(texts)], "query_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "queries"))
    corpus = Corpus.of(read)
    batch = ranked_search(read_queries(spark, str(tmp_path / "queries")), corpus, rules)
    write_ranked(batch, str(tmp_path / "ranked"))
    rank_stream(read_query_stream(spark, str(tmp_path / "queries")), corpus, rules, str(tmp_path / "stream"), str(tmp_path / "state")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "stream")).drop("batch")
    (tmp_path / "nothing").mkdir()
    rank_stream(read_query_stream(spark, str(tmp_path / "nothing")), corpus, rules, str(tmp_path / "none"), str(tmp_path / "state2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, spark.read.parquet(str(tmp_path / "ranked")).collect())) and streamed.count() == 18
    write_graph(graph_nodes(batch, corpus.cases), graph_edges(batch, corpus.masks()), str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph/nodes")).count() == 18


def test_empty_tables(spark, cases, vocab):
    assert search(asked(spark, "1").limit(0), cases, vocab).count() == 0
    none = cases.limit(0)
    assert vocab_list(build_vocab(none)) == [] and corpus_related(none, vocab).count() == 0
