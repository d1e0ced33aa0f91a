"""Ranked search of many queries over many cases.

Cases with equal tag sets have equal scores for every query, and ties go to the smaller id. So the search runs over different tag sets
(signatures): each keeps its k smallest ids, different query signatures meet different case signatures, and only the top k of a query
signature is given out to its queries. No step pairs rows with rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagsim.functions.similarity import mask_cosine, match_pct, ratio
from tagsim.operators.blocks import SetBlocks, all_pairs, best_pairs, pair_counts
from tagsim.operators.sets import TagSets, numbered_by_hash, overlap_scores
from tagsim.operators.vocab import MASK_BITS, MAX_BROADCAST, Vocabulary, tag_mask, tag_words
from tagsim.sources.tables import written

#: Signature pairs that a nested-loop join may look at, with the smaller side's rows broadcast at most. Beyond it, the join on tags.
MAX_PAIRS = 200_000_000


def signed(df: DataFrame, vocab: list[str] | Vocabulary, tags_col: str = "tags", id_col: str | None = None) -> DataFrame:
    """df with column sig: a bit mask, or, of a vocabulary of over 63 tags, a mask of several words. Those are made by id_col, which names each row once; it
    is case_id or else query_id."""
    vocab = Vocabulary.listed(df.sparkSession, vocab)
    if vocab.tags is not None:
        return tag_mask(df, vocab.tags, tags_col, "sig")
    id_col = id_col or ("case_id" if "case_id" in df.columns else "query_id")
    words = tag_words(df, vocab, id_col, tags_col, "sig")
    return df.join(words, id_col, "left").withColumn("sig", F.coalesce("sig", F.array().cast("array<struct<word: int, bits: bigint>>")))


def signature_scores(queries: DataFrame, cases: DataFrame, n_tags: int = MASK_BITS) -> DataFrame:
    """queries, cases: sig, a mask of one number, each once, not 0; of tables that may be read twice. q_sig, c_sig, score of all that share a tag."""
    q, c = queries.select(F.col("sig").alias("q_sig")), cases.select(F.col("sig").alias("c_sig"))
    nq, nc = q.count(), c.count()
    if nq * nc <= MAX_PAIRS and min(nq, nc) <= MAX_BROADCAST:
        # the smaller side has been counted, so it may be sent to every executor
        left, right = (F.broadcast(q), c) if nq <= nc else (q, F.broadcast(c))
        return left.join(right, F.col("q_sig").bitwiseAND(F.col("c_sig")) != 0).select("q_sig", "c_sig", mask_cosine(F.col("q_sig"), F.col("c_sig")).alias("score"))
    tags = F.array(*[F.when(F.getbit("sig", F.lit(i)) == 1, F.lit(i)) for i in range(n_tags)])
    q_long = queries.select(F.col("sig").alias("q_sig"), F.explode(tags).alias("tag")).filter("tag IS NOT NULL")
    c_long = cases.select(F.col("sig").alias("c_sig"), F.explode(tags).alias("tag")).filter("tag IS NOT NULL")
    return overlap_scores(q_long, c_long, "q_sig", "c_sig")


def smallest_ids(cases: DataFrame, k: int, id_col: str = "case_id") -> DataFrame:
    """cases: case_id, sig. The k smallest ids of each signature; each task cuts its own before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("sig").orderBy(id_col))
    return cases.select(id_col, "sig").withColumn("__n", rank).filter(F.col("__n") <= k).drop("__n")


def rank_cases(scored: DataFrame, by: str = "query_id") -> DataFrame:
    """Best score first, ties to the smaller case_id."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "case_id")))


def top_k(scored: DataFrame, k: int = 6, by: str = "query_id") -> DataFrame:
    return rank_cases(scored.filter("score > 0"), by).filter(F.col("rank") <= k)


def score(queries: DataFrame, cases: DataFrame, vocab: list[str] | Vocabulary) -> DataFrame:
    """queries: query_id, tags; cases: case_id, tags. Scores by signature: q_sig, c_sig (masks), score, n_queries, n_cases."""
    vocab = Vocabulary.listed(cases.sparkSession, vocab)
    if vocab.tags is None:
        q, c = TagSets.of(queries, vocab, "query_id"), TagSets.of(cases, vocab, "case_id")
        found = all_pairs(q.blocks(), c.blocks())
        for side, end, key, n in ((q, "a_sig", "q_sig", "n_queries"), (c, "b_sig", "c_sig", "n_cases")):
            own = side.table.select(F.col("sig").alias(end), F.col("mask").alias(key), F.col("n").alias(n))
            found = found.join(F.broadcast(own) if own.count() <= MAX_BROADCAST else own, end)
        return found.select("q_sig", "c_sig", "score", "n_queries", "n_cases")
    # small tables, written once: they are counted, compared and joined below, and the texts behind them are read for none of that
    q = written(signed(queries, vocab).filter("sig <> 0").groupBy("sig").agg(F.count(F.lit(1)).alias("n_queries")), "query_signatures")
    c = written(signed(cases, vocab).filter("sig <> 0").groupBy("sig").agg(F.count(F.lit(1)).alias("n_cases")), "case_signatures")
    found = signature_scores(q, c, vocab.size)
    return found.join(q.withColumnRenamed("sig", "q_sig"), "q_sig").join(c.withColumnRenamed("sig", "c_sig"), "c_sig")


def score_counts(queries: DataFrame, cases: DataFrame, vocab: list[str] | Vocabulary) -> DataFrame:
    """queries: query_id, tags; cases: case_id, tags. n_tags (known tags of a query), score, n_pairs: how many pairs of a query and a case that share a tag have a score. Counted
    where blocks of sets meet: no pair is listed."""
    vocab = Vocabulary.listed(cases.sparkSession, vocab)
    found = pair_counts(TagSets.of(queries, vocab, "query_id").blocks(), TagSets.of(cases, vocab, "case_id").blocks())
    found = found.select(F.col("a_size").cast("int").alias("n_tags"), ratio(F.col("shared"), F.col("a_size"), F.col("b_size")).alias("score"), "n")
    return found.groupBy("n_tags", "score").agg(F.sum("n").alias("n_pairs"))


@dataclass
class SearchIndex:
    """What a search needs of a corpus, as tables in the shared folder, made once: kept (case_id, sig), each signature's k smallest ids; sets (sig), each
    signature once. Of a vocabulary of over 63 tags, signatures are numbers, sets have (n, size, mask) too, and the sets are there as blocks of postings. An index by hash has no
    vocabulary, but the tags' numbers (tag, check) with their frequencies (rows), and their seed."""

    vocab: Vocabulary | None
    k: int
    kept: DataFrame
    sets: DataFrame
    postings: SetBlocks | None = None
    frequencies: DataFrame | None = None
    seed: int = 0

    @classmethod
    def of(cls, cases: DataFrame, vocab: list[str] | Vocabulary, k: int = 6) -> SearchIndex:
        """cases: case_id, tags. For searches of up to k results."""
        vocab = Vocabulary.listed(cases.sparkSession, vocab)
        if vocab.tags is not None:
            kept = written(smallest_ids(signed(cases, vocab).filter("sig <> 0"), k), "search_index")
            return cls(vocab, k, kept, kept.select("sig").distinct())
        return cls.of_sets(TagSets.of(cases, vocab, "case_id"), vocab, k)

    @classmethod
    def of_sets(cls, sets: TagSets, vocab: Vocabulary, k: int) -> SearchIndex:
        kept = written(smallest_ids(sets.members, k, sets.id_col), "search_index")
        return cls(vocab, k, kept, sets.table, sets.blocks())

    @classmethod
    def by_hash(cls, cases: DataFrame, k: int = 6) -> SearchIndex:
        """cases: case_id, tags. For tags that grow with the corpus, all of which are known: no vocabulary is made of them."""
        numbers, seed = numbered_by_hash(cases)
        sets = TagSets.by_hash(cases, "case_id", seed)
        kept = written(smallest_ids(sets.members, k, sets.id_col), "search_index")
        return cls(None, k, kept, sets.table, sets.blocks(), numbers, seed)

    def best(self, queries: TagSets, k: int) -> DataFrame:
        """q_sig, c_sig, score: pairs among which are all that can enter a query's k best. For vocabularies of over 63 tags."""
        pairs = written(best_pairs(queries.blocks(), self.postings, k), "search_candidates")
        return pairs.select(F.col("a_sig").alias("q_sig"), F.col("b_sig").alias("c_sig"), "score")

    def search(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """queries: query_id, tags. query_id, case_id, score, rank, pct of each query's k best cases; k is the index's own, or smaller."""
        k = k or self.k
        if k > self.k:
            raise ValueError(f"the index holds {self.k} cases of a signature")
        if self.vocab is not None and self.vocab.tags is not None:
            # written once: it is counted and joined below
            q = written(signed(queries, self.vocab).filter("sig <> 0").select("query_id", "sig"), "query_signatures")
            found = signature_scores(q.select("sig").distinct(), self.sets, self.vocab.size)
        else:
            sets = TagSets.known_by_hash(queries, self.frequencies, "query_id", self.seed) if self.vocab is None else TagSets.of(queries, self.vocab, "query_id")
            q, found = sets.members, self.best(sets, k)
        listed = found.join(self.kept.withColumnRenamed("sig", "c_sig"), "c_sig").select("q_sig", "case_id", "score")
        best = top_k(listed, k, "q_sig").withColumnRenamed("q_sig", "sig")
        return q.join(best, "sig").select("query_id", "case_id", "score", "rank", match_pct(F.col("score")).alias("pct"))


def search(queries: DataFrame, cases: DataFrame, vocab: list[str] | Vocabulary, k: int = 6) -> DataFrame:
    """queries: query_id, tags; cases: case_id, tags. query_id, case_id, score, rank, pct of each query's k best cases."""
    return SearchIndex.of(cases, vocab, k).search(queries)


def of_listed(ranked: DataFrame, table: DataFrame) -> DataFrame:
    """The rows of table (case_id, ...) whose case is ranked. The ids, counted, go to every executor as a filter, so that other rows are not shuffled; too many ids
    for that are joined as they are. ranked is read twice: give a table."""
    ids = ranked.select("case_id").distinct()
    return table.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids, "case_id", "left_semi")


def with_details(ranked: DataFrame, cases: DataFrame) -> DataFrame:
    """ranked with the cases' own fields; only the texts of ranked cases are joined."""
    ranked = written(ranked, "ranked")
    own = of_listed(ranked, cases.select(*[c for c in cases.columns if c != "tags"]))
    return ranked.join(own, "case_id").withColumn("summary", F.concat_ws("・", "industry", "problem"))


def with_query_tags(ranked: DataFrame, tagged: DataFrame) -> DataFrame:
    """tagged: query_id, tags. query_id, tags, case_id, score, rank: the tags that were read from a query beside each of its results, and
    once, with nulls, for a query without results."""
    return tagged.select("query_id", "tags").join(ranked.select("query_id", "case_id", "score", "rank"), "query_id", "left")


def case_detail(ranked: DataFrame, cases: DataFrame, query_id: int, case_id: int) -> DataFrame:
    return with_details(ranked.filter((F.col("query_id") == query_id) & (F.col("case_id") == case_id)), cases)


def untagged_queries(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.size(F.coalesce("tags", F.array().cast("array<string>"))) == 0)


def has_results(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    found = ranked.select("query_id").distinct().withColumn("found", F.lit(True))
    return queries.join(found, "query_id", "left").select("query_id", F.coalesce("found", F.lit(False)).alias("has_results"))


def no_results(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    return queries.join(ranked.select("query_id"), "query_id", "left_anti")
