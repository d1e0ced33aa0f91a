"""The workloads put together: texts in, ranked results and relation tables out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsim.functions.rules import infer_tags
from tagsim.operators.relations import graph_edges, graph_nodes, related
from tagsim.operators.search import SearchIndex, signed
from tagsim.operators.vocab import Vocabulary
from tagsim.sources.tables import written


@dataclass
class Corpus:
    """A corpus with its tags: `tagged` is (case_id, tags), a table in the shared folder, as every step reads it and texts are read once. Its search
    indexes are made once, when they are first asked for."""

    cases: DataFrame
    tagged: DataFrame
    vocab: Vocabulary
    indexes: dict[int, SearchIndex] = field(default_factory=dict)

    @classmethod
    def of(cls, cases: DataFrame) -> Corpus:
        """cases: with tags."""
        tagged = written(cases.select("case_id", "tags"), "tagged_cases")
        return cls(cases, tagged, Vocabulary.of_cases(tagged))

    @classmethod
    def from_texts(cls, cases: DataFrame, rules: DataFrame, text_col: str = "problem") -> Corpus:
        """Tags by the same rules as queries, for a corpus without hand-given tags."""
        return cls.of(infer_tags(cases.drop("tags"), rules, text_col))

    def index(self, k: int = 6) -> SearchIndex:
        if k not in self.indexes:
            self.indexes[k] = SearchIndex.of(self.tagged, self.vocab, k)
        return self.indexes[k]

    def masks(self) -> DataFrame:
        """case_id, mask: a number, or, of a vocabulary of over 63 tags, several words."""
        return signed(self.tagged, self.vocab).select("case_id", F.col("sig").alias("mask"))


def ranked_search(queries: DataFrame, corpus: Corpus, rules: DataFrame, k: int = 6) -> DataFrame:
    """queries: query_id, text. query_id, case_id, score, rank, pct."""
    return corpus.index(k).search(infer_tags(queries, rules))


def related_in_lists(queries: DataFrame, corpus: Corpus, rules: DataFrame, k: int = 6, n: int = 3) -> DataFrame:
    return related(ranked_search(queries, corpus, rules, k), corpus.masks(), n)


def relation_graph(queries: DataFrame, corpus: Corpus, rules: DataFrame, k: int = 6, threshold: float = 0.35) -> tuple[DataFrame, DataFrame]:
    ranked = written(ranked_search(queries, corpus, rules, k), "ranked")
    return graph_nodes(ranked, corpus.cases), graph_edges(ranked, corpus.masks(), threshold)
