"""Quality rules: counts of each text, and cross-document line frequency per host. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsim.llm.common import SPACE, count_words, documents, let, row_key, spare_name, split_words, stored
from tagsim.llm.lines import distinct_keys, drop_bitmaps, kept_text, key_hashes, line_key, n_dropped, split_lines
from tagsim.llm.text_groups import grouped_units, text_groups, text_unit

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host's line is above the limit in more than this share of the host's documents and of its different texts, and in this many
#: different texts at least: a line of fewer isn't shared.
MAX_SHARE = 0.02
MIN_TEXTS = 3
#: A document is depleted with less than this share of its words left.
MIN_LEFT = 0.5


def repeat_words(words: Column, size: int = WINDOW) -> Column:
    """Words covered by windows of `size` words that occur twice or more in the text. Hashes of windows, in 64 bits, are sorted with
    their places; a window counts if a neighbour has its hash. Time grows as n log n."""
    def windows(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)])))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])), lambda x: x["i"])))
        # F.get gives null outside the array, and null | true is true
        return let(twice, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - x, F.lit(size)))), F.lit(0).cast("long"), lambda a, n: a + n))

    none = F.lit(0).cast("long")
    return F.when(F.size(words) <= size, none).otherwise(let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h))))


def text_counts(text: Column) -> dict[str, Column]:
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(split_lines(text), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    return {
        "n_words": count_words(text),
        "word_chars": F.length(F.translate(body, SPACE, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": let(split_words(text), lambda w: repeat_words(w)),
    }


def counted(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: by, content. by, n_docs (rows), n_texts (different contents)."""
    return rows.groupBy(*by, "content").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_texts"))


def frequent_lines(own: DataFrame, max_share: float, min_texts: int, groups: DataFrame | None = None) -> DataFrame:
    """own: host, content, text. (host, h1, h2, n_docs) of lines that are in more documents of their host than its limit.

    Documents are counted, and so are their different contents, and both have to pass: one text that was fetched often does not turn its
    own lines into boilerplate. With groups (text_groups), near copies have one content."""
    def rows(df: DataFrame) -> DataFrame:
        return df if groups is None else grouped_units(df, groups, "content")

    lines = counted(rows(distinct_keys(own, ["host", "content"])), ["host", "h1", "h2"]).filter(F.col("n_texts") >= min_texts)
    hosts = counted(rows(own.select("host", "content")), ["host"]).select("host", (F.col("n_docs") * max_share).alias("most_docs"), (F.col("n_texts") * max_share).alias("most_texts"))
    return lines.join(hosts, "host").filter((F.col("n_docs") > F.col("most_docs")) & (F.col("n_texts") > F.col("most_texts"))).select("host", "h1", "h2", "n_docs")


def quality_rules(docs: DataFrame, max_share: float = MAX_SHARE, min_texts: int = MIN_TEXTS, min_left: float = MIN_LEFT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", near_once: bool = False) -> DataFrame:
    """doc_id, row_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left (words outside lines above
    the limit), kept, drops (bitmap of those lines; null if none), for each row of docs.

    Lines are compared without ASCII white space at their ends, A-Z in lower case, within a host; a null host is a host. A line is
    above the limit in more than max_share of its host's documents, and of its different texts, of which there are min_texts at
    least. A document is depleted if it lost words to such lines and has fewer than 10, or less than min_left of its words, left.
    Null and empty texts have no words and fail the base rules. With near_once, near copies (text_groups) count as one
    text, so that they don't make each other's lines frequent. Rows that repeat count as documents each and get the same
    verdict; a null id stays.
    An empty table gives an empty table. Other columns of docs aren't read."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.concat(F.lit("="), F.col(host_col)), F.lit("")).alias("host"))
    own = own.withColumns({"row_key": row_key(F.col("doc_id"), F.col("text"), F.col("host")), "content": text_unit(F.col("text")) if near_once else row_key(F.col("text"))})
    # as a table, its size is known, and a join with it can be split where a line is hot
    hot = stored(frequent_lines(own, max_share, min_texts, text_groups(own) if near_once else None), "frequent_lines")
    placed = own.select("row_key", "host", F.posexplode(F.transform(split_lines(F.col("text")), lambda x: F.struct(line_key(x).alias("key"), F.coalesce(F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("n")))).alias("pos", "line"))
    placed = placed.filter(F.length("line.key") > 0).select("row_key", "host", "pos", F.col("line.n").alias("n"), *key_hashes(F.col("line.key")))
    lost = placed.join(hot.drop("n_docs"), ["host", "h1", "h2"]).select("row_key", "pos", "n").distinct()
    words = lost.groupBy("row_key").agg(F.sum("n").alias("n_lost"))
    taken = drop_bitmaps(lost, "row_key").join(words, "row_key")
    judged = own.select("doc_id", "row_key", *[c.alias(k) for k, c in text_counts(F.col("text")).items()]).join(taken, "row_key", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("n_lost", F.lit(0))
    depleted = (left < F.col("n_words")) & ((left < MIN_WORDS) | (left < min_left * F.col("n_words")))
    return judged.withColumns({"base_failed": failed, "n_left": left, "kept": ~failed & ~depleted}).drop("n_lost")


def apply_rules(docs: DataFrame, rules: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that the rules keep, with the columns of docs, their text without the lines above the limits.

    Rows are found again by a key of id, text and host, nulls included, so rows that repeat are kept or dropped together. A null text
    is never kept (no words). Columns of docs may have any names. An empty table gives an empty table."""
    key, drops = spare_name(docs, "key"), spare_name(docs, "drops")
    kept = rules.filter("kept").select(F.col("row_key").alias(key), F.col("drops").alias(drops)).dropDuplicates([key])
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col)), F.lit(""))
    joined = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col), host)).join(kept, key)
    return joined.withColumn(text_col, F.when(F.col(drops).isNull(), F.col(text_col)).otherwise(kept_text(F.col(text_col), F.col(drops)))).select(*docs.columns)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality_rules(documents(spark, sf_dir))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left", n_dropped(F.col("drops")).alias("n_frequent_lines"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
l AS (
  SELECT doc_id, host, t, unnest(s) AS line, generate_subscripts(s, 1) AS pos FROM (SELECT *, string_split(t, chr(10)) AS s FROM d)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
  FROM l),
hosts AS (SELECT host, count(*) * 0.02::DOUBLE AS most_docs, count(DISTINCT t) * 0.02::DOUBLE AS most_texts FROM d GROUP BY host),
hot AS (
  SELECT c.host, c.key FROM (SELECT host, key, count(DISTINCT doc_id) AS n_docs, count(DISTINCT t) AS n_texts FROM k WHERE key <> '' GROUP BY host, key) c
  JOIN hosts USING (host) WHERE n_docs > most_docs AND n_texts > most_texts AND n_texts >= 3),
f AS (
  SELECT k.doc_id, coalesce(sum(n) FILTER (WHERE hot.key IS NOT NULL), 0) AS lost, count(hot.key) AS n_frequent_lines,
    (count(*) FILTER (WHERE n > 0)) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines
  FROM k LEFT JOIN hot ON k.host = hot.host AND k.key = hot.key GROUP BY k.doc_id),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT g.doc_id, unnest(range(g.i, g.i + 5)) AS j FROM g JOIN (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1) x ON g.doc_id = x.doc_id AND g.g = x.g),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM r GROUP BY doc_id),
a AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    f.n_dup_lines::BIGINT AS n_dup_lines, coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words,
    (len(w) - f.lost)::BIGINT AS n_left, f.n_frequent_lines::BIGINT AS n_frequent_lines
  FROM d JOIN f ON d.doc_id = f.doc_id LEFT JOIN c ON d.doc_id = c.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_left < n_words AND (n_left < 10 OR n_left < 0.5 * n_words)) AS kept, n_left, n_frequent_lines
FROM b
"""
