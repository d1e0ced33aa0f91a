"""Spelling variant grouping: words that differ by one inserted, deleted or replaced code point, found by rotations in sorted order.

A word with an end mark has a rotation for each of its places. Write a word as x c y, with c the code point at some place: the rotation that
ends in c is `y mark x c`. Words that differ from it only by a replacement of c are the rotations with the prefix `y mark x`, and the word
without c is the rotation that is just `y mark x`. So the rotations, sorted by the prefix that skips the edited code point, lie in
groups, and a word's near words are those of its groups. A group holds each code point once at most and one shorter word: it is as small as the
alphabet, whatever the number of words. A pair of words that differ by a replacement shares one group; of the groups of an insertion in a run of
equal code points the first of the run counts.

Groups are ranges of the sorted table, cut between prefixes. A scan holds one group at a time and hands each word the number of its near words there
and the best of them, which is the group's best or, for that one itself, the second best; pairs are never listed."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsim.llm.common import LOWER, UPPER, documents, emptied, stored

#: A run of letters; the divisor of the hashes of runs that lose a code point.
RUN = "[A-Za-zÀ-ÿ]+"
TYPO = 97
MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
#: Ends a word in its rotations; no run holds it.
MARK = "\x00"
#: Different words whose counts a task holds before it hands them on, and code points of text that it cuts into runs at once.
HELD, PIECE = 100_000, 1 << 20
#: Code points of a long prefix that are kept before its hash.
KEPT = 64


def typed_words(doc_id: int | None, text: str | None, runs: re.Pattern, typo: int = TYPO) -> Counter:
    """The words of one document with their counts: its runs in lower case (A-Z only), without a code point where the hash says so. A
    null id is an empty string in the hash."""
    found: Counter = Counter()
    lowered, own = (text or "").translate(LOWERED), "" if doc_id is None else str(doc_id)
    seen: Counter = Counter()
    for low, high in _pieces(lowered, runs):
        seen.update(runs.findall(lowered, low, high))
    for run, n in seen.items():
        h = zlib.crc32(f"{own}:{run}".encode("utf-8", "surrogatepass"))
        if typo and h % typo == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
        found[run] += n
    return found


LOWERED = str.maketrans(UPPER, LOWER)


def _pieces(text: str, runs: re.Pattern) -> Iterator[tuple[int, int]]:
    """Stretches of a text that cut no run, so that the list of a stretch's runs stays small."""
    low = 0
    while low < len(text):
        high = min(low + PIECE, len(text))
        if high < len(text) and runs.match(text[high - 1]) and (rest := runs.match(text, high)):
            high = rest.end()
        yield low, high
        low = high


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, typo: int = TYPO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, for each different word of at least min_chars code points and min_count occurrences in all texts. Tasks count before they
    shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, total = re.compile(RUN), Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                for word, n in typed_words(doc_id.as_py(), text.as_py(), runs, typo).items():
                    if len(word) >= min_chars:
                        total[word] += n
                if len(total) >= HELD:
                    yield told()
                    total = Counter()
        if total:
            yield told()

    parts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _keyed(prefix: Column) -> Column:
    """A prefix as it is, or, of a long one, its beginning and 128 bits of hash, so that what is sorted does not grow with the square of a
    word's length."""
    cut = F.concat(F.substring(prefix, 1, KEPT), F.hex(F.xxhash64(prefix)), F.hex(F.xxhash64(F.lit(1), prefix)))
    return F.when(F.length(prefix) > KEPT + 32, cut).otherwise(prefix)


def rotations(words: DataFrame) -> DataFrame:
    """words: uid, word, n. prefix, last, first, uid, n for each rotation of each word with its end mark: as the prefix that skips its last code
    point, and that code point; and once more whole, with an empty `last`, where the words lie that have one code point more. first: the
    code point does not repeat the one before it in the word."""
    def turned(i: Column, last: str, first: str) -> Column:
        return F.struct(F.concat(F.expr("substring(word, i + 1)"), F.lit(MARK), F.substring("word", F.lit(1), i)).alias("prefix"), F.expr(last).alias("last"), F.expr(first).alias("first"))

    skipping = words.select("uid", "word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    skipping = skipping.select(turned(F.col("i") - 1, "substring(word, i, 1)", "i = 1 OR substring(word, i, 1) <> substring(word, i - 1, 1)").alias("r"), "uid", "n")
    whole = words.select("uid", "word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i")).select(turned(F.col("i"), "''", "true").alias("r"), "uid", "n")
    return skipping.unionByName(whole).select(_keyed(F.col("r.prefix")).alias("prefix"), "r.last", "r.first", "uid", "n")


def _group_near(group: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
    """uid, n_near, n and uid of the best, for the members that have near words in a group: one whole rotation at most, and words that have
    another code point each in the place that is skipped."""
    longer = [(-n, uid, first) for _, last, first, uid, n in group if last]
    whole = [(-n, uid) for _, last, _, uid, n in group if not last]
    best = sorted(m[:2] for m in longer)[:2]
    for _, uid, first in longer:
        others = [b for b in best if b[1] != uid][:1] + (whole if first else [])
        if others:
            top = min(others)
            yield uid, len(longer) - 1 + (len(whole) if first else 0), -top[0], top[1]
    inserted = [m[:2] for m in longer if m[2]]
    for _, uid in whole if inserted else ():
        top = min(inserted)
        yield uid, len(inserted), -top[0], top[1]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a range of sorted rotations, prefix by prefix."""
    group: list[tuple] = []
    for batch in batches:
        found: list[tuple[int, int, int, int]] = []
        for row in zip(*[batch.column(c).to_pylist() for c in ("prefix", "last", "first", "uid", "n")], strict=True):
            if group and group[0][0] != row[0]:
                found.extend(_group_near(group))
                group = []
            group.append(row)
        yield _told(found)
    yield _told(list(_group_near(group)))


def _told(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["uid", "n_near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """words: uid, word, n, with uids in the words' order. uid, n_near, best, best_n for each word that has near words; best is the uid of the one
    of largest n, ties to the smallest."""
    ranged = rotations(words).repartitionByRange("prefix").sortWithinPartitions("prefix", "last")
    found = ranged.mapInArrow(_scan, "uid long, n_near long, best_n long, best long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    return found.groupBy("uid").agg(F.sum("n_near").alias("n_near"), best).select("uid", "n_near", "b.best", (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """forms: uid, form (not null). uid, root: the last that forms lead to. Each round doubles the steps that are taken, so there are as many as the
    logarithm of the longest chain, which itself is short, as counts grow along it."""
    now = stored(forms.select("uid", F.col("form").alias("root")), "spelling_roots")
    while True:
        onward = now.select(F.col("uid").alias("root"), F.col("root").alias("next"))
        after = stored(now.join(onward, "root", "left").select("uid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling_roots")
        emptied(now)
        if after.filter("moved").limit(1).count() == 0:
            return after.select("uid", "root")
        now = after


def spelling_groups(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, typo: int = TYPO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for each different word.

    Words are maximal runs of letters of the whole texts, A-Z lower-cased; with typo (0 for none) the runs whose hash it divides lose a code
    point. form: the near word of largest n, ties to the smallest, if it occurs `ratio` times as often (2 or more, so that forms lead
    to an end), else null. root: the last form. Null texts and texts without letters have no words; a null id is an empty string. Rows
    that repeat count each. An empty table gives an empty table. Other columns aren't read."""
    if ratio < 2 or min_chars < 1:
        raise ValueError("a form occurs at least twice as often as its word, and a word has a code point at least")
    counted = word_counts(docs, min_chars, min_count, typo, id_col, text_col)
    # numbers ascend with the ranges and inside them, so their order is that of the words
    words = counted.repartitionByRange("word").sortWithinPartitions("word").select(F.monotonically_increasing_id().alias("uid"), "word", "n")
    words = stored(words, "spelling_words")
    near = near_words(words)
    fits = F.col("best_n") >= ratio * F.col("n")
    own = words.join(near, "uid", "left").select("uid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best")).alias("form_uid"), F.when(fits, F.col("best_n")).alias("form_n"))
    own = stored(own, "spelling_forms")
    last = roots(own.filter(F.col("form_uid").isNotNull()).select("uid", F.col("form_uid").alias("form")))
    named = own.join(last, "uid", "left")
    for column, uid in (("form", "form_uid"), ("last", "root")):
        named = named.join(words.select(F.col("uid").alias(uid), F.col("word").alias(column)), uid, "left")
    return named.select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(documents(spark, sf_dir))


#: crc32 by its table, a code point of one or two bytes at a time; near words by keys with the edited place left out.
OP12_SQL = r"""
WITH RECURSIVE t(k, i, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT k, i + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM t WHERE i < 8),
crc AS (SELECT list(v ORDER BY k) AS c FROM t WHERE i = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
b AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END)) AS bytes FROM per),
h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, x: xor(s // 256, c[1 + xor(s % 256, x)])), 4294967295) AS h FROM b, crc),
typed AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
k AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || '?' || substr(word, i + 1) AS gap, left(word, i - 1) || substr(word, i + 1) AS without FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM k a JOIN k b ON a.gap = b.gap AND a.word <> b.word
  UNION SELECT k.word, w.word, w.n FROM k JOIN w ON k.without = w.word
  UNION SELECT w.word, k.word, k.n FROM k JOIN w ON k.without = w.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
top AS (SELECT best.word, best.n_near, best.m, min(other) AS other FROM best JOIN near ON best.word = near.word AND best.m = near.m GROUP BY ALL),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(top.n_near, 0)::BIGINT AS n_near, CASE WHEN top.m >= 2 * w.n THEN top.other END AS form, CASE WHEN top.m >= 2 * w.n THEN top.m END AS form_n FROM w LEFT JOIN top ON w.word = top.word),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n::BIGINT AS form_n
FROM f JOIN walk ON f.word = walk.word JOIN f AS e ON walk.at = e.word AND e.form IS NULL
"""
