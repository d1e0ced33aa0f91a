"""Quality rules, URL filter and line dedup: against their SQL, and the cases that the tables lack."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tagsim.llm import queries
from tagsim.llm.line_dedup import apply_bitmaps, line_dedup
from tagsim.llm.quality_rules import apply_rules, quality_rules
from tagsim.llm.url_filter import bloom_filter, url_filter
from tests.helpers import SMALL, duck, rows

LONG = "x y z " * 20_000


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    got, expected = queries.QUERIES[name](spark, SMALL).toPandas(), duck(SMALL, queries.ORACLES[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_registered_quality_query_removes_lines_and_rejects_depleted_documents(spark, tmp_path):
    body = lambda i, n: " ".join(f"own{i}word{k}" for k in range(n))
    footer = " ".join(f"footer{k}" for k in range(12))
    data = [(i, f"{body(i, 20)}\n{footer}", "a") for i in range(202)] + [(300, f"{body(300, 8)}\n{footer}", "a"), (301, f"{body(301, 20)}\n{footer}", "b")]
    spark.createDataFrame(data, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sql = queries.ORACLES["op3_quality_rules"]
    expected = __import__("duckdb").connect().execute(f"WITH documents AS (SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'),{sql.strip().removeprefix('WITH')}").fetch_df()
    got = queries.QUERIES["op3_quality_rules"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(expected)
    by = got.set_index("doc_id")
    assert (by["n_frequent_lines"] == 1).sum() == 203 and by["n_frequent_lines"][301] == 0
    assert not by["kept"][300] and not by["base_failed"][300] and by["kept"].sum() == 203


def test_quality_query_removes_lines_and_rejects_depleted_documents_on_the_tables(spark):
    got = queries.QUERIES["op3_quality_rules"](spark, "/root/testdata/sf0.01").toPandas()
    assert got["n_frequent_lines"].sum() > 0 and (~got["kept"] & ~got["base_failed"]).sum() > 0


def test_line_dedup_modes_and_odd_rows(spark):
    texts = [(1, "Same\nown 1\n same "), (2, "SAME\t\nown 2"), (3, "other\n\nother"), (4, None), (5, ""), (None, "same"), (2, "SAME\t\nown 2"), (6, "\n" * 300 + "same\n" * 70 + "end")]
    docs = spark.createDataFrame([(*t, "key", 1.0) for t in texts], "doc_id long, text string, keep string, h1 double")
    got = apply_bitmaps(docs, line_dedup(docs, min_docs=3))
    found = [(r["doc_id"], r["kept_text"], r["n_dropped"]) for r in got.collect()]
    assert got.columns[: len(docs.columns)] == docs.columns
    expected = [(1, "own 1", 2), (2, "own 2", 1), (3, "other\n\nother", 0), (4, "", 0), (5, "", 0), (None, "", 1), (2, "own 2", 1), (6, "\n" * 300 + "end", 70)]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    first = apply_bitmaps(docs.filter("doc_id IN (1, 3)"), line_dedup(docs.filter("doc_id IN (1, 3)"), min_docs=1, keep_first=True))
    assert {r["doc_id"]: r["kept_text"] for r in first.collect()} == {1: "Same\nown 1", 3: "other\n"}
    assert apply_bitmaps(docs.limit(0), line_dedup(docs.limit(0))).count() == 0


def test_keep_bitmap_has_the_kept_lines(spark):
    docs = spark.createDataFrame([(i, "\n".join(["a"] + [f"{i} {k}" for k in range(70)] + ["a"])) for i in range(3)], "doc_id long, text string")
    got = line_dedup(docs, min_docs=2).first()
    assert got["n_lines"] == 72 and got["n_dropped"] == 2
    words = {w["word"]: w["bits"] & (2**64 - 1) for w in got["keep"]}
    assert words == {0: 2**64 - 2, 1: 2**64 - 1 - 2**7}


def plain_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_lines(spark):
    texts = [None, "", "a b c d e", "a b c d e a b c d e", "a a a a a a a", LONG, "É ü 😀 # *\n\n#\n# ", " \x0b\x0c ", "one two\x1cthree\u00a0four five six seven eight nine ten eleven"]
    body = " ".join(f"w{i}" for i in range(30))
    frequent = [f"menu item\n{body} {i}" for i in range(6)] + [f"menu item\n{i} left {i} over"  + " menu" * 9 for i in range(2)]
    data = [(i, t, "h") for i, t in enumerate(texts)] + [(100 + i, t, "g") for i, t in enumerate(frequent)] + [(200, frequent[0], None), (None, "x", None), (100, frequent[0], "g")]
    docs = spark.createDataFrame([(*d, 5) for d in data], "doc_id long, text string, source string, n_words int")
    got = quality_rules(docs, min_texts=6, max_share=0.0)
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(data)
    for i, t, _ in data:
        r = by[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(t), (i, t and t[:50])
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
    assert by[103]["n_left"] == 31 and by[103]["kept"] and by[200]["n_left"] == 33  # another host
    kept = apply_rules(docs, got)
    assert kept.columns == docs.columns and all("menu item" not in r["text"] for r in kept.filter("source = 'g'").collect())
    assert kept.filter("doc_id = 100").count() == 2
    assert quality_rules(docs.limit(0)).count() == 0
    # nearly all of its words are in lines above the limit
    thin = docs.limit(0).unionByName(spark.createDataFrame([(i, f"{body}\n{i} a", "g", 0) for i in range(7)], docs.schema))
    assert {(r["base_failed"], r["kept"]) for r in quality_rules(thin, min_texts=6, max_share=0.0).collect()} == {(False, False)}


def test_copies_of_one_text_are_one_document_to_the_limits(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, text, "g") for i in range(20)], "doc_id long, text string, source string")
    assert quality_rules(docs, min_texts=6, max_share=0.0).filter("kept").count() == 20


def test_urls(spark):
    urls = {1: "http://EXAMPLE.org/es/x", 2: "https://a.example.org/en/1?q", 3: "http://notexample.org/en/1", 4: "http://x.com/fr/a://b", 5: "http://x.com/de/", 6: "http://X.net", 7: "nothing", 8: None, 9: "http://x.org", 10: "http://www.x.net/?utm_a=1#f", 11: "http://ÀB.net/p//?b=1&a=2&ref=9", 12: "://", 13: "http://x.net/other"}
    pages = spark.createDataFrame([(i, u, "html", "v") for i, u in urls.items()] + [(6, urls[6], "h", "v")], "page_id long, url string, html string, verdict string")
    listed = spark.createDataFrame([("x.net",), ("x.net",), (None,), ("Àb.net/p?a=2&b=1",)], "url string")
    got = {r["page_id"]: r for r in url_filter(pages, listed).collect()}
    assert url_filter(pages, listed).count() == len(urls) + 1
    assert {i: r["rule"] for i, r in got.items() if r["rule"]} == {1: "example.org/es/", 2: "example.org/en/1", 3: "org/", 4: "com/fr/", 5: "com/de/"}
    assert {i for i, r in got.items() if r["verdict"] == "block"} == {1, 2, 5, 6, 10, 11}
    assert (got[1]["host"], got[1]["path"], got[2]["path"], got[4]["path"], got[7]["host"], got[8]["path"]) == ("example.org", "/es/x", "/en/1", "/fr/a://b", "", "")
    assert url_filter(pages, listed.limit(0)).filter("possible").count() == 0 and url_filter(pages.limit(0), listed).count() == 0


def test_filter_passes_every_listed_url_and_few_others(spark):
    listed = spark.range(3000).select(F.concat(F.lit("a.net/"), "id").alias("url"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.net/"), "id").alias("url"))
    got = url_filter(pages, listed)
    assert got.filter("possible AND page_id < 3000").count() == 3000 and got.filter("verdict = 'block'").count() == 3000
    assert got.filter("possible AND page_id >= 3000").count() < 300
    blocks, n = bloom_filter(listed, 3000)
    assert blocks.count() <= n


def test_hashes_and_groups_agree_with_a_plain_version(spark):
    """Line dedup against a version without Spark, on the small table."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    seen = defaultdict(set)
    for i, t in texts.items():
        for line in t.split("\n"):
            seen[key(line)].add(i)
    expected = {i: hashlib.sha256("\n".join(x for x in t.split("\n") if not key(x) or len(seen[key(x)]) < 10).encode()).hexdigest() for i, t in texts.items()}
    got = queries.QUERIES["op9_line_dedup"](spark, SMALL).collect()
    assert {r["doc_id"]: r["kept_sha256"] for r in got} == expected
