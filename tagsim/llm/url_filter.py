"""URL filters: host and path rules first, then a listed-URL test, where a blocked Bloom filter passes possible hits to an exact join.
DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsim.llm.common import ascii_lower, stored

#: Fixed values: (verdict, host, path) of each rule.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: The filter never has more blocks, of 4 x 64 bits, than this: 32 MB of bits at most whatever the list's length. A longer list
#: means more possible hits, never another result.
MAX_BLOCKS = 1 << 20
#: Keys to a block of 256 bits, below that bound: about 1 in 400 clean URLs is a possible hit.
KEYS_PER_BLOCK = 24


def url_host(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_canonical(url: Column) -> Column:
    """host without www., path without closing slashes, and the query's parameters in order without utm_... and ref; null without ://."""
    host, path = F.regexp_replace(url_host(url), r"^www\.", ""), F.regexp_replace(url_path(url), "/+$", "")
    query = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.startswith("utm_") & ~p.startswith("ref=")))
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; null if none fits. For rule sets of up to some hundred."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last one wrapped is the first one tried
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(own + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _bits(url: Column) -> list[Column]:
    """Of a URL: one bit in each of four 64-bit words."""
    h = F.xxhash64(F.lit(7), url)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63)).cast("int")) for j in range(4)]


def bloom_filter(listed: DataFrame, n_listed: int) -> tuple[DataFrame, int]:
    """listed: url. Rows (block, w0 .. w3) of the blocks that hold a key, at most MAX_BLOCKS of them, and the number of blocks."""
    n_blocks = 1
    while n_blocks < MAX_BLOCKS and n_blocks * KEYS_PER_BLOCK < n_listed:
        n_blocks *= 2
    keyed = listed.select(_block(F.col("url"), n_blocks).alias("block"), *[b.alias(f"w{j}") for j, b in enumerate(_bits(F.col("url")))])
    return keyed.groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(4)]), n_blocks


def _block(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(n_blocks)).cast("int")


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, canonical, possible (the filter passed it) for each row of pages.

    listed: a table whose column url holds canonical URLs to block; nulls and repeats in it count for nothing. A rule's verdict
    holds where a rule fits; else a page whose canonical URL is listed is blocked and any other allowed. A null url, or one
    without ://, has an empty host and path, no canonical URL, and is allowed. Rows that repeat are judged alike; a null id stays. An empty
    table gives an empty table. Only the id and the url of pages are read."""
    blocked = stored(listed.select("url").filter(F.col("url").isNotNull()).distinct(), "listed_urls")
    bloom, n_blocks = bloom_filter(blocked, blocked.count())
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    own = own.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), url_canonical(F.col("url")).alias("canonical"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "ruled": verdict})
    # the filter has MAX_BLOCKS rows at most, so it may be sent to every executor
    probe = own.withColumn("block", F.when(F.col("rule").isNull() & F.col("canonical").isNotNull(), _block(F.col("canonical"), n_blocks)))
    probe = probe.join(F.broadcast(bloom), "block", "left")
    hit = F.lit(True)
    for j, bit in enumerate(_bits(F.col("canonical"))):
        hit = hit & (F.col(f"w{j}").bitwiseAND(bit) != 0)
    probe = probe.withColumn("possible", F.coalesce(hit, F.lit(False)))
    columns = ["page_id", "host", "path", "rule", "ruled", "canonical", "possible"]
    clean = probe.filter(~F.col("possible")).select(*columns, F.lit("allow").alias("method"))
    # only the few possible hits are shuffled to the exact join; its other side has each URL once, so a hot URL can be split
    hits = probe.filter("possible").select(*columns).join(blocked.withColumnRenamed("url", "canonical").withColumn("found", F.lit(True)), "canonical", "left")
    hits = hits.select(*columns, F.when(F.col("found"), "block").otherwise("allow").alias("method"))
    return clean.unionByName(hits).select("page_id", "host", "path", "rule", F.coalesce("ruled", "method").alias("verdict"), "canonical", "possible")


def junk_pages(pages: DataFrame) -> DataFrame:
    """The listed URLs of the query: canonical URLs of pages whose title holds a run of three symbols such as %%%, *** or ###."""
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return pages.filter(title.rlike(r"%%%|\*\*\*|###")).select(url_canonical(F.col("url")).alias("url"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter(pages, junk_pages(pages)).select("page_id", "host", "path", "rule", "verdict", "canonical")


OP6_SQL = r"""
WITH u AS (
  SELECT page_id, url, html, coalesce(position('://' IN url), 0) AS mark FROM pages),
v AS (
  SELECT page_id, html, mark,
    CASE WHEN mark > 0 THEN translate(regexp_extract(substr(url, mark + 3), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN mark > 0 THEN regexp_extract(substr(url, mark + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    CASE WHEN mark > 0 THEN regexp_extract(substr(url, mark + 3), '^[^?#]*\?([^#]*)', 1) ELSE '' END AS query
  FROM u),
c AS (
  SELECT *, CASE WHEN mark > 0 THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical
  FROM (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'ref='))) AS kept FROM v)),
listed AS (
  SELECT DISTINCT canonical FROM c WHERE regexp_matches(regexp_extract(html, '<title>([^<]*)</title>', 1), '%%%|\*\*\*|###') AND canonical IS NOT NULL),
r AS (
  SELECT c.*, listed.canonical IS NOT NULL AS found,
    CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM c LEFT JOIN listed ON c.canonical = listed.canonical)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN found THEN 'block' ELSE 'allow' END AS verdict, canonical
FROM r
"""
