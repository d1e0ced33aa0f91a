"""HTML extraction: the main text of pages, without the templates of their sites.

A page's elements that say what they are (navigation, forms, scripts, names such as `sidebar`) go where it is read (page_tree.py). What is
left of each page is a list of blocks, and of the elements around them with the hash of each one's subtree. The hashes are counted per
host in Spark, and subtrees that recur across many pages of a host are its template and are deleted.

Copies of an article recur too, but they are no template. So pages are counted by the context in which a subtree stands: the longest block outside of
it. A template stands in as many contexts as there are articles, the paragraphs of an article that was copied stand in one. A share
of the host's contexts is the limit, at any size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsim.llm.common import ROW_KEY, row_key, stored
from tagsim.llm.page_tree import Page
from tagsim.llm.url_filter import url_host

#: A subtree is a template in this many contexts at least and at this share of its host's contexts: in pages that do not say what their article is, and
#: inside articles, where passages that many texts share are no template.
MIN_PAGES, SHARE = 3, 0.5
MIN_PAGES_INSIDE, SHARE_INSIDE = 5, 0.8
#: Templates that go to every executor; more are joined as a table.
MAX_TEMPLATES = 200_000
#: Characters of text that a worker hands on at once.
HELD = 8 << 20

BLOCKS = f"page_id long, url string, host string, row_key {ROW_KEY}, blocks array<string>, context long, elements array<struct<hash: long, low: int, high: int, context: long>>, inside boolean"


def _signed(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def with_contexts(blocks: list[str], elements: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int, int, int]]]:
    """The page's context, the hash of its longest block, and each element with the hash of the longest block outside of it. An element that holds all has
    the context 0."""
    order = sorted(range(len(blocks)), key=lambda i: (-len(blocks[i]), i))
    hashes: dict[int, int] = {}

    def context(low: int, high: int) -> int:
        if high - low == len(blocks):
            return 0
        # at most as many blocks are passed over as the element holds
        i = next(i for i in order if not low <= i < high)
        if i not in hashes:
            hashes[i] = _signed(blocks[i])
        return hashes[i]

    return context(0, 0), [(h, low, high, context(low, high)) for h, low, high in elements]


def page_blocks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """BLOCKS of each row of pages."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("blocks", pa.list_(pa.string())), ("context", pa.int64()), ("elements", pa.list_(pa.struct([("hash", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("context", pa.int64())]))), ("inside", pa.bool_())])
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                rows, size, high = [], 0, low
                while high < batch.num_rows and size < HELD:
                    markup = batch.column("html")[high].as_py() or ""
                    blocks, elements, inside = Page(markup).article()
                    context, elements = with_contexts(blocks, elements) if blocks else (None, [])
                    rows.append({"blocks": blocks, "context": context, "elements": [dict(zip(("hash", "low", "high", "context"), e, strict=True)) for e in elements], "inside": inside})
                    size += len(markup)
                    high += 1
                found = pa.Table.from_pylist(rows, schema).combine_chunks().to_batches()[0]
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("page_id", "url", "host", "row_key")], *found.columns], names=["page_id", "url", "host", "row_key", *schema.names])
                low = high

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.select("page_id", "url", url_host(F.col("url")).alias("host"), row_key(F.col("page_id"), F.col("url"), F.col("html")).alias("row_key"), "html").mapInArrow(read, BLOCKS)


def site_templates(blocks: DataFrame) -> DataFrame:
    """host, hash, n, total: subtrees of MIN_PAGES contexts and a share of SHARE at least of their host's contexts. Tasks count before they shuffle."""
    seen = blocks.filter("host <> ''")
    count = seen.select("host", F.explode("elements").alias("e")).groupBy("host", F.col("e.hash").alias("hash")).agg(F.count_distinct("e.context").alias("n"))
    # both as tables: a host may have a large part of all rows, and Spark splits its task only in a join of two plain exchanges
    count = stored(count.filter(F.col("n") >= min(MIN_PAGES, MIN_PAGES_INSIDE)), "template_counts")
    total = stored(seen.filter(F.col("context").isNotNull()).groupBy("host").agg(F.count_distinct("context").alias("total")), "template_hosts")
    total = F.broadcast(total) if total.count() <= MAX_TEMPLATES else total
    return count.join(total, "host").filter(F.col("n") >= F.col("total") * min(SHARE, SHARE_INSIDE))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_template (blocks that were deleted as the site's template) for each row of pages.

    The text is the article's blocks in page order, joined by \\n; character references are decoded, and white space in a block is one space; a
    line break inside a block is white space. Of a page with a main part, the article is that part, else the outermost `article` elements, else what
    is left of the page. A null or empty html has an empty text. Pages with a null url, or without a host, lose nothing as a template. Rows that
    repeat have the same text each; a null id stays. An empty table gives an empty table. Other columns aren't read."""
    blocks = stored(page_blocks(pages, id_col, url_col, html_col), "page_blocks")
    templates = stored(site_templates(blocks), "site_templates")
    templates = F.broadcast(templates) if templates.count() <= MAX_TEMPLATES else templates
    own = blocks.select("row_key", "host", "inside", F.explode("elements").alias("e")).select("row_key", "host", "inside", "e.hash", "e.low", "e.high")
    least, share = F.when(F.col("inside"), MIN_PAGES_INSIDE).otherwise(MIN_PAGES), F.when(F.col("inside"), SHARE_INSIDE).otherwise(SHARE)
    gone = own.join(templates, ["host", "hash"]).filter((F.col("n") >= least) & (F.col("n") >= F.col("total") * share))
    gone = gone.select("row_key", F.explode(F.sequence("low", F.col("high") - 1)).alias("block")).groupBy("row_key").agg(F.collect_set("block").alias("gone"))
    gone = stored(gone, "template_blocks")
    # pages that lose nothing, most of them in many tables, are not shuffled where the others are few
    gone = F.broadcast(gone) if gone.count() <= MAX_TEMPLATES else gone
    found = blocks.select("page_id", "url", "row_key", "blocks").join(gone, "row_key", "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("blocks") - 1), "gone"), lambda i: F.get("blocks", i))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(kept), "\n")
    return found.select("page_id", "url", text.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_template")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
