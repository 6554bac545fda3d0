"""Removal of lines that many pages of one site share.

For each site, the number of pages with a line over the number of the site's
pages is the line's relative frequency; lines above ``RATIO`` on at least
``LEAST`` pages are boilerplate of that site and go from all its pages. A share
of fewer pages is no evidence: of a site of under 20 pages, a page and its copy
would both be emptied. Lines are compared without blanks at their ends; blank
lines never go. A site is any column, or the host of a URL (``host``).

Scale. A page sends each distinct line once, as a 128-bit digest, and map-side
sums come before the shuffle, so a line that fills a site is one number from
each task. What is found is a table of at most (mean lines a page) / RATIO rows
for each site. Up to ``FEW`` rows, and ``MOST`` of one site, it is broadcast and
texts lose their lines where they lie. Beyond that lines meet it by (site, line),
where Spark can split a line that fills a site, and pages with boilerplate meet
their text by document.

Edge cases. A null text stays null, an empty one empty. A null site is a site
of its own. Repeated rows and rows that repeat a document id, or have none, count
as pages each. A page whose lines all go has an empty text. A line counts once a
page. A long text is one row of lines; nothing is cut. Ties don't occur: a ratio
must be exceeded. An empty table gives no rows. Columns of docs may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.llm import _spark

RATIO = 0.1
LEAST = 5
#: Rows of boilerplate that are broadcast (about 100 bytes each), in all and of one site.
FEW, MOST = 100_000, 1_000


def host(url: Column) -> Column:
    """The host of a URL, in lower case."""
    return F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _digests(text: Column) -> Column:
    """Of each line: the MD5 of what is between its outer blanks, null for a blank line."""
    bare = lambda x: F.trim(x, F.lit(" \t\r"))
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(bare(x) != "", F.unhex(F.md5(bare(x)))))


def _site(site_col: str) -> Column:
    site = F.col(site_col).cast("string")
    return F.when(site.isNull(), "n").otherwise(F.concat(F.lit("s"), site))


def boilerplate(docs: DataFrame, ratio: float = RATIO, least: int = LEAST, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """(site, line, pages, site_pages) of the lines above the ratio; site is prefixed with s, or n for null; line is a digest."""
    pages = docs.select(_site(site_col).alias("site"), F.col(text_col).cast("string").alias("text"))
    totals = pages.groupBy("site").agg(F.count("*").alias("site_pages"))
    lines = pages.select("site", F.explode(F.array_distinct(_digests(F.col("text")))).alias("line")).where("line is not null")
    counts = lines.groupBy("site", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    return counts.join(totals, "site").where(F.col("pages") > F.lit(ratio) * F.col("site_pages"))


def _without(text: Column, gone: Column) -> Column:
    """text without the lines whose digests are in gone."""
    kept = F.filter(F.arrays_zip(F.split(text, "\n", -1).alias("l"), _digests(text).alias("d")), lambda x: x["d"].isNull() | ~F.array_contains(gone, x["d"]))
    return F.when(gone.isNull(), text).otherwise(F.array_join(F.transform(kept, lambda x: x["l"]), "\n"))


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, least: int = LEAST, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with boilerplate lines gone from the text; other columns are kept."""
    found = _spark.written(boilerplate(docs, ratio, least, site_col, text_col).select("site", "line"), "boilerplate")
    size = found.groupBy("site").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("own_id"), _site(site_col).alias("own_site"), docs[text_col].cast("string").alias("own_text"))
    if size.all <= FEW and size.most <= MOST:
        per_site = found.groupBy("site").agg(F.collect_list("line").alias("gone"))
        joined = whole.join(F.broadcast(per_site), F.col("own_site") == F.col("site"), "left")
    else:
        mark = F.xxhash64("own_text")  # rows of one id are told apart by their text
        lines = whole.select("own_id", "own_site", mark.alias("own_mark"), F.explode(F.array_distinct(_digests(F.col("own_text")))).alias("own_line")).where("own_line is not null")
        hits = lines.join(found, (F.col("own_site") == F.col("site")) & (F.col("own_line") == F.col("line")))
        per_doc = hits.groupBy(F.col("own_id").alias("id"), "site", F.col("own_mark").alias("mark")).agg(F.collect_set("line").alias("gone"))
        joined = whole.join(per_doc, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_site") == F.col("site")) & (mark == F.col("mark")), "left")
    text = _without(F.col("own_text"), F.col("gone"))
    return joined.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def page_lines(html: Column) -> Column:
    """The visible text of a page, a line for each element: scripts, styles and comments go, tags end lines."""
    bare = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", "\n"), "[ \t\r\n]*\n[ \t\r\n]*", "\n")
