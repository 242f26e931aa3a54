"""Operator 2: site-relative line frequency.

For each host the pages that contain a line are divided by the pages of the host; lines
above a ratio are boilerplate of that host and are dropped from its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.ngram_join import ngram_jaccard_components

RATIO = 0.1
DOCUMENT_RATIO = 0.01  # of classes of near copies, so what repeats is no copy
MIN_PAGES = 3
BROADCAST_ROWS = 100_000  # hosts, and
BROADCAST_LINES = 1_000_000  # digests in all, eight bytes each
WHOLE_ROWS = 1_000_000  # of one integer each

# Markup that carries no text, elements that end a line, common entities.
_UNSEEN = r"(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
_BREAKS = r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
_TAGS = r"<[^>]*>"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"


def html_text(html: Column) -> Column:
    """Text of a page, one line for each block element."""
    text = F.regexp_replace(html, _UNSEEN, "")
    text = F.regexp_replace(F.regexp_replace(text, _BREAKS, "\n"), _TAGS, "")
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def url_host(url: Column) -> Column:
    """Lower-case host of an address, '' where there is none."""
    return F.lower(F.regexp_extract(url, _HOST, 1))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _digest(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate_lines(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, classes: DataFrame | None = None) -> DataFrame:
    """host, drop: digests of the lines that more than ``ratio`` of the host's pages (and
    at least ``min_pages``) contain.  ``pages`` has (host, text).

    Both counts are partially aggregated, the large one on (host, line), so neither a hot
    host nor a hot line gathers rows.  A page with L different lines can hold at most L,
    so a host has at most (mean L) / ratio such lines: ``drop`` stays short.

    With ``classes`` (doc_id, page; one row per doc_id) ``pages`` has doc_id too, and the
    documents of a host with one page number count as one page; those without a number
    count once for each text.
    """
    digests = F.array_distinct(F.transform(F.filter(_lines("text"), lambda x: F.trim(x) != ""), _digest))
    if classes is None:
        totals, lines = pages, pages.select("host", F.explode(digests).alias("line"))
    else:
        held = pages.select("host", "doc_id", digests.alias("lines"), F.xxhash64("text").alias("own")).join(classes, "doc_id", "left")
        held = cut(held.select("host", "lines", F.coalesce("page", "own").alias("page")))
        totals = held.select("host", "page").distinct()
        lines = held.select("host", "page", F.explode("lines").alias("line")).distinct()
    totals = totals.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    held = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_holding")).where(F.col("n_holding") >= min_pages)
    over = held.join(totals, "host").where(F.col("n_holding") > F.lit(ratio) * F.col("n_pages"))
    return over.groupBy("host").agg(F.collect_set("line").alias("drop"))


def drop_site_lines(rows: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, classes: DataFrame | None = None) -> DataFrame:
    """row (all columns of ``rows``), kept (the text without its host's boilerplate lines),
    n_lines, n_dropped.

    ``rows`` meet the host's short list of digests and filter their own lines, so text is
    neither exploded into the result nor gathered again; beyond BROADCAST_ROWS hosts with
    such lines, or BROADCAST_LINES lines, the join is shuffled on the host, and adaptive execution splits a hot one.
    Null host: a host of its own.  Null text: no lines.  Blank lines are kept and not
    counted.  Equal rows count as so many pages, or as ``classes`` says of their doc_id.
    """
    named = rows.select(F.struct("*").alias("row"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(text, F.lit("")).alias("text"))
    pages = named.select("host", "text") if classes is None else named.select("host", "text", "row.doc_id")
    drop = cut(boilerplate_lines(pages, ratio, min_pages, classes))
    size = drop.agg(F.count(F.lit(1)).alias("hosts"), F.coalesce(F.sum(F.size("drop")), F.lit(0)).alias("lines")).first()
    small = size["hosts"] <= BROADCAST_ROWS and size["lines"] <= BROADCAST_LINES
    joined = named.join(F.broadcast(drop) if small else drop, "host", "left")
    lines = _lines(F.col("text"))
    kept = F.filter(lines, lambda x: ~(F.array_contains("drop", _digest(x)) & (F.trim(x) != "")))
    kept = F.when(F.col("drop").isNull(), lines).otherwise(kept)
    return joined.select(
        "row", F.array_join(kept, "\n").alias("kept"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(kept)).cast("long").alias("n_dropped"),
    )


def dedup_page_lines(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped, kept_text of every page of (page_id, url, html).

    A line is the text between block elements; very long pages are read whole.  A line on
    exactly ``ratio`` of the host's pages stays; repeated rows count as so many pages.  Null html: no lines, kept_text ''.  Null
    url: host ''.  Null or repeated page_id: the row is treated like any other.  Empty
    table: no rows.  Other columns are not read.
    """
    read = pages.select("page_id", url_host(F.coalesce(F.col("url"), F.lit(""))).alias("host"), html_text(F.coalesce(F.col("html"), F.lit(""))).alias("text"))
    out = drop_site_lines(read, F.col("host"), F.col("text"), ratio, min_pages)
    return out.select("row.page_id", "row.host", "n_lines", "n_dropped", F.col("kept").alias("kept_text"))


def dedup_document_lines(docs: DataFrame, ratio: float = DOCUMENT_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) with the lines of their source that
    are boilerplate dropped from text, and n_chars to match.  Texts without such lines,
    null ones among them, stay as they are; no row goes.

    Exact and near copies of a document (operator 9) count as one page of a source, so a
    group of copies alone makes none of its lines boilerplate.  Of documents that hold
    nothing but boilerplate, the one with the smallest doc_id of each text stays whole, as
    do those without a doc_id.
    """
    near = ngram_jaccard_components(docs).where(F.col("doc_id").isNotNull())
    classes = near.groupBy("doc_id").agg(F.min("component_id").alias("page"))
    out = drop_site_lines(docs, F.col("source"), F.col("text"), ratio, min_pages, classes)
    blank = (F.col("n_lines") > 0) & (F.col("n_dropped") == F.col("n_lines"))
    whole = out.where(blank & F.col("row.doc_id").isNotNull()).groupBy(F.xxhash64("row.text").alias("same")).agg(F.min("row.doc_id").alias("doc_id"))
    whole = cut(whole.select(F.col("doc_id").alias("whole")).distinct())
    small = whole.limit(WHOLE_ROWS + 1).count() <= WHOLE_ROWS
    out = out.join(F.broadcast(whole) if small else whole, F.col("row.doc_id") == F.col("whole"), "left")
    hit = (F.col("n_dropped") > 0) & ~(blank & (F.col("whole").isNotNull() | F.col("row.doc_id").isNull()))
    new = {"text": F.when(hit, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(hit, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dedup_page_lines`` of all pages."""
    return dedup_page_lines(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql_text() -> str:
    out = f"regexp_replace(coalesce(html, ''), '{_UNSEEN}', '', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '{_BREAKS}', chr(10), 'g'), '{_TAGS}', '', 'g')"
    for entity, char in _ENTITIES:
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return out


OP2_SQL = f"""
WITH read AS (
  SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(coalesce(url, ''), '{_HOST}', 1)) AS host, {_sql_text()} AS text FROM pages
), line AS (
  SELECT r, page_id, host, pos, parts[pos] AS line
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM read), unnest(range(1, len(parts) + 1)) AS p(pos)
), total AS (SELECT host, count(*) AS n_pages FROM read GROUP BY host
), boiler AS (
  SELECT host, line FROM (
    SELECT host, trim(line, ' ') AS line, count(DISTINCT r) AS n FROM line WHERE trim(line, ' ') <> '' GROUP BY 1, 2
  ) JOIN total USING (host) WHERE n >= {MIN_PAGES} AND n > {RATIO} * n_pages
)
SELECT any_value(l.page_id) AS page_id, any_value(l.host) AS host,
  count(*) FILTER (trim(l.line, ' ') <> '') AS n_lines, count(b.line) AS n_dropped,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (b.line IS NULL), '') AS kept_text
FROM line l LEFT JOIN boiler b ON l.host = b.host AND trim(l.line, ' ') = b.line
GROUP BY l.r
"""
