"""Site-relative line deduplication: lines on too large a share of a host's pages are boilerplate.

Lines are counted once per page and summed in the tasks before the shuffle, by 128 hash bits instead of their text.
A host has at most (mean lines per page) / RATIO boilerplate lines, since each stands on more than RATIO of its pages;
that bounds the array per host which meets the pages in an equi-join, where adaptive execution may split a hot host.
DataFrame functions only.
"""

from pyspark.sql import functions as F

from stepgrove.session import materialize

from .catalog import query, table

#: A line goes when it stands on more than this share of its host's pages, in hosts of at least so many pages.
RATIO = 0.3
LEAST_PAGES = 2

#: Fixed patterns: what isn't text, what ends a line, and other tags.
UNSEEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BREAKS = r"(?i)</?(?:p|div|li|ul|ol|nav|article|section|header|footer|aside|main|h[1-6]|table|tr|td|th|title|head|body|html|blockquote|pre|br|hr)\b[^>]*>"
TAGS = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host(url):
    """The lower-cased host of a URL; null when there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), F.lit(""))


def page_text(html):
    """The visible text of a page, a line per block element."""
    seen = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "")
    return F.regexp_replace(F.regexp_replace(seen, BREAKS, "\n"), TAGS, "")


def lines_of(text):
    """The lines of a text without outer blanks, empty ones left out."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))
    return F.filter(trimmed, lambda x: x != "")


def _mark(line):
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g"))


def boilerplate(rows, ratio=RATIO, least=LEAST_PAGES):
    """(host, host_pages, marks) of rows (host, lines); marks are the hashes of the lines to drop."""
    known = rows.filter(F.col("host").isNotNull())
    marks = known.select("host", F.explode(F.array_distinct(F.transform("lines", _mark))).alias("mark"))
    counts = marks.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n"))
    pages = known.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    over = counts.filter("n > 1").join(pages, "host").filter((F.col("host_pages") >= least) & (F.col("n") > F.lit(ratio) * F.col("host_pages")))
    found = over.groupBy("host").agg(F.collect_list("mark").alias("marks"))
    return pages.join(found, "host", "left")


def drop_lines(pages, id, host, text, ratio=RATIO, least=LEAST_PAGES):
    """One row per row of ``pages``: id, host, host_pages, n_lines, n_dropped and the text without the dropped lines.

    ``host`` and ``text`` are columns. A line that a page repeats counts once for the share, and all its repeats go.
    Pages without a host and hosts of fewer than ``least`` pages keep every line (host_pages is null without a host).
    Null and empty texts have no lines and count as pages. Repeated rows are pages each; other columns play no part.
    """
    rows = pages.select(F.col(id).alias("id"), host.alias("host"), lines_of(text).alias("lines"))
    # Stored, so that the join has a table of known size beside the pages and may split a hot host.
    joined = rows.join(materialize(boilerplate(rows, ratio, least)), "host", "left")
    kept = F.filter("lines", lambda x: ~F.array_contains(F.coalesce("marks", F.array().cast("array<struct<h:bigint,g:bigint>>")), _mark(x)))
    return joined.select("id", "host", "host_pages", F.size("lines").alias("n_lines"), kept.alias("kept")).select(
        F.col("id").alias(id), "host", F.col("host_pages").cast("bigint").alias("host_pages"), F.col("n_lines").cast("bigint").alias("n_lines"),
        (F.col("n_lines") - F.size("kept")).cast("bigint").alias("n_dropped"), F.array_join("kept", "\n").alias("text"),
    )


SQL = rf"""
WITH seen AS (
  SELECT page_id, nullif(lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)), '') AS host,
         regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{UNSEEN}', '', 'g'), '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g') AS body,
         row_number() OVER () AS r
  FROM pages),
rows AS (
  SELECT page_id, host, r, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x, E' \t\r\x0B\x0C')), lambda x: x <> '') AS lines
  FROM seen),
totals AS (SELECT host, count(*) AS host_pages FROM rows WHERE host IS NOT NULL GROUP BY host),
counts AS (
  SELECT host, line, count(*) AS n FROM (SELECT DISTINCT host, r, unnest(lines) AS line FROM rows WHERE host IS NOT NULL) GROUP BY host, line),
bad AS (
  SELECT host, list(line) AS bad FROM counts JOIN totals USING (host)
  WHERE n > 1 AND host_pages >= {LEAST_PAGES} AND n > {RATIO}::DOUBLE * host_pages GROUP BY host),
kept AS (
  SELECT page_id, rows.host, host_pages, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS kept
  FROM rows LEFT JOIN totals ON rows.host = totals.host LEFT JOIN bad ON rows.host = bad.host)
SELECT page_id, host, host_pages, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS text
FROM kept
"""


@query("op9_line_dedup", SQL)
def op9_line_dedup(spark, folder):
    return drop_lines(table(spark, folder, "pages"), "page_id", host(F.col("url")), page_text(F.col("html")))
