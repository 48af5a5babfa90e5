"""Line dedup by site-relative frequency, in column functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill.llm.common import stored

#: A line on more than this share of its host's pages, and on this many of them at least, is boilerplate.
RATIO = 0.3
LEAST_PAGES = 3
#: Parts in which the pages of a host meet its list of boilerplate lines.
SALTS = 32

#: Fixed patterns; both engines read them alike.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
UNSEEN = (r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>")
BLOCK_TAG = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li"
    r"|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>"
)
TAG = r"<[^>]*>"
SPACES = r"[ \t\r\f\x0B]+"


def host_of(url: Column) -> Column:
    """The host in lower case; null for a null url or one without a host."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def lines_of(html: Column) -> Column:
    """The lines a reader sees: text between block tags, spaces joined, empty lines left out."""
    text = F.coalesce(html, F.lit(""))
    for pattern in UNSEEN:
        text = F.regexp_replace(text, pattern, " ")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK_TAG, "\n"), TAG, "")
    parts = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, SPACES, " ")))
    return F.filter(parts, lambda x: x != "")


def boilerplate_lines(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, boilerplate) from (host, lines): a host's array of lines that exceed the ratio.

    Counts are summed on the map side. The array is short whatever the host's size: lines on more
    than a share r of its pages are at most 1 / r times the lines of an average page.
    """
    known = pages.where("host is not null")
    totals = known.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = known.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    over = counts.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return over.groupBy("host").agg(F.collect_set("line").alias("boilerplate"))


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per page: page_id, host, n_lines, n_dropped, text (the kept lines in order).

    A line counts once per page, whatever its position; all its occurrences go or stay. Defined cases:
    a null or empty html has no line and an empty text; a page without a host keeps all lines; hosts
    of fewer than `least_pages` pages drop nothing; null ids stay null; repeated rows count as pages of
    their own; an empty table gives an empty result; other columns are ignored.
    """
    own = stored(
        pages.select(
            F.col("page_id"), host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"),
        ),
        "page-lines",
    )
    # each host's array is short, so it can stand once per salt; no task holds all pages of a large host
    salted = stored(boilerplate_lines(own, ratio, least_pages), "boilerplate").select(
        "host", "boilerplate", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    spread = own.withColumn("salt", F.pmod(F.xxhash64("page_id", F.size("lines"), F.try_element_at("lines", F.lit(1))), F.lit(SALTS)).cast("int"))
    kept = F.filter("lines", lambda x: ~F.array_contains(F.col("boilerplate"), x))
    return (
        spread.join(salted, ["host", "salt"], "left")
        .withColumn("kept", F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(kept))
        .select(
            "page_id", "host",
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
            F.concat_ws("\n", "kept").alias("text"),
        )
    )


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def oracle(ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> str:
    text = "coalesce(html, '')"
    for pattern in UNSEEN:
        text = f"regexp_replace({text}, {_sql(pattern)}, ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, {_sql(BLOCK_TAG)}, chr(10), 'g'), {_sql(TAG)}, '', 'g')"
    return f"""
WITH own AS (
  SELECT page_id, nullif(lower(regexp_extract(url, {_sql(HOST)}, 1)), '') AS host,
         list_filter(list_transform(string_split({text}, chr(10)),
           lambda x: trim(regexp_replace(x, {_sql(SPACES)}, ' ', 'g'))), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS pages FROM own WHERE host IS NOT NULL GROUP BY host),
counts AS (SELECT host, line, count(*) AS n
  FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM own WHERE host IS NOT NULL) GROUP BY host, line),
over AS (SELECT host, list(line) AS boilerplate FROM counts JOIN totals USING (host)
  WHERE n >= {least_pages} AND n > {ratio} * pages GROUP BY host),
cut AS (SELECT page_id, own.host, lines,
    list_filter(lines, lambda x: NOT list_contains(coalesce(boilerplate, []), x)) AS kept
  FROM own LEFT JOIN over ON own.host = over.host)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
       coalesce(array_to_string(kept, chr(10)), '') AS text
FROM cut
"""
