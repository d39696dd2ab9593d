"""Boilerplate lines by their share of a site's pages, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edulake.session import settle

#: A line that stands on more than this share of a site's pages is boilerplate ...
RATIO = 0.02
#: ... if it stands on at least so many pages.
MIN_PAGES = 5

_EDGES = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(_EDGES)))


def line_shares(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """Per host and line (as ``key``, the hash of the trimmed line): ``pages`` that hold it, and the host's ``total``.

    Identical texts of one host are one page, so that a page copied often does not turn its own lines into
    boilerplate. Blank lines, null texts and null hosts are left out.
    """
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text")).where("host IS NOT NULL")
    pages = pages.where("text IS NOT NULL").withColumn("page", F.xxhash64("text"))
    keys = F.transform(F.filter(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(_EDGES)) != ""), _key)
    rows = pages.select("host", "page", F.explode(F.array_distinct(keys)).alias("key"))
    # Copies and repeats fall together in the map-side half of each aggregation.
    shares = rows.groupBy("host", "key", "page").agg(F.lit(1).alias("one")).groupBy("host", "key")
    totals = pages.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("total"))
    return shares.agg(F.count("*").alias("pages")).join(totals, "host")


def drop_boilerplate(
    docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``row`` (the whole input row), ``text`` without boilerplate lines, ``n_lines`` and ``n_dropped``.

    A line is dropped wherever it stands on its host when more than ``ratio`` of the host's pages, and at least
    ``min_pages`` of them, hold it. Lines are compared without spaces, tabs and carriage returns around them; blank
    lines stay. A row with a null host is left as it is, a null text stays null with no lines, and an empty text has
    one line. A text of boilerplate alone becomes empty; its row stays. Repeated rows each get their row.

    A host's boilerplate is a short list: lines on over ``ratio`` of its pages number at most the mean lines of a page
    divided by ``ratio``. Spark broadcasts the lists when they are small and else joins by host, splitting hot hosts.
    """
    found = line_shares(docs, text, host).where((F.col("pages") >= min_pages) & (F.col("pages") > ratio * F.col("total")))
    lists = settle(found.groupBy("host").agg(F.collect_set("key").alias("boilerplate")))
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("whole"), F.col(host).alias("host"))
    lines = _lines(F.col("whole"))
    left = F.filter(lines, lambda x: ~F.array_contains(F.col("boilerplate"), _key(x)))
    n_lines = F.when(F.col("whole").isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    cleaned = rows.join(lists, "host", "left").select(
        "row",
        "whole",
        n_lines.alias("n_lines"),
        F.when(F.col("boilerplate").isNull(), lines).otherwise(left).alias("left"),
    )
    n_left = F.when(F.col("whole").isNull(), 0).otherwise(F.size("left"))
    return cleaned.select(
        "row", F.array_join("left", "\n").alias("text"), "n_lines", (F.col("n_lines") - n_left).alias("n_dropped")
    )


SQL = f"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
edges AS (SELECT ' ' || chr(9) || chr(13) AS e),
held AS (SELECT DISTINCT source, text, trim(line, e) AS line
         FROM (SELECT source, text, unnest(lines) AS line FROM pages), edges WHERE trim(line, e) <> ''),
totals AS (SELECT source, count(DISTINCT text) AS total FROM pages GROUP BY source),
found AS (SELECT source, list(line) AS boilerplate
          FROM (SELECT source, line, count(*) AS n FROM held GROUP BY source, line) JOIN totals USING (source)
          WHERE n >= {MIN_PAGES} AND n > {RATIO} * total GROUP BY source),
cleaned AS (SELECT doc_id, lines,
                   CASE WHEN boilerplate IS NULL THEN lines
                        ELSE list_filter(lines, lambda x: NOT list_contains(boilerplate, trim(x, e))) END AS rest
            FROM pages LEFT JOIN found USING (source), edges)
SELECT doc_id, array_to_string(rest, chr(10)) AS text, len(lines)::BIGINT AS n_lines,
       (len(lines) - len(rest))::BIGINT AS n_dropped FROM cleaned
"""
