"""Line dedup by site-relative frequency.

A line's share on a host is the number of the host's pages that contain it over the number of the
host's pages. Lines whose share exceeds ``ratio``, on at least ``min_pages`` pages, are boilerplate of that host
and are dropped from all its pages; other hosts keep them.

Only (host, 64-bit line hash) pairs are shuffled, after partial counts. A page of L distinct lines holds at most
L of the at most mean(L) / ratio boilerplate lines a host can have, so the list kept for a host is bounded by its lines a page
and not by its pages. Lists are broadcast while their measured size is below ``broadcast_lines``; beyond that the lists are joined
by host, with a copy of a host's list for every ``pages_a_salt`` of its pages.

Defined cases: a null text stays null and a null host is a host of its own; blank lines are never counted or dropped; a line that
repeats inside a page counts once; lines compare trimmed of ASCII white space; repeated rows are pages each; an empty table gives
an empty result. Other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import free_name, keep, plain

#: ASCII white space.
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def url_host(url: Column) -> Column:
    """Lower-case host of an absolute URL without user, port and path; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def html_lines(html: Column) -> Column:
    """Visible text of a page, one line a block element: scripts, styles, comments and tags go."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?i)<(?:/?(?:p|div|li|ul|ol|h[1-6]|nav|article|body|head|title|table|tr|footer|header|section)|br)(?:\s[^>]*)?/?>", "\n")
    return F.regexp_replace(text, r"<[^>]*>", "")


def boilerplate(df: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """``(host, total, lines)``: pages of each host and hashes of its boilerplate lines; hosts without any are absent."""
    pages = df.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    keys = F.array_distinct(F.transform(F.filter(F.transform(F.split("text", "\n"), line_key), lambda x: x != ""), lambda x: F.xxhash64(x)))
    counts = pages.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    often = counts.join(totals.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).filter(F.col("n") > F.col("total") * F.lit(ratio))
    return often.groupBy("host").agg(F.first("total").alias("total"), F.sort_array(F.collect_list("line")).alias("lines"))


def drop_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 3, broadcast_lines: int = 500_000, pages_a_salt: int = 100_000) -> DataFrame:
    """``df`` with boilerplate lines gone from its text, and ``n_dropped``, the lines dropped of each row (with underscores added while ``df`` has such a column)."""
    rows, (host, text) = plain(df, host_col, text_col)
    lists = keep(boilerplate(rows, host, text, ratio, min_pages), "boilerplate").select(F.col("host").alias("_host"), "total", F.col("lines").alias("_lines"))
    held = lists.agg(F.coalesce(F.sum(F.size("_lines")), F.lit(0))).first()[0]
    same = F.col(host).eqNullSafe(F.col("_host"))
    if held <= broadcast_lines:
        joined = rows.join(F.broadcast(lists), same, "left")
    else:  # a list stands once for every pages_a_salt pages of its host, and a page meets one of them
        salts = F.ceil(F.col("total") / pages_a_salt).cast("int")
        few = F.broadcast(lists.filter(salts > 1).select(F.col("_host").alias("_large"), salts.alias("_salts")))  # a row a host of many pages
        dealt = rows.join(few, F.col(host).eqNullSafe(F.col("_large")), "left").withColumn("_page_salt", F.pmod(F.xxhash64(text), F.coalesce("_salts", F.lit(1))))
        salted = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        joined = dealt.join(salted, same & (F.col("_page_salt") == F.col("_salt")), "left")
    # A column of its own: the lines of a page are filtered once.
    plain_text = F.col("_lines").isNull() | F.col(text).isNull()
    kept = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains("_lines", F.xxhash64(line_key(x))))
    joined = joined.withColumn("_kept", F.when(~plain_text, kept))
    breaks = F.length(F.col(text)) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    out = joined.select(
        *[F.when(F.col("_kept").isNull(), F.col(c)).otherwise(F.array_join("_kept", "\n")).alias(c) if c == text else F.col(c) for c in rows.columns],
        F.when(F.col("_kept").isNull(), F.lit(0)).otherwise(breaks + 1 - F.size("_kept")).cast("long"),
    )
    return out.toDF(*df.columns, free_name("n_dropped", df.columns))
