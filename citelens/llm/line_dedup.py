"""Line dedup by site-relative frequency.

A line is boilerplate on a host when the share of that host's pages that hold it exceeds ``max_ratio`` and it repeats there:
at least ``min_pages`` (two) pages hold it, for on a host of under 1 / max_ratio pages any line exceeds the ratio.  Lines are compared without their surrounding ASCII white space; blank lines are never dropped.

Plan: (1) every page is cut into its distinct lines and each line becomes a 128-bit key, before any shuffle; (2) one
partial + final count by (host, key), so a host with a third of all pages or a line on every page is pre-summed in the map
tasks; (3) the few keys over the ratio are joined back to the (page, key) pairs, and only pages that hold one are rebuilt.
Text crosses the network once at most, for the join of pages with their own dropped keys.

Defined results: a null host is a host of its own; null text stays null and counts as a page without lines; repeated rows
count as pages each, unless ``copies`` is False, which counts a host's equal pages once, in the share and in the total, and so
leaves copies of whole pages to other operators; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelens.llm.shared import cut, fresh

#: A line's surrounding white space, which does not count.
BLANKS = " \t\r\x0b\x0c"


def _key(line: Column) -> Column:
    """128 bits of a line; two seeds of one 64-bit hash."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(77), line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keys(text: Column) -> Column:
    """The distinct keys of a page's lines that are not blank."""
    trimmed = F.transform(_lines(text), lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.array_distinct(F.transform(F.filter(trimmed, lambda x: x != ""), _key))


def boilerplate_keys(pages: DataFrame, text: str = "text", host: str = "host", max_ratio: float = 0.05, min_pages: int = 2, copies: bool = True) -> DataFrame:
    """(host, key, pages, total): the lines, by key, that exceed the ratio on their host."""
    narrow = pages.select(F.col(host).alias("host"), _keys(F.col(text)).alias("keys"))
    if not copies:
        page = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(77), text).alias("b"))
        narrow = pages.select(F.col(host).alias("host"), page.alias("page"), _keys(F.col(text)).alias("keys")).dropDuplicates(["host", "page"])
    totals = narrow.groupBy("host").agg(F.count("*").alias("total"))
    counts = narrow.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    joined = counts.join(totals.withColumnRenamed("host", "total_host"), F.col("host").eqNullSafe(F.col("total_host")))
    return joined.filter(F.col("pages") > max_ratio * F.col("total")).select("host", "key", "pages", "total")


def drop_boilerplate_lines(pages: DataFrame, text: str = "text", host: str = "host", max_ratio: float = 0.05, min_pages: int = 2, copies: bool = True) -> DataFrame:
    """pages with boilerplate lines taken out of ``text``, and n_lines, n_dropped (long) beside it.

    The few boilerplate keys of a host are gathered into one array (at most lines-per-page / max_ratio of them, by the
    ratio itself) and meet the pages by host; the join is Spark's own choice by measured size.
    """
    bad = cut(boilerplate_keys(pages, text, host, max_ratio, min_pages, copies).select("host", "key"))
    row, drop, right = fresh(pages, "page_key"), fresh(pages, "dropped_keys"), fresh(pages, "held_by")
    # A page is known by its host and its lines: equal pages of a host lose the same lines, so no row number is needed.
    page = pages.withColumn(row, F.struct(F.xxhash64(host, text).alias("a"), F.xxhash64(F.lit(77), host, text).alias("b")))
    held = page.select(F.col(row).alias(right), F.col(host).alias("h"), F.explode(_keys(F.col(text))).alias("k"))
    hits = held.join(bad, F.col("h").eqNullSafe(F.col("host")) & (F.col("k") == F.col("key")), "left_semi")
    per_page = hits.groupBy(right).agg(F.collect_set("k").alias(drop))
    joined = page.join(per_page, F.col(row) == F.col(right), "left")
    gone = F.coalesce(F.col(drop), F.array().cast("array<struct<a:bigint,b:bigint>>"))
    kept = F.filter(_lines(F.col(text)), lambda x: ~F.array_contains(gone, _key(F.btrim(x, F.lit(BLANKS)))))
    total = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(_lines(F.col(text)))).cast("long")
    left = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(kept)).cast("long")
    changed = F.size(gone) > 0
    clean = F.when(changed, F.array_join(kept, "\n")).otherwise(F.col(text))
    counts = {"n_lines": total, "n_dropped": F.when(changed, total - left).otherwise(F.lit(0).cast("long"))}
    return joined.select(*(clean.alias(c) if c == text else F.col(c) for c in pages.columns if c not in counts), *(v.alias(k) for k, v in counts.items()))
