"""Crawled pages to links, graph and contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import anchors, html_text
from ..functions.urls import normalize

ILLEGAL = ["mailto:", "javascript:", "#", "tel:"]


def fetched(pages: DataFrame) -> DataFrame:
    """Pages of a fetch log (status, content_type, ...) that were found and are text."""
    return pages.where((F.col("status") == 200) & F.col("content_type").contains("text"))


def hyperlinks(pages: DataFrame) -> DataFrame:
    """(page_id, url, dst, anchor): each page's distinct normalized links; of several to one target the last text."""
    a = pages.select("page_id", "url", F.posexplode(anchors(F.col("html"))).alias("pos", "a"))
    for start in ILLEGAL:
        a = a.where(~F.col("a.href").startswith(start))
    a = a.select("page_id", "url", "pos", normalize(F.col("a.href"), F.col("url")).alias("dst"), F.col("a.text").alias("text"))
    return a.groupBy("page_id", "url", "dst").agg(F.max_by("text", "pos").alias("anchor"))


def link_graph(links: DataFrame) -> DataFrame:
    """(src, dst): distinct, without links of a page to itself; links within a host stay."""
    return links.select(F.col("url").alias("src"), "dst").where("src <> dst").distinct()


def page_content(pages: DataFrame) -> DataFrame:
    """(url, content): the texts of all captures of a URL that aren't empty, later ones first."""
    t = pages.select("url", "page_id", html_text(F.col("html")).alias("text")).where(F.length("text") > 0)
    latest = F.array_sort(F.collect_list(F.struct((-F.col("page_id")).alias("k"), "text")))
    return t.groupBy("url").agg(F.array_join(F.transform(latest, lambda x: x["text"]), " ").alias("content"))


def anchor_text(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, anchors): texts of links to a page from pages fetched after it, later ones first."""
    known = pages.groupBy(F.col("url").alias("dst")).agg(F.min("page_id").alias("first"))
    a = links.select("page_id", "dst", F.trim("anchor").alias("text")).where(F.length("text") > 0).join(known, "dst").where("page_id > first")
    latest = F.array_sort(F.collect_list(F.struct((-F.col("page_id")).alias("k"), "text")))
    return a.groupBy(F.col("dst").alias("url")).agg(F.array_join(F.transform(latest, lambda x: x["text"]), " ").alias("anchors"))


def crawl_batch(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a crawl of these pages hands on: (url, content) and (src, dst)."""
    return page_content(pages), link_graph(hyperlinks(pages))
