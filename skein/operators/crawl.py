"""A crawl over a snapshot of pages, round by round: due URLs, robots, fetch, links, seen URLs, frontier.

A round is a batch over tables, so retries and lost executors are Spark's own affair. What the pages of a live web
would answer is read from a snapshot (url, html); a URL that isn't in it was not found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host, path
from ..session import materialize
from . import web as W
from .robots import robots_access


@dataclass
class Crawl:
    """frontier (url, seq) waits, fetched (url, html, round) is done, html null where nothing was found or robots forbid."""

    frontier: DataFrame
    fetched: DataFrame
    round: int = 0


def front_dequeue(routed: DataFrame, n: int = 1) -> DataFrame:
    """The n URLs that have waited longest in each front queue of frontier_route()."""
    order = Window.partitionBy("number").orderBy("seq", "url")
    return routed.where("queue = 'front'").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def start(seeds: DataFrame) -> Crawl:
    """seeds (url): each waits once, in order of the URL."""
    frontier = seeds.select("url").distinct().withColumn("seq", F.lit(0).cast("long"))
    nothing = frontier.select("url", F.lit(None).cast("string").alias("html"), F.lit(0).alias("round")).limit(0)
    return Crawl(materialize(frontier, "frontier"), materialize(nothing, "fetched"))


def step(crawl: Crawl, snapshot: DataFrame, robots: DataFrame, agent: str = "*", per_host: int = 1) -> Crawl:
    """One round: each host's `per_host` URLs that have waited longest are fetched, and what they link to joins the frontier unless it was seen."""
    turn = Window.partitionBy("host").orderBy("seq", "url")
    waiting = crawl.frontier.withColumn("host", host(F.col("url"))).withColumn("_n", F.row_number().over(turn))
    waiting = materialize(waiting.withColumn("due", F.col("_n") <= per_host).drop("_n"), "waiting")
    due = waiting.where("due").select("url", "host", path(F.col("url")).alias("path"), F.lit(agent).alias("agent"))
    allowed = robots_access(due.select("host", "path", "agent").distinct(), robots)
    # A URL whose host or path can't be read has no rules.
    pages = due.join(allowed, ["host", "path", "agent"], "left").join(snapshot.select("url", "html"), "url", "left")
    pages = materialize(pages.select("url", F.when(F.coalesce("allowed", F.lit(True)), F.col("html")).alias("html"), F.lit(crawl.round + 1).alias("round")), "pages")
    fetched = materialize(crawl.fetched.unionByName(pages), "fetched")
    links = W.hyperlinks(pages.where("html is not null").select(F.lit(0).alias("page_id"), "url", "html")).select(F.col("dst").alias("url")).distinct()
    left = waiting.where("not due").select("url", "seq")
    fresh = links.join(fetched.select("url"), "url", "left_anti").join(left.select("url"), "url", "left_anti")
    return Crawl(materialize(left.unionByName(fresh.withColumn("seq", F.lit(crawl.round + 1).cast("long"))), "frontier"), fetched, crawl.round + 1)


def run(seeds: DataFrame, snapshot: DataFrame, robots: DataFrame, agent: str = "*", per_host: int = 1, most: int = 3000, most_rounds: int = 1000) -> Crawl:
    """Rounds until more than `most` pages were found, or none waits."""
    crawl = start(seeds)
    while crawl.round < most_rounds and crawl.frontier.limit(1).count() and crawl.fetched.where("html is not null").count() <= most:
        crawl = step(crawl, snapshot, robots, agent, per_host)
    return crawl
