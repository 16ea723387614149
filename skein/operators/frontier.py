"""The URL frontier in batches: seen URLs, routing to queues, and the schedule that keeps each host's delay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host


def frontier_dedup(urls: DataFrame) -> DataFrame:
    """(url, seq): the first time each URL is seen."""
    return urls.groupBy("url").agg(F.min("seq").alias("seq"))


def new_urls(urls: DataFrame, seen: DataFrame) -> DataFrame:
    return frontier_dedup(urls).join(seen.select("url"), "url", "left_anti")


def frontier_route(urls: DataFrame, back_queues: int = 300, front_queues: int = 1) -> DataFrame:
    """(url, seq, host, queue, number): the first URL of each of the first `back_queues` hosts opens a back queue of its own; all others go to front queues.

    Hosts are ranked by their first URL after they are summed up, so the ranking sorts hosts and not URLs. A front
    queue's number comes from a hash, so that reruns agree.
    """
    u = frontier_dedup(urls).withColumn("host", host(F.col("url")))
    firsts = u.groupBy("host").agg(F.min("seq").alias("first"))
    opened = firsts.orderBy("first", "host").limit(back_queues)
    opened = opened.withColumn("number", F.row_number().over(Window.orderBy("first", "host"))).select("host", "first", F.col("number").cast("long"))
    front = F.pmod(F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(front_queues))
    u = u.join(opened.withColumnRenamed("host", "_h"), (F.col("host") == F.col("_h")) & (F.col("seq") == F.col("first")), "left")
    return u.select("url", "seq", "host", F.when(F.col("number").isNotNull(), F.lit("back")).otherwise(F.lit("front")).alias("queue"), F.coalesce("number", front).alias("number"))


def politeness_schedule(urls: DataFrame, start: int = 0, delay: int = 3000) -> DataFrame:
    """(url, host, at): when each URL may be fetched, the URLs of a host `delay` milliseconds apart in order of arrival, the first after one delay.

    A host with very many URLs is one sorted partition here by its nature: its fetches are one queue.
    """
    u = frontier_dedup(urls).withColumn("host", host(F.col("url")))
    turn = F.row_number().over(Window.partitionBy("host").orderBy("seq", "url"))
    return u.select("url", "host", (F.lit(start) + turn * delay).cast("long").alias("at"))


def next_host(heap: DataFrame, now: int) -> DataFrame:
    """Of heap(host, next_time) the host that is due first and the seconds to wait for it, or no row."""
    return heap.orderBy("next_time", "host").limit(1).select("host", (F.greatest(F.col("next_time") - now, F.lit(0)) / 1000.0).alias("wait_s"))


def push_hosts(heap: DataFrame, hosts: DataFrame, now: int, delay: int = 3000) -> DataFrame:
    """(host, next_time, pushed): the heap with hosts added, due after the delay; a host that is in it already stays as it is."""
    fresh = hosts.select("host").distinct().join(heap.select("host"), "host", "left_anti")
    return heap.select("host", "next_time", F.lit(False).alias("pushed")).unionByName(fresh.select("host", F.lit(now + delay).cast("long").alias("next_time"), F.lit(True).alias("pushed")))
