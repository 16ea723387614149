"""robots.txt files as tables.

Lines "User-agent: x" (or "User-Agent:") and "Disallow: p" count, with exactly one space and nothing before; rules
belong to the last agent named above them, and rules above any agent are ignored. An agent without a rule is known
all the same: it may go anywhere, and does not fall back to '*'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _lines(robots: DataFrame) -> DataFrame:
    lines = robots.select("host", F.posexplode(F.split("robots", "\n")).alias("pos", "line"))
    agent = F.when(F.col("line").rlike(r"^User-[aA]gent: "), F.regexp_extract("line", r"^User-[aA]gent: (.*)", 1))
    rule = F.when(F.col("line").startswith("Disallow: ") & agent.isNull(), F.substring("line", len("Disallow: ") + 1, 1 << 30))
    lines = lines.select("host", "pos", agent.alias("_agent"), rule.alias("prefix"))
    above = Window.partitionBy("host").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("agent", F.last("_agent", ignorenulls=True).over(above)).where("agent <> ''")


def robots_agents(robots: DataFrame) -> DataFrame:
    """(host, agent) of every agent that a host's file (host, robots) names."""
    return _lines(robots).select("host", "agent").distinct()


def robots_rules(robots: DataFrame) -> DataFrame:
    """(host, agent, prefix), distinct; an empty prefix forbids nothing."""
    return _lines(robots).where(F.col("prefix").isNotNull()).select("host", "agent", "prefix").distinct()


def robots_access(requests: DataFrame, robots: DataFrame) -> DataFrame:
    """requests(host, path, agent) plus allowed: false if a non-empty prefix of the agent's rules (or of '*', for an agent the host doesn't name) begins the path.

    An empty path is '/'. Hosts without a file allow everything. Requests are joined on host and agent, then their
    prefixes compared; a host has few rules.
    """
    agents, rules = robots_agents(robots), robots_rules(robots).where("prefix <> ''")
    asked = requests.select("host", "path", "agent").distinct()
    named = asked.join(agents.withColumn("_named", F.lit(True)), ["host", "agent"], "left")
    named = named.withColumn("_as", F.when(F.col("_named"), F.col("agent")).otherwise(F.lit("*")))
    page = F.when(F.coalesce("path", F.lit("")) == "", F.lit("/")).otherwise(F.col("path"))
    per = rules.groupBy("host", F.col("agent").alias("_as")).agg(F.collect_set("prefix").alias("_rules"))
    judged = named.withColumn("_page", page).join(per, ["host", "_as"], "left")
    hit = F.coalesce(F.exists("_rules", lambda p: F.col("_page").startswith(p)), F.lit(False))
    return judged.select("host", "path", "agent", (~hit).alias("allowed"))


def robots_cache(known: DataFrame, fetched: DataFrame) -> DataFrame:
    """(host, robots, at): each host's text as last fetched, kept from batch to batch; null stays for a host without one, which so isn't asked again."""
    both = known.select("host", "robots", "at").unionByName(fetched.select("host", "robots", "at"))
    latest = both.groupBy("host").agg(F.max(F.struct("at", "robots")).alias("last"))
    return latest.select("host", "last.robots", "last.at")


def robots_missing(hosts: DataFrame, known: DataFrame) -> DataFrame:
    """(host): the hosts whose text has to be fetched before their URLs are."""
    return hosts.select("host").distinct().join(known.select("host"), "host", "left_anti")
