"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Links in a file of a round, about, and files that a round has at most if its links are fewer.
FILE_LINKS, FILES = 250_000, 8


def _least_neighbour(links: DataFrame) -> DataFrame:
    """Each link (u, v) with m, the least of u and all its neighbours. The minimum combines before the shuffle."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.join(least, "u")


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``links`` (u, v) reaches, itself included.

    Every round is written to the shared folder, so that lineage stays short, in files as its links need them; rounds grow with
    the logarithm of the longest path, and there are as many as it takes. Links with a null end and links of a node to itself are
    left out.
    """
    now = common.stored(links.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = lambda: tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    mark = state()
    while True:
        large = _least_neighbour(_both_ways(now)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = _least_neighbour(down)
        small = least.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = common.stored(small.filter("u <> v").distinct().coalesce(max(FILES, -(-mark[0] // FILE_LINKS))), "links")
        before, mark = mark, state()
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
