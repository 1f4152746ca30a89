"""Connected components of a link table, as DataFrame jobs only.

Alternating large-star and small-star steps (Kiveris et al., 2014): every step
is one grouped minimum and one join on the node, so a hub's links are combined
map-side and its join side can be split; the table is written to the shared
checkpoint folder after each round and its order-free hash tells when it is stable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietab.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return (both.filter("v > u").join(least, "u").filter("v <> m")
            .select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """links has a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    again = links.join(least, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return again.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link in (a, b), a < b; root is the
    component's smallest node.  An empty link table gives an empty result."""
    before = None
    while True:
        links = written(_small_star(_large_star(links)), "links")
        now = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b"))).first())
        if now == before or not now[0]:
            break
        before = now
    return (links.select(F.col("b").alias("node"), F.col("a").alias("root"))
            .union(links.select("a", "a").distinct()))
