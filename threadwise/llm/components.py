"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwise.session import reliable


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Links (u, v) of long nodes to (node, root): the smallest node of its component, for every node
    that has a link. Each round hangs neighbours on the smallest one known; what a group sends is one
    minimum, so a hub costs no more than its links. Every round is written before the next reads it."""
    edges = reliable(_down(links))
    before = None
    for _ in range(max_rounds):
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # written, as it is read twice: the driver holds the plan of half a round
        large = reliable(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = reliable(_down(large.join(least, "u").select(F.inline(hung))))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).head()
        # Done when every node hangs on one root and no root hangs on another.
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    rooted = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root")))
    return edges.select(F.inline(rooted)).distinct()


def _down(links: DataFrame) -> DataFrame:
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
