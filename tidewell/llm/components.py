"""Connected components of links between 64-bit numbers, by rounds of contraction.

In each round every node points to the member of its closed neighbourhood with the least hash, another hash each
round, and the links are rewritten between the nodes pointed to. The nodes left shrink by a share in each round,
whatever the shape of the components. Every round's tables are stored in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a long, b long): root is the same within a component and is one of its nodes.

    Repeated links, links in both directions and links to oneself change nothing. A null end drops the link; no links give no rows.
    """
    links = settle(links.where("a is not null and b is not null and a != b").select("a", "b").distinct(), "links")
    found: DataFrame | None = None
    for turn in range(200):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("n"))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("n"))
        steps = settle(both.groupBy("a").agg(F.min(ranked).alias("best")).select(F.col("a").alias("node"), F.least("best", own)["n"].alias("root")), "steps")
        head = steps.select(F.col("node").alias("b"), F.col("root").alias("other"))
        moved = links.join(steps.withColumnRenamed("node", "a"), "a").select(F.col("root").alias("a"), "b")
        links = settle(settle(moved, "moved").join(head, "b").select("a", F.col("other").alias("b")).where("a != b").distinct(), "links")
        if found is None:
            found = steps
        else:
            later = steps.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = settle(found.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        if links.isEmpty():
            return found
    raise RuntimeError("components did not come to an end")
