"""Connected components of a links table and blocks of bounded size for work inside large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.shared import staged


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, component) of the nodes of ``links`` (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps; the number of rounds grows with the logarithm of the longest path.
    Smallest neighbours come from an aggregation with map-side combine. Nodes with over 1 / 10,000 of all links, 20,000
    nodes at most by that bound, are broadcast with theirs, so that no hub's links meet in one task; all others are
    joined. Every round is a written table, so a lost executor costs one round at most.
    """
    stars = staged(
        links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), f"{label}-0")
    before = None
    for k in range(1, 200):
        number = before[0] if before else stars.count()
        many = max(1000, number // 10_000)
        both = stars.unionByName(stars.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.min("m").alias("low"), F.count(F.lit(1)).alias("n")).withColumn("low", F.least("low", "v"))
        greater = both.filter(F.col("m") > F.col("v"))
        if number > many:
            low = staged(low, f"{label}-low-{k}")
            hubs = low.filter(F.col("n") > many).select("v", F.col("low").alias("hub"))
            greater = greater.join(F.broadcast(hubs), "v", "left")  # at most 2 x number / many rows
            large = greater.filter("hub is not null").select(F.col("m").alias("v"), F.col("hub").alias("m"))
            large = large.unionByName(greater.filter("hub is null").join(low.filter(F.col("n") <= many), "v").select(F.col("m").alias("v"), F.col("low").alias("m")))
        else:
            large = greater.join(low, "v").select(F.col("m").alias("v"), F.col("low").alias("m"))
        keep = low.filter(F.col("low") < F.col("v")).select("v", F.col("low").alias("m"))
        large = large.unionByName(keep).filter(F.col("v") != F.col("m")).distinct()
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(least, "v").filter(F.col("m") != F.col("low")).select(F.col("m").alias("v"), F.col("low").alias("m"))
        stars = staged(small.unionByName(least.select("v", F.col("low").alias("m"))).distinct(), f"{label}-{k}")
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = stars.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
    return stars.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(roots)


def ties(rows: DataFrame, classes: DataFrame, id: str, label: str) -> tuple[DataFrame, DataFrame] | None:
    """What makes rows that share an id one node: (id, node) of the ids whose rows are in ``classes`` under several digests,
    and links (a, b) between the nodes of each id; None if no two rows share an id. ``rows``: id, d1, d2; ``classes``: node, d1, d2.
    """
    several = rows.filter(F.col(id).isNotNull()).groupBy(id).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(id)
    several = staged(several, f"{label}-shared-ids")
    if several.isEmpty():
        return None
    nodes = rows.join(several, id).select(id, "d1", "d2").distinct().join(classes.select("d1", "d2", "node"), ["d1", "d2"])
    nodes = staged(nodes.select(id, "node"), f"{label}-ties")
    low = nodes.groupBy(id).agg(F.min("node").alias("a"))
    return nodes, nodes.join(low, id).filter("a <> node").select("a", F.col("node").alias("b"))


def blocks_of(n: Column, most: int, least: int = 128) -> Column:
    """Blocks for a group of ``n`` rows: of four times the root of n each, between ``least`` and ``most``, so that tasks stay
    small beside the group and rows are not sent to more tasks than that takes."""
    return F.ceil(n / F.least(F.lit(most), F.greatest(F.lit(least), 4 * F.sqrt(n))))


def block_pairs(rows: DataFrame, blocks: Column, node: str) -> DataFrame:
    """``rows`` dealt to pairs of blocks of their group: columns block_a <= block_b; any two rows of a group meet in one.

    ``blocks`` is the number of blocks of the row's group; 1 leaves the group whole. This is the exact way for groups
    too large for one task: each row is sent to as many tasks as its group has blocks.
    """
    mine = F.pmod(F.xxhash64(F.col(node)), blocks).cast("int")
    dealt = rows.withColumn("__mine", mine).withColumn("__other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    return dealt.withColumns({"block_a": F.least("__mine", "__other"), "block_b": F.greatest("__mine", "__other")}).drop("__other").withColumnRenamed("__mine", "block")
