"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import Scratch, release


def connected_components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for each node of the links (a, b); component: the smallest node that it reaches.

    Alternates hooking each node's larger neighbours to its smallest one with pointer jumping; each
    round is written to the shared folder, the one before is removed. Rounds grow with the
    logarithm of the longest path. A node's smallest neighbour comes from a partial aggregate, and
    the join back has one row for each node on its other side, so a hot node's rows can be split.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    edges = scratch.table(edges, f"{name}-0")
    done = 0
    while True:
        low = scratch.table(edges.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")), f"{name}-low-{done}")
        root = low.select(F.col("v").alias("u"), F.col("m").alias("up"))
        # what is left to do: a node with two parents, or a parent that has a parent itself
        settled = low.where("n > 1").limit(1).count() == 0 and edges.join(root, "u", "left_semi").limit(1).count() == 0
        if settled:
            return low.select("v", "m").unionByName(low.select(F.col("m").alias("v"), "m").distinct()).toDF("node", "component")
        others = edges.join(low.select("v", "m"), "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        hooked = low.select("v", F.col("m").alias("u")).unionByName(others)
        # (v, u) jumps to u's parent, and a u with a parent keeps it: both come from one join, as a plan of half the size is less for the driver
        parents = hooked.join(root, "u", "left").select(F.explode(F.array(F.struct("v", F.coalesce("up", "u").alias("u")), F.struct(F.col("u").alias("v"), F.col("up").alias("u")))).alias("e"))
        rows = parents.select("e.v", "e.u").where("u IS NOT NULL AND v <> u")
        nxt = scratch.table(rows.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct(), f"{name}-{done + 1}")
        scratch.drop(f"{name}-{done}", f"{name}-low-{done}")
        edges, done = nxt, done + 1
        release(scratch.spark)
