"""Connected components of a link table by hooking, pointer jumping and contraction.

Each round hooks every vertex to its smallest neighbour if that is smaller; a vertex
that neither hooks nor is hooked to then hooks to its smallest neighbour all the same,
which belongs to a tree with a smaller root.  So every vertex that still has links ends
in a tree of at least two, and the number of vertices halves each round.  Pointer
jumping (the parent becomes the parent's parent until nothing moves) then brings every
vertex to its root, the smallest of its tree, in a number of jumps that grows like the
logarithm of the tree's depth.  Links move to the roots, and those inside one tree go.
Rounds and jumps together thus grow like the square of a logarithm at most; a sorted
chain of any length takes one round.  Tables are written to the shared folder after
every step; only their counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_staged, staged


def _roots(parent: DataFrame) -> DataFrame:
    """(v, p) with p the root of v, from a forest (v, p) whose roots are their own parent."""
    while True:
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jumped = staged(parent.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "jumps")
        drop_staged(parent)
        parent = jumped
        if not parent.where("moved").limit(1).count():
            return parent


def connected_components(links: DataFrame) -> DataFrame:
    """(vertex, label) for every vertex of ``links`` (a, b: long): ``label`` is the
    smallest vertex it is linked to over any number of links.  Null, repeated and
    self links are ignored; no links give no rows."""
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e = staged(links.distinct(), "links")
    labels = None
    while e.limit(1).count():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = staged(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")), "neighbours")
        hooked = near.where("m < v").select(F.col("m").alias("v"), F.lit(True).alias("has")).distinct()
        free = (F.col("m") > F.col("v")) & F.col("has").isNotNull()
        parent = staged(near.join(hooked, "v", "left").select("v", F.when(free, F.col("v")).otherwise(F.col("m")).alias("p")), "parents")
        drop_staged(near)
        parent = _roots(parent)
        if labels is None:
            new = staged(parent.select(F.col("v").alias("vertex"), F.col("p").alias("label")), "labels")
        else:
            new = staged(labels.join(parent, F.col("label") == F.col("v"), "left")
                         .select("vertex", F.coalesce("p", "label").alias("label")), "labels")
            drop_staged(labels)
        labels = new
        pa, pb = parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = e.join(pa, "a").join(pb, "b").where("pa <> pb")
        rest = staged(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        drop_staged(e)
        drop_staged(parent)
        e = rest
    if labels is None:
        return e.select(F.col("a").alias("vertex"), F.col("b").alias("label"))
    return labels
