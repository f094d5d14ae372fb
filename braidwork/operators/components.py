"""Connected components of links of any comparable ids, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork import session


def roots(parent: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, root) whose pointers never rise: doubled until nothing changes. Each round's table replaces the one before, which is deleted if stored() wrote it."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        jumped = session.stored(parent.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), (F.col("higher") < F.col("root")).alias("moved")), "jump")
        session.drop_stored(parent)
        parent = jumped.select("node", "root")
        parent.stored_at = jumped.stored_at
        if not jumped.filter("moved").limit(1).count():
            return parent


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b): the root is the smallest id of its component.

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots and contracts the
    links; the number of roots that still have links at least halves. Written tables cut the lineage; those of a
    round are deleted when the next has been written.
    """
    links = session.stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    out = None
    while links.limit(1).count():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
        found = roots(session.stored(hook, "hook"))
        a, b = found.select(F.col("node").alias("a"), F.col("root").alias("x")), found.select(F.col("node").alias("b"), F.col("root").alias("y"))
        left = session.stored(links.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if out is None:
            out, old = found, [links]
        else:
            higher = session.stored(out.join(found.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left").select("node", F.coalesce("higher", "root").alias("root")), "roots")
            out, old = higher, [links, found, out]
        session.drop_stored(*old)
        links = left
    return out if out is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
