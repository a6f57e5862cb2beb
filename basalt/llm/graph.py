"""Connected components over an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each end of an edge (a, b) reaches.

    Minimum labels travel over the edges and then jump to their label's label, so the number of
    rounds follows the logarithm of the longest path. Each round is a written table, the last one
    of which is the result (stored_at); the driver sees only whether a label changed. No edges give
    an empty table.
    """
    pairs = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("l"))
        step = labels.join(near, "id", "left").select("id", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        roots = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        nxt = stored(step.join(roots, "label", "left").select("id", "old", F.least("label", "up").alias("label")), "labels")
        discard(labels)
        labels = nxt
        if not nxt.where("label <> old").limit(1).count():
            discard(pairs)
            out = nxt.select("id", "label")
            out.stored_at = nxt.stored_at
            return out
