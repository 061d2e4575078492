"""Connected components of an edge table by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.sources.staging import stage


def connected(edges: DataFrame) -> DataFrame:
    """(node long, label long): equal labels exactly within a component of edges (a, b).

    Every round each node points at the smallest number among itself and its
    neighbours, edges are redrawn between what their ends point at, and labels
    follow.  Numbers are scrambled first (xxhash64 of one 64-bit number is
    one-to-one), so rounds grow with the logarithm of the size on any input order.  Each round's tables are written
    to the staging folder.  Nothing but one flag a round goes to the driver.
    """
    mixed = edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"),
                         F.col("a").alias("na"), F.col("b").alias("nb"))
    both = mixed.select("a", "na").unionByName(mixed.select(F.col("b").alias("a"), F.col("nb").alias("na")))
    labels = stage(both.distinct().select(F.col("na").alias("node"), F.col("a").alias("label")), "cc_labels")
    edges = stage(mixed.filter("a <> b").select("a", "b").distinct(), "cc_edges")
    while edges.limit(1).count():
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = stage(ways.groupBy("a").agg(F.min("b").alias("to"))
                      .select(F.col("a").alias("at"), F.least("a", "to").alias("to")), "cc_point")
        labels = stage(labels.join(point, labels["label"] == point["at"], "left")
                       .select("node", F.coalesce("to", "label").alias("label")), "cc_labels")
        one = edges.join(point, edges["a"] == point["at"]).select(F.col("to").alias("a"), "b")
        two = one.join(point, one["b"] == point["at"]).select("a", F.col("to").alias("b"))
        edges = stage(two.filter("a <> b")
                      .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc_edges")
    return labels
