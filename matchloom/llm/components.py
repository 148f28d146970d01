"""Connected components of a graph of nodes and the keys they share, by label propagation without any driver-side state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import drop, keep


def components(edges: DataFrame) -> DataFrame:
    """(v, comp): a component's id for every node. edges: (v, key), both 64-bit; nodes that share a key belong together.

    Each round takes the smallest label over a key's nodes and over a node's keys, as partial sums, so that a key of many
    nodes is combined before it is shuffled; keys of one node connect nothing and are left out. Repeated edges count
    once; rows with a null key give a component of the node alone; no edges give no rows.
    """
    edges = keep(edges.where(F.col("v").isNotNull()).distinct(), "edges")
    shared = edges.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("v").alias("a"), F.max("v").alias("z")).where("a != z").select("key")
    links = keep(edges.join(shared, "key").select("v", "key"), "links")
    label = links.groupBy("v").agg(F.min("key").alias("comp"))
    while True:
        at_key = links.join(label, "v").groupBy("key").agg(F.min("comp").alias("comp"))
        # max sees whether the keys of a node still differ: then another round is needed
        new = keep(links.join(at_key, "key").groupBy("v").agg(F.min("comp").alias("comp"), F.max("comp").alias("most")), "labels")
        moved = new.where("comp != most").limit(1).count()
        drop(label)
        label = new.select("v", "comp")
        label._kept_at = new._kept_at
        if not moved:
            break
    return edges.select("v").distinct().join(label, "v", "left").select("v", F.coalesce("comp", F.xxhash64(F.lit("alone"), "v")).alias("comp"))
