"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, keyed_join, stored


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """A row (v, root) for each vertex of an edge: root is the smallest vertex that it can reach.

    Each round every vertex takes the smallest label around it, every tree of labels takes the smallest that any of its
    vertices has seen, and labels are then followed one step further, so that paths shrink about by half. Each round's
    labels are a table in the shared folder; nothing but two counts comes to the driver. Labels that most vertices share
    are joined by broadcast (see keyed_join), so that one large component doesn't land in one task. Needs vertices that
    don't have a large share of the edges. An edge with a null end is left out.
    """
    good = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = stored(
        good.select(F.col(a).alias("v"), F.col(b).alias("u")).union(good.select(F.col(b).alias("v"), F.col(a).alias("u"))).distinct(),
        "edges",
    )
    labels = stored(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("root")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("root").alias("seen"))
        seen = stored(labels.join(around, "v").select("v", "root", F.least("root", "seen").alias("seen")), "seen")
        if not seen.where(F.col("seen") < F.col("root")).limit(1).count():
            dropped(seen)
            # No edge joins two labels; what is left is to follow labels to their ends.
            while True:
                up = labels.select(F.col("v").alias("root"), F.col("root").alias("up"))
                on = stored(keyed_join(labels, up, "root").select("v", F.coalesce("up", "root").alias("root"), F.col("root").alias("was")), "labels")
                moved = on.where(F.col("root") != F.col("was")).limit(1).count()
                dropped(labels)
                labels = on.drop("was")
                if not moved:
                    dropped(both)
                    return labels
        hooks = seen.groupBy("root").agg(F.min("seen").alias("low"))
        # A vertex points to the least that it or its tree has seen; then to where that vertex points.
        hooked = seen.join(hooks.select(F.col("root").alias("v"), "low"), "v", "left").select("v", F.least("seen", "low").alias("root"))
        hooked = stored(hooked, "hooked")
        up = hooked.select(F.col("v").alias("root"), F.col("root").alias("up"))
        on = stored(keyed_join(hooked, up, "root").select("v", F.coalesce("up", "root").alias("root")), "labels")
        for x in (seen, hooked, labels):
            dropped(x)
        labels = on
