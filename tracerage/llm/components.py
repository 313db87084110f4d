"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` of all nodes in ``a, b`` links; comp is a node of the component, the same for all of it.

    Each round every node points to its least neighbour (or itself), pointers are followed to
    their roots by doubling, and links between roots are all that is left: a component at least
    halves, so rounds grow with the logarithm of its size. Sums are per node with map-side
    minima, so a node with very many links is no hot spot. Nothing reaches the driver but counts.
    """
    known = None
    links = materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "pointers")
        while True:
            next_ = to.select(F.col("node").alias("root"), F.col("root").alias("far"))
            jumped = materialise(to.join(next_, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), "pointers")
            to = jumped.select("node", "root")
            if jumped.where("moved").limit(1).count() == 0:
                break
        if known is None:
            known = to.withColumnRenamed("root", "comp")
        else:
            step = to.select(F.col("node").alias("comp"), "root")
            known = materialise(known.join(step, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "components")
        a, b = to.select(F.col("node").alias("a"), F.col("root").alias("ra")), to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = links.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        links = materialise(left, "links")
        if links.limit(1).count() == 0:
            return known
