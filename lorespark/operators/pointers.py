"""Chains of pointers followed to their ends, in rounds that double the distance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled


def ends(links: DataFrame) -> DataFrame:
    """``node, end, cyclic`` of ``links(node, next)``, one link a node: where each chain ends, by pointer jumping.

    A node without a link is an end. A chain of n links takes the logarithm of n rounds, each one join and one written
    table. What still moves after as many rounds as the longest chain could take goes round: ``cyclic``, with
    a null end. A node that links to itself is an end.
    """
    now = settled(links.where("node <> next").select("node", F.col("next").alias("end")))
    for _ in range(math.ceil(math.log2(max(2, now.count()))) + 1):
        on = now.select(F.col("node").alias("end"), F.col("end").alias("far"))
        step = settled(now.join(on, "end", "left").select("node", F.coalesce("far", "end").alias("end"), F.col("far").isNotNull().alias("moved")))
        now = step.select("node", "end")
        if step.where("moved").isEmpty():
            break
    still = now.select(F.col("node").alias("end"), F.lit(True).alias("cyclic")).distinct()
    return now.join(still, "end", "left").select("node", F.when(F.col("cyclic").isNull(), F.col("end")).alias("end"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
