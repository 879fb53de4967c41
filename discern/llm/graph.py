"""Connected components of links, by minimum labels with pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discern.llm.common import stored


def components(links: DataFrame, kept: stored, name: str) -> DataFrame:
    """``links(a, b)`` of long ids to a stored table (node, label): the smallest id reachable.

    Every round takes the smallest label among the neighbours and then the label's own label, so
    the rounds grow with the logarithm of a chain's length.  Each round is written and read back;
    nothing but one sum a round reaches the driver.
    """
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = kept.keep(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    labels = kept.keep(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), f"{name}-0")
    total, step = None, 0
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            kept.drop(f"{name}-edges")
            return labels
        total = now
        offered = edges.join(labels, edges["u"] == labels["node"]).select(F.col("v").alias("node"), "label")
        lower = offered.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        lower = kept.keep(lower, f"{name}-{step}-low")
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = lower.join(up, "label").select("node", F.col("above").alias("label"))
        kept.drop(f"{name}-{step}")
        step += 1
        labels = kept.keep(jumped, f"{name}-{step}")
        kept.drop(f"{name}-{step - 1}-low")
