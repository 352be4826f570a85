"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushwin.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, label): label is the least node reachable.

    Least labels spread over edges, then over labels (a node takes its
    label's label), so the rounds grow with the logarithm of a chain's
    length. Each round is written to the shared folder; only the count of
    changed labels comes to the driver. Minima combine map-side and the
    joins are plain equi-joins, which Spark splits where a node is hot."""
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        spread = staged(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")), "spread")
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = staged(spread.join(jump, "label").select("node", F.least("label", "far").alias("label"), "old"), "labels")
        if not new.where(F.col("label") != F.col("old")).limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")
