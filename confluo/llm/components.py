"""Connected components by label exchange and pointer jumping, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): component is the smallest id it reaches.

    Each round takes the smallest label among the neighbours and then the label of that label,
    until no label changes; a star settles in two rounds, a chain in about the logarithm of its
    length. Tables are written between rounds, so a lost executor costs a round at most, and
    both sides of each join have an exchange that Spark can split where an id is hot.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        low = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("far"))
        new = materialize(low.join(jump, "low").select("id", "old", F.least("low", "far").alias("component")), "labels")
        changed = new.where("old != component").limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels
