"""Connected components of links between documents, in Spark jobs of bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import stored


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component): for every id in ``links`` the smallest id it reaches.

    Alternates a minimum over neighbours with a jump to the label's own label until nothing changes, so
    chains take about the logarithm of their length. A hub with very many links is reduced by partial
    aggregates; the labels are stored after every round.
    """
    both = links.select(F.col(left).alias("id"), F.col(right).alias("other"))
    both = stored(both.union(both.select("other", "id")).where("id <> other").distinct(), "component-links")
    labels = stored(both.groupBy("id").agg(F.least("id", F.min("other")).alias("component")), "component-labels")
    while True:
        around = both.join(labels.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("near"))
        lower = labels.join(around, "id").select("id", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        jump = lower.join(labels.select(F.col("id").alias("to"), F.col("component").alias("far")), "to").select(
            "id", F.least("to", "far").alias("component"), "was"
        )
        new = stored(jump, "component-labels")
        labels = new.select("id", "component")
        if new.where("component <> was").isEmpty():
            return labels
