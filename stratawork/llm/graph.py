"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratawork.llm.text import stored


def components(links: DataFrame) -> DataFrame:
    """The smallest id that each id of `links` (a, b) reaches: columns id, component.

    Every round takes the smallest label among the neighbours and then the label of that label, so the distance that is
    covered doubles. Rounds are written to the shared folder; only the number of changed labels reaches the driver. A hub
    with very many links is one row per task after the partial minimum.
    """
    both = stored(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.id == near.a).select(
            "id", F.col("component").alias("was"), F.least("component", "near").alias("component")
        )
        target = labels.select(F.col("id").alias("target"), F.col("component").alias("beyond"))
        moved = step.join(target, F.col("component") == F.col("target")).select(
            "id", F.least("component", "beyond").alias("component"), "was"
        )
        moved = stored(moved, "labels")
        changed = moved.filter("component != was").limit(1).count()
        labels = moved.select("id", "component")
        if not changed:
            return labels
