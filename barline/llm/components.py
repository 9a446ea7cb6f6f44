"""Connected components of a link table, as joins and minima written out each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import drop_tables, keep_table


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b): the smallest node reachable.

    Each round takes the smallest label of a node's neighbours (a minimum with map-side
    combine, so a hub is no hot spot) and then the label of that label, which halves the
    way left. Rounds end when no label changes; each writes its labels to the shared folder
    and drops those before."""
    both = links.select(F.col("a"), F.col("b")).unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = keep_table(both.filter("a <> b").distinct(), "links")
    labels = keep_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(seen, labels["node"] == seen["a"]).select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        up = low.select(F.col("node").alias("up"), F.col("component").alias("above"))
        jumped = keep_table(low.join(up, low["component"] == up["up"], "left").select(
            "node", "old", F.least("component", F.coalesce("above", "component")).alias("component")
        ), "jumped")
        moved = jumped.filter("component <> old").limit(1).count()
        drop_tables(labels)
        labels = jumped.drop("old")
        labels.kept_at = jumped.kept_at
        if not moved:
            drop_tables(both)
            return labels
