"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.shared import materialize


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id, component`` for every id in the links (a, b); the component is its least id.

    Each round takes the least label among an id's neighbours and then the label of that
    label, so chains shorten by half or more. A round is written to the shared folder and
    read back; the loop ends when no label changes. Only the number of changes comes to
    the driver. Null ends are left out, loops do no harm, no links give no rows.
    """
    links = links.filter("a is not null and b is not null").select("a", "b")
    edges = materialize(links.union(links.select("b", "a")).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    for _ in range(max_rounds):
        near = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        step = step.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component"))
        step = materialize(step, "labels")
        labels = step.select("id", "component")
        if not step.filter("component <> old").limit(1).count():
            return labels
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
