"""Connected components by least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of the links (a, b): the least id it is linked to, directly or not.

    Each round takes the least label among a node and its neighbours, by an aggregate without lists, and then the
    label's own label. Rounds go on until none changes, about as many as the logarithm of the longest path.
    """
    both = written(links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select("b", "a")).distinct(), "links", again=True)
    label = written(both.groupBy("id").agg(F.least("id", F.min("other")).alias("component")), "labels", again=True)
    while True:
        seen = both.join(label.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("near"))
        step = label.join(seen, "id").select("id", F.least("component", "near").alias("next"), "component")
        ahead = label.select(F.col("id").alias("next"), F.col("component").alias("far"))
        step = written(step.join(ahead, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("next"), "component"), "labels", again=True)
        label = step.select("id", F.col("next").alias("component"))
        if step.where("next <> component").isEmpty():
            return label
