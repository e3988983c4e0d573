"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut


def components(links: DataFrame) -> DataFrame:
    """(id, comp): every id of ``links`` (a, b) with the least id reachable from it.

    Each round an id takes the least label among itself, its neighbours and the label of
    its label, which roughly halves the distance to the end.  Tables of each round are
    written, so no lineage grows.
    """
    edges = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = cut(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").join(jump, "comp")
        new = cut(step.select("id", F.least("comp", "other", "far").alias("comp"), (F.least("comp", "other", "far") < F.col("comp")).alias("moved")), "labels")
        labels = new.select("id", "comp")
        if new.where("moved").isEmpty():
            return labels
