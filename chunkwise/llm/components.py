"""Connected components by label propagation with pointer jumping, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b long): the label is the smallest
    node of the component.  Each round takes the smallest label of a node's
    neighbours (a pre-aggregated minimum, so hubs do not matter) and then follows
    labels of labels; rounds grow with the logarithm of long chains.  Links with a null end are left out."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
                   .select(F.col("a").alias("node"), F.col("b").alias("other")), "edges")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("other"), "label"), "other")
                .groupBy("node").agg(F.min("label").alias("near")))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        far = labels.select(F.col("node").alias("low"), F.col("label").alias("root"))
        step = written(hooked.join(far, "low").select("node", F.col("label").alias("was"), F.least("low", "root").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.where("was <> label").isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further ``links`` (a, b): these are links between classes (a node without a
    label is its own class), one for each pair of classes, and only the classes are worked on."""
    class_of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"class_{end}"))
    ends = (links.join(class_of("a"), "a", "left").join(class_of("b"), "b", "left")
            .select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b")))
    pairs = written(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "class-links")
    if pairs.isEmpty():
        return labels
    upper = components(pairs)
    new = upper.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    up = upper.select(F.col("node").alias("label"), F.col("label").alias("top"))
    return written(labels.union(new).join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
