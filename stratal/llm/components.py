"""Connected components of an edge table, each named by its smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratal.llm.common import remove, slice_size, split_join, written


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """node, component for every node of edges (a, b), written, with its path: smallest neighbour by rounds, then the label of the label.

    Labels are written to the shared folder after each round, so no lineage grows; rounds are about the logarithm of
    the longest path. Minima are taken before and after the shuffle, and joins on a node with very many edges or a
    component with very many nodes deal them over tasks. Rows with a null end are left out; an empty table has no
    components; repeated edges count once.
    """
    spark = edges.sparkSession
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both, base = written(both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    n_edges = both.count()
    degrees, many = written(both.groupBy("b").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > slice_size(n_edges)), "degrees")
    labels, path = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    n_nodes = labels.count()
    while True:
        ends = labels.select(F.col("node").alias("b"), "component")
        heard = split_join(both, ends, ["b"], n_edges, counts=degrees).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(heard, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        further = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        step = split_join(step, further, ["component"], n_nodes, "left")
        step = step.select("node", F.least("component", F.coalesce("next", "component")).alias("component"), (F.least("component", F.coalesce("next", "component")) < F.col("was")).alias("moved"))
        step, after = written(step, "labels")
        moved = step.where("moved").limit(1).count()
        remove(spark, path)
        labels, path = step.select("node", "component"), after
        if not moved:
            remove(spark, base, many)
            return labels, path
