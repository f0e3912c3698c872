"""Connected components of a graph too large for one machine."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.operators.shared_table import write_shared

from .groups import with_group


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b: bigint); component is its smallest node.

    Alternates two steps until nothing changes. Large star: the larger neighbours of a node are hung
    on its smallest neighbour. Small star: the smaller neighbours of a node, and itself, are hung on
    the smallest of them. The number of edges never grows, and the number of rounds grows with the
    logarithm of the longest path. Every round is a stored table, so lineage stays short.
    Links of a node with itself and repeated links have no effect; no links give no rows.
    """
    edges = write_shared(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    )
    before = None
    while True:
        total, state = edges.agg(
            F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
        ).first()
        if (total, state) == before:
            break
        before = total, state
        both = edges.union(edges.select("v", "u"))
        starred = with_group(both, ["u"], 2 * total, F.min("v").alias("least"))
        large = (
            starred.where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
            .where("u > v").distinct()
        )
        large = write_shared(large)
        starred = with_group(large, ["u"], total, F.min("v").alias("least"))
        edges = write_shared(
            starred.select("u", F.col("least").alias("v"))
            .union(starred.where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v")))
            .distinct()
        )
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
