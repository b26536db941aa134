"""Connected components of a graph given by its edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import remove, scratch_dir
from .shared import staged


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _to_least(edges: DataFrame) -> DataFrame:
    """Each edge with ``least``, the smallest neighbour of its source or the source itself.

    The minimum is formed before the shuffle; the join back splits hot sources.
    """
    least = edges.groupBy("src").agg(F.min("dst").alias("least")).select("src", F.least("src", "least").alias("least"))
    return edges.join(least, "src")


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours move to the smallest one."""
    out = _to_least(edges.union(_turned(edges))).where(F.col("dst") > F.col("src"))
    return out.select(F.col("dst").alias("src"), F.col("least").alias("dst")).where("src != dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours, and the node itself, move to the smallest one. Edges run from large to small."""
    with_least = _to_least(edges)
    moved = with_least.select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    own = with_least.select("src", F.col("least").alias("dst"))
    return moved.union(own).where("src != dst").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    ``edges`` has two columns of one sortable type; direction, repeats and loops don't matter.
    Null nodes have no edges. The number of rounds grows with the logarithm of the longest path.
    Each round is written to the shared folder, which ends its lineage, and the one before removed.
    """
    left, right = edges.columns
    spark, path = edges.sparkSession, scratch_dir(edges.sparkSession)
    edges = edges.select(F.greatest(left, right).alias("src"), F.least(left, right).alias("dst"))
    edges = staged(edges.where("src != dst").distinct(), path)
    state = None
    while True:
        found = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if tuple(found) == state or found[0] == 0:
            break
        state = tuple(found)
        before, path = path, scratch_dir(spark)
        edges = staged(_small_star(_large_star(edges)), path)
        remove(spark, before)
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
