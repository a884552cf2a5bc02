"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round points larger nodes at the smallest neighbour known; edges stay as many as nodes and links, and the rounds grow
with the logarithm of the longest path.  Every round is written to the shared folder and read back, so lineage stays short
and a lost executor costs one round.  Nothing but a count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialize


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("__v")).select("u", F.least("u", "__v").alias("m"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    turned = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return pairs.select(turned.alias("e")).select("e.u", "e.v")


def _large_star(pairs: DataFrame) -> DataFrame:
    both = _both_ways(pairs)
    joined = both.join(_least_neighbour(both), "u").where(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    # u > v holds in every pair of a large star.
    joined = pairs.join(_least_neighbour(pairs), "u")
    ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))
    return joined.select(ends.alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def _mark(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another; ``root`` is the smallest node it reaches, itself included.

    Edges with a null end and loops link nothing; repeated edges count once; no edges give no rows.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = materialize(pairs.distinct(), "links")
    mark = _mark(pairs)
    while mark[0]:
        pairs = materialize(_small_star(_large_star(pairs)), "stars")
        last, mark = mark, _mark(pairs)
        if mark == last:
            break
    own = pairs.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(own).distinct()
