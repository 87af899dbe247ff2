"""Connected components of a graph given as rows, without collecting any of it.

Alternating large-star and small-star steps (Kiveris et al. 2014): every step replaces each node's edges by edges to the
smallest neighbour. Edges never multiply, and each round is written to the shared folder, so plans stay short and a lost executor costs
one round at most.

A node may have any number of neighbours, the smallest member of a group of copies for one. So a neighbourhood is never brought
together: its edges lie in salted parts, each part is folded to its least member, the parts' minima are folded to the node's, and that goes
back to the parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.sources.scratch import keep

SALTS = 64


def with_least(rows: DataFrame, key: str, value: str, name: str, by: str) -> DataFrame:
    """The rows with ``name``, the least ``value`` of their ``key``. Rows move by (key, salt of ``by``); by ``key`` alone only one row a salt does."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = dealt.groupBy(key, "salt").agg(F.min(value).alias("part"))
    back = parts.select(key, "salt", F.min("part").over(Window.partitionBy(key)).alias(name))  # at most SALTS rows a key
    return dealt.join(back, [key, "salt"]).drop("salt")


def _with_least(edges: DataFrame) -> DataFrame:
    """The edges with ``m``, the least ``v`` of their ``u``."""
    return with_least(edges.select("u", "v"), "u", "v", "m", "v")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    told = _with_least(both).select("u", "v", F.least("u", "m").alias("m"))
    return told.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are hung to the smallest of them."""
    told = _with_least(edges)
    hung = told.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(told.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v`` (longs): root is the smallest node of its component."""
    now = keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while True:
        after = keep(_small_star(_large_star(now)))
        before, state = state, _state(after)
        if state == before:
            break
        now = after
    leaves = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
