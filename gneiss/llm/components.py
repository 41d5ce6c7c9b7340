"""Connected components of a graph too large for one machine.

Alternates the large-star and small-star steps of Kiveris et al. (2014). Every step is an
aggregate with map-side partials and a join with one row for each node, so no neighbourhood is
ever collected. The rows of busy nodes aren't shuffled: what they are joined to is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import cut, join_facts


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to its least one."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    up = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return join_facts(up, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    over = join_facts(down, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return over.union(least.select("u", F.col("m").alias("v"))).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each edge's component, the root itself included.

    ``edges`` has two long columns u and v. Loops and repeated edges are harmless; an empty
    edge table gives an empty result; nodes without edges don't appear.
    """
    now = cut(edges.select("u", "v").where("u <> v").distinct())
    state = _state(now)
    while state[0]:
        now = cut(_small(cut(_large(now))))
        before, state = state, _state(now)
        if before == state:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
