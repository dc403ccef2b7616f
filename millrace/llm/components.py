"""Connected components of an edge table, with alternating large-star and small-star steps (Kiveris et al., 2014).

Each half step is one minimum for each node, aggregated before the shuffle, and one join of the edges with it, in
which Spark splits a node with very many edges. The edge table is written to the shared folder after every round; the
driver sees two numbers of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import store


def join_labels(label, a, b):
    """Unite, in place, the groups of a[k] and b[k]; the numbers k of pairs that suffice for it, one for each group that goes.

    label: for each node the least node of its group, as an array.
    """
    import numpy as np

    left, used = np.arange(len(a)), [np.zeros(0, np.int64)]
    while len(left):
        x, y = label[a[left]], label[b[left]]
        apart = x != y
        left, high, low = left[apart], np.maximum(x, y)[apart], np.minimum(x, y)[apart]
        high, first = np.unique(high, return_index=True)
        used.append(left[first])
        label[high] = low[first]
        while not np.array_equal(up := label[label], label):
            label[:] = up
    return np.concatenate(used)


def _low(u: str, v: str):
    return F.least(F.col(u), F.col(v))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u gets an edge to the least of u and its neighbours. Edges are (u, v) with v below u."""
    both = edges.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", _low("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and all its neighbours below it get an edge to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another one; component is the least node of its component."""
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    pair, seen = store.materialize(pair, "component-edges"), None
    while True:  # every round at least halves the longest way, up to a logarithm; a round that changes nothing ends it
        state = tuple(pair.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == seen or not state[0]:
            return pair.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pair.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
        pair = store.materialize(_small_star(_large_star(pair)), "component-edges", instead=pair)
