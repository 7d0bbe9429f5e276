"""Connected components: star contractions by shuffles, and one task for what is small enough."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from florascan.sources.storage import stored


def connected_components(edges: DataFrame, max_rounds: int = 60, salts: int = 8) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the smallest node it reaches.

    Large stars link the greater neighbours of a node with its least one, small stars the others; each round is written
    to shared storage, so that neither the plan nor what a lost executor costs grows. The loop ends when a round
    changes nothing. A hub's least neighbour is dealt to ``salts`` tasks, which share the hub's neighbours.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "components")
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        large = both.filter("b > a").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int")).join(least, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        rooted = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = rooted.select("a", F.col("m").alias("b")).unionByName(rooted.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = stored(small, "components")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
    raise RuntimeError("components did not settle")


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the numbers 0 to n - 1 that each is connected with, by the pairs (a, b): hook roots, then halve paths."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def _solve(edges: pa.Table) -> pa.Table:
    a, b = (edges[c].combine_chunks() for c in ("a", "b"))
    nodes = pa.concat_arrays([a, b]).unique()
    nodes = nodes.take(pc.sort_indices(nodes))
    root = joined(len(nodes), pc.index_in(a, nodes).to_numpy(), pc.index_in(b, nodes).to_numpy())
    moved = (root != np.arange(len(nodes))).nonzero()[0]
    return pa.table({"node": nodes.take(pa.array(moved)), "root": nodes.take(pa.array(root[moved]))})


def components(edges: DataFrame, small: int = 1 << 20) -> DataFrame:
    """(node, root) of every node of the edges (a, b) that is not itself the smallest node it reaches.

    Up to ``small`` edges, a bound on one task's memory, are joined in one task; more by ``connected_components``.
    """
    edges = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    if edges.count() > small:
        return connected_components(edges)
    kind = edges.schema["a"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("root", kind)])
    return stored(edges.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_solve, schema), "roots")
