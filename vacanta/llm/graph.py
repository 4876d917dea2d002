"""Connected components of an edge table, by large-star and small-star rounds.

Each partition first replaces its own edges by a spanning forest. A round then links every neighbour of a node
to the least of them, until nothing changes; rounds grow with the logarithm of the longest path. Nothing is
collected but two numbers a round. Every round is a written table, so a lost executor costs one round at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacanta.llm.shared import discard, ship, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of these edges that are not the least."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new != (step := new[new])).any():
            new = step
        if (new == root).all():
            break
        root = new
    rest = root != np.arange(len(nodes))
    return nodes[rest], nodes[root[rest]]


def contract(edges: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                node, least = forest(b.column("a").to_numpy(), b.column("b").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], ["a", "b"])

    ship(edges.sparkSession)
    return edges.mapInArrow(run, "a long, b long")


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges are (a, b), a > b. Large: each larger neighbour to the least of all; small: the others likewise."""
    if large:
        near = edges.union(edges.select("b", "a")).toDF("u", "v")
    else:
        near = edges.toDF("u", "v")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = near.join(least, "u")
    if large:
        out = met.filter("v > u").select("v", "m")
    else:
        out = met.select("v", "m").union(least.select("u", "m"))
    return out.toDF("a", "b").filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) with the least node of each component, for the nodes of any edge (a, b)."""
    now = written(contract(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")).distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    was = state(now)
    while was[0]:
        before, now = now, written(star(star(now, True), False), "edges")
        new = state(now)
        discard(before)
        if new == was:
            break
        was = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
