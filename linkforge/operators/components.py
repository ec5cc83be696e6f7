"""Connected components of an edge table without collecting it.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014). Each step is one aggregation and one join on the node; a hot node's rows are
pre-aggregated map-side in the aggregation and left to skew-join splitting in the join, so no task
ever holds a node's whole neighbourhood.

A round takes six shuffles whatever its size, so up to ``ALONE`` edges of whole numbers are connected
by one task instead, with the same result; larger graphs take the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.runtime import cut, discard

#: Edges that one task connects by itself: 16 MiB of them, and some 100 MiB of work.
ALONE = 1 << 20


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, sorted, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while len(a):
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))  # a root goes below the smallest root it meets
        while not np.array_equal(low, further := low[low]):
            low = further
        a, b = low[a], low[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[low]


def _alone(edges: DataFrame) -> DataFrame:
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if rows:
            table = pa.Table.from_batches(rows).combine_chunks()
            found = smallest_reachable(*(table.column(c).to_numpy() for c in ("u", "v")))
            yield from pa.table([pa.array(x, table.schema.field("u").type) for x in found], names=["node", "component"]).to_batches(10_000)

    return edges.select("u", "v").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; edges have u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).unionAll(rest).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Null ends and self-links are ignored; repeated edges are harmless; an empty table gives no
    rows. Ends must be of one orderable type.
    """
    a, b = F.col(src), F.col(dst)
    now = cut(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    state = _state(now)
    if 0 < state[0] <= ALONE and now.schema["u"].dataType.simpleString() in ("int", "bigint"):
        return _alone(now)
    for _ in range(max_rounds if state[0] else 0):
        new = cut(_small_star(_large_star(now)), "edges")
        new_state = _state(new)
        discard(now)
        now, done = new, new_state == state
        state = new_state
        if done:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
