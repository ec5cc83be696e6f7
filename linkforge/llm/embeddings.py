"""Embedding near duplicates: spherical k-means cells and blocked cosine products.

Equal vectors of a label are one vertex with a multiplicity. Spherical k-means, fitted on a sample
bounded in bytes (``FIT_BYTES``), gives every vector a home cell. Two unit vectors of cosine t are
sqrt(2 - 2t) apart, so where cell borders part them one of the two is at most sqrt((1 - t) / 2) times
the distance of the two homes' centres less similar to the other's centre than to its own: the vector
visits the cells within that reach, but none more than ``margin`` less similar than its home. With
``margin=None`` no pair can be missed; the default spares visits, mostly between far centres, and its
recall is measured. Cells hold about ``CELL_ROWS`` vectors up to ``MAX_CELLS`` cells; beyond, their
number grows with the square root of a label's vectors. Vectors are compared only with equal label and length, in double
precision, as matrix products of row blocks. A cell with more than ``CHUNK`` rows is dealt out as
pairs of chunks. A link is credited once per vertex, and leaves a task as a partial count and as a
spanning forest; components are then found on the forest edges, and the smallest id of a component
is kept. No pair below the threshold is ever linked; recall against brute force is tested.

Defined cases: rows whose label or id is null, or whose vector is null, zero or holds a null or
non-finite component, link with nothing and are kept (a null id: not kept, component null);
repeated rows are copies of one another and link; rows that share an id are one vertex of the graph;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.arrow import forest, map_arrow, runs
from linkforge.operators.components import connected_components
from linkforge.runtime import cut

COSINE = 0.93
MARGIN = 0.15
#: Vectors that a cell is meant to hold, and the cells from which on their number grows with the square root.
CELL_ROWS = 256
MAX_CELLS = 1024
#: The sample that k-means is fitted on: rows at least, rows a cell, and bytes of all its components at most.
FIT_ROWS = 16_384
FIT_PER_CELL = 16
FIT_BYTES = 128 << 20
#: Similarities that are held at once.
BLOCK = 1 << 22
ROUNDS = 8
CHUNK = 2048
SEED = 11


def vertices(rows: DataFrame) -> DataFrame:
    """(label, dim, node, times, v): the distinct vectors that may link, with copies counted."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))) & F.exists(x, lambda c: c != 0)
    good = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    good = good.groupBy("label", "embedding").agg(F.min("vec_id").cast("long").alias("node"), F.count(F.lit(1)).alias("times"))
    return good.select("label", F.size("embedding").alias("dim"), "node", "times", F.col("embedding").alias("v"))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # keeps squares within range
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _blocks(n: int, k: int) -> Iterator[slice]:
    """Runs of rows whose similarities to ``k`` centres fit a block."""
    step = max(1, BLOCK // k)
    return (slice(a, min(a + step, n)) for a in range(0, n, step))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Unit centres of the unit rows ``x``."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        own = np.concatenate([(x[b] @ centres.T).argmax(axis=1) for b in _blocks(len(x), k)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def cell_count(largest: int, cell_rows: int = CELL_ROWS) -> int:
    """Cells for a label of ``largest`` vectors."""
    return max(1, min(-(-largest // cell_rows), max(MAX_CELLS, math.isqrt(largest))))


def fit_cells(nodes: DataFrame, cell_rows: int = CELL_ROWS, fit_rows: int = FIT_ROWS) -> dict[int, np.ndarray]:
    """Centres by vector length, fitted on a bounded sample of vertices chosen by a hash of the id."""
    about = nodes.groupBy("label", "dim").count().agg(F.max("count").alias("largest"), F.max("dim").alias("dim")).first()
    cells = cell_count(about["largest"] or 0, cell_rows)
    fit_rows = max(1, min(max(fit_rows, FIT_PER_CELL * cells), FIT_BYTES // (8 * (about["dim"] or 1))))
    got = nodes.orderBy(F.xxhash64(F.lit(SEED), "node"), "node").limit(fit_rows).select("dim", "v").toArrow()
    out = {}
    for dim in set(got.column("dim").to_pylist()):
        own = got.filter(pa.compute.equal(got.column("dim"), dim)).column("v").combine_chunks()
        x = own.flatten().to_numpy().reshape(-1, dim)
        out[dim] = spherical_kmeans(_unit(x), cells)
    return out


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _visits(x: np.ndarray, c: np.ndarray, margin: float | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell) of all visits of the unit rows ``x``, sorted, and each row's home."""
    rows, cells, homes = [], [], []
    for b in _blocks(len(x), len(c)):
        sims = x[b] @ c.T
        home = sims.argmax(axis=1)
        gap = sims[np.arange(len(home)), home][:, None] - sims
        apart = np.sqrt(np.maximum(2 - 2 * (c[home] @ c.T), 0))  # the centres' distances, never all of them at once
        reach = apart * math.sqrt(max(0.0, 1 - cosine) / 2) + 1e-9
        row, cell = np.nonzero(gap <= (reach if margin is None else np.minimum(reach, margin)))
        rows.append(row + b.start)
        cells.append(cell)
        homes.append(home)
    return np.concatenate(rows), np.concatenate(cells).astype(np.int32), np.concatenate(homes).astype(np.int32)


def assign_cells(nodes: DataFrame, centres: dict[int, np.ndarray], margin: float | None = MARGIN, cosine: float = COSINE) -> DataFrame:
    """A row per vertex and cell: (label, dim, cell, node, times, home, visits, v)."""
    kind, inner = nodes.schema["label"].dataType.simpleString(), nodes.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                c = centres.get(dim)
                if c is None:  # a length that the sample lacks has one cell
                    n = part.num_rows
                    row, cell, home = np.arange(n), np.zeros(n, np.int32), np.zeros(n, np.int32)
                else:
                    row, cell, home = _visits(_unit(_matrix(part.column(4), dim)), c, margin, cosine)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32)
                visits = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell))
                for a in range(0, len(row), 8192):
                    at = pa.array(row[a : a + 8192])
                    own = [part.column(k).take(at) for k in range(2)]
                    cols = [*own, pa.array(cell[a : a + 8192]), part.column(2).take(at), part.column(3).take(at), pa.array(home[row[a : a + 8192]]), visits.take(at), part.column(4).take(at)]
                    yield pa.RecordBatch.from_arrays(cols, names=["label", "dim", "cell", "node", "times", "home", "visits", "v"])

    return map_arrow(nodes, run, f"label {kind}, dim int, cell int, node long, times long, home int, visits array<int>, v {inner}")


def _compare(t: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(nodes, links credited here, forest edges) of one cell's rows, or of one pair of its chunks."""
    t = t.combine_chunks()
    dim, cell = t.column("dim")[0].as_py(), t.column("cell")[0].as_py()
    nodes, times, home, own = (t.column(c).to_numpy() for c in ("node", "times", "home", "own"))
    x = _unit(_matrix(t.column("v").chunk(0), dim))
    lists = t.column("visits").chunk(0)
    spot = np.repeat(np.arange(len(nodes)), np.diff(lists.offsets.to_numpy()))
    cells = lists.flatten().to_numpy()
    homes, home_at = np.unique(home, return_inverse=True)
    place = np.minimum(np.searchsorted(homes, cells), len(homes) - 1)
    known = homes[place] == cells
    visits = np.zeros((len(nodes), len(homes)), bool)  # whose homes among these a vector visits
    visits[spot[known], place[known]] = True
    is_home = home == cell
    across = t.column("x")[0].as_py() != t.column("y")[0].as_py()
    links = np.zeros(len(nodes), np.int64)
    packed = np.zeros((len(nodes), -(-len(nodes) // 8)), np.uint8)
    for a in range(0, len(nodes), 256):
        rows = slice(a, min(a + 256, len(nodes)))
        hit = x[rows] @ x.T >= cosine
        hit[np.arange(rows.stop - a), np.arange(a, rows.stop)] = False
        hit &= is_home[rows, None] | is_home[None, :]
        if across:
            hit &= own[rows, None] != own[None, :]
        if hit.any():
            packed[rows] = np.packbits(hit, axis=1, bitorder="little")
            # A visitor is credited with homes; a home with homes, and with visitors whose home it does not visit.
            credit = hit & (is_home[None, :] | (is_home[rows, None] & ~visits[rows][:, home_at]))
            links[rows] = credit @ times
    return nodes, links, forest(packed, len(nodes))


def cell_links(placed: DataFrame, cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """(a, b, n): rows with b null add n links to vertex a; the others are forest edges."""
    key = ["label", "dim", "cell"]
    sizes = cut(placed.groupBy(*key).count().where("count > 1"), "cells")
    parts = F.ceil(F.col("count") / chunk).cast("int")
    dealt = (
        placed.join(sizes.withColumn("parts", parts).drop("count"), key)
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("x", F.least("own", "other"))
        .withColumn("y", F.greatest("own", "other"))
        .drop("other", "parts")
    )
    order = [*key, "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, order, 4096):
            n = table.num_rows
            change = np.zeros(n, bool)
            change[0] = True
            for c in order:
                v = table.column(c).to_numpy()
                change[1:] |= v[1:] != v[:-1]
            starts = np.append(np.flatnonzero(change), n).tolist()
            a, b, count = [], [], []
            for i, j in zip(starts, starts[1:], strict=False):
                if j - i > 1:
                    nodes, links, edges = _compare(table.slice(i, j - i), cosine)
                    some = np.flatnonzero(links)
                    a += [*nodes[some].tolist(), *(int(nodes[p]) for p, _ in edges)]
                    b += [*[None] * len(some), *(int(nodes[q]) for _, q in edges)]
                    count += [*links[some].tolist(), *[0] * len(edges)]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(count, pa.int64())], names=["a", "b", "n"])

    return map_arrow(dealt.repartition(*order).sortWithinPartitions(*order), run, "a long, b long, n long")


def near_duplicates(rows: DataFrame, cosine: float = COSINE, margin: float | None = MARGIN, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per row of ``rows`` (vec_id, label, embedding): vec_id, n_links, component_id, kept."""
    rows = rows.select("vec_id", "label", "embedding")
    nodes = cut(vertices(rows), "nodes")
    placed = cut(assign_cells(nodes, fit_cells(nodes, cell_rows), margin, cosine), "placed")
    found = cut(cell_links(placed, cosine), "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    groups = connected_components(found.where("b is not null"), "a", "b").withColumnRenamed("node", "member")
    about = nodes.join(counts, nodes.node == counts.a, "left").join(groups, nodes.node == groups.member, "left")
    about = cut(
        about.select(
            F.col("label").alias("l"),
            F.col("v"),
            (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        ),
        "about",
    )
    out = rows.join(about, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("v")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
e as (
  select a.vec_id as x, b.vec_id as y
  from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.93
),
r(vec_id, reach) as (
  select vec_id, vec_id from embeddings
  union
  select r.vec_id, e.y from r join e on r.reach = e.x
),
c as (select vec_id, min(reach) as component_id from r group by vec_id),
n as (select x, count(*) as n from e group by x)
select c.vec_id, coalesce(n.n, 0) as n_links, c.component_id, c.vec_id = c.component_id as kept
from c left join n on n.x = c.vec_id
"""
