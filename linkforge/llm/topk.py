"""Exact top-k inner products pruned by multi-resolution segment statistics.

Vectors are quantised to integers, floor(1024 x). A bounded sample gives a centre and an orthogonal
rotation (principal axes, the strongest first); neither changes an inner product but by terms of one
vector each, and both make the leading coordinates tell vectors apart. For a segment of length L with
means m, n and deviations s, t the squared distance of two vectors is at least
L ((m - n)^2 + (s - t)^2), so their inner product is at most L (m n + s t) there; the sum over
segments bounds the score from above. Segments grow with the coordinates they lie on: the first
level has segments of 1, 1, 2, 4, 8, ... coordinates, the next level cuts each of them into four. A
candidate is dropped once its bound is below the query's k-th best score so far, or below the k-th
best of the sample; each level and the exact score are computed for survivors only.

Queries travel to the executors in passes of at most ``PASS_BYTES``, ``WAVE`` passes a job, however
many there are; candidates are read where they lie, none is shuffled, and each task keeps k rows per
query. The passes are merged by a window over the few rows kept.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor rows
with a null id; vectors are compared with those of equal length; a query takes no candidate of its
own id; repeated candidate rows are separate candidates, repeated query ids are one query (the
smallest vector); ties go to the smaller id; empty tables give no rows; further columns are ignored.
Components and scores are 64-bit integers; what lies beyond them counts as the nearest one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkforge.llm.arrow import map_arrow
from linkforge.runtime import cut

K = 10
SCALE = 1024
#: Bytes of quantised queries that one pass carries to the executors, and passes in one job.
PASS_BYTES, WAVE = 8 << 20, 16
#: Candidates that the rotation is fitted on and that give the first floors.
FIT_ROWS = 4096
BLOCK = 4096
QUERY_BLOCK = 512
#: Share of pairs from which on a level is computed as a matrix product and not pair by pair.
DENSE = 1 / 16
SEED = 17
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
SCHEMA = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): integer vectors of the rows that take part."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    good = F.col(embedding).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return vectors.where(F.coalesce(good, F.lit(False)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v")
    )


@dataclass
class Frame:
    """Centre and axes of vectors of one length, and the sample that they come from."""

    centre: np.ndarray
    axes: np.ndarray
    ids: np.ndarray
    sample: np.ndarray

    @classmethod
    def fit(cls, ids: np.ndarray, v: np.ndarray) -> Frame:
        x = v.astype(np.float64)
        centre = x.mean(axis=0)
        x = x - centre
        scale = np.abs(x).max(initial=0) or 1.0
        _, axes = np.linalg.eigh((x / scale).T @ (x / scale))
        return cls(centre, np.ascontiguousarray(axes[:, ::-1]), ids, v)

    def rotate(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated vectors, and what the centre takes from their inner products."""
        x = v.astype(np.float64)
        return (x - self.centre) @ self.axes, x @ self.centre


def levels(d: int) -> list[np.ndarray]:
    """Where the segments of every level begin, coarse to fine."""
    coarse = [0] + [1 << i for i in range(d.bit_length()) if 1 << i < d]
    fine = sorted({a + (b - a) * i // 4 for a, b in zip(coarse, [*coarse[1:], d], strict=True) for i in range(4)})
    return [np.array(coarse), np.array(fine)] if len(fine) < d else [np.array(coarse)]


def stats(v: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per vector: sqrt(L) times the mean and the deviation of each segment; dots bound inner products."""
    size = np.diff([*starts, v.shape[1]])
    total = np.add.reduceat(v, starts, axis=1)
    spread = np.add.reduceat(v * v, starts, axis=1) - total**2 / size
    return np.concatenate([total / np.sqrt(size), np.sqrt(np.maximum(spread[:, size > 1], 0))], axis=1)


class Block:
    """Vectors with their statistics in a frame."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, frame: Frame):
        self.ids, self.v = ids, v.astype(np.float64)
        self.whole = v
        turned, self.shift = frame.rotate(v)
        self.levels = [stats(turned, s) for s in levels(v.shape[1])]
        self.norm = np.sqrt((self.v**2).sum(axis=1)) + np.sqrt((frame.centre**2).sum())


def _dots(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``r`` of a and ``c`` of b, pair by pair."""
    dots = [np.einsum("ij,ij->i", a[r[i : i + 65_536]], b[c[i : i + 65_536]]) for i in range(0, len(r), 65_536)]
    return np.concatenate(dots) if dots else np.zeros(0)


class Best:
    """The k best candidates so far of a block of queries."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, frame: Frame):
        self.own, self.k = Block(ids, v, frame), k
        self.constant = float((frame.centre**2).sum())
        self.score = np.full((len(ids), k), _LOW)
        self.vec = np.full((len(ids), k), _HIGH)
        self.pairs, self.left = 0, [0] * len(self.own.levels)  # pairs met, and pairs alive after each level
        sample = frame.sample.astype(np.float64)
        scores = np.where(ids[:, None] == frame.ids[None, :], -np.inf, self.own.v @ sample.T)
        self.floor = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(ids), -np.inf)
        self.floor = self.floor - 1e-9 * self.own.norm * np.sqrt((sample**2).sum(axis=1)).max(initial=0)

    def add(self, other: Block) -> None:
        own = self.own
        floor = np.maximum(self.floor, self.score[:, -1].astype(np.float64))[:, None]
        alive = own.ids[:, None] != other.ids[None, :]
        before, self.pairs = self.pairs, self.pairs + int(np.count_nonzero(alive))
        # Rounding of a deviation is of the order of the root of the machine's precision.
        rest = (own.shift[:, None] + other.shift[None, :]) - self.constant + 1e-7 * own.norm[:, None] * other.norm[None, :] + 1e-6 - floor
        live = self.pairs - before
        for i, (mine, theirs) in enumerate(zip(own.levels, other.levels, strict=True)):
            if live > DENSE * alive.size:
                alive &= mine @ theirs.T + rest >= 0
                live = int(np.count_nonzero(alive))
            else:
                r, c = np.nonzero(alive)
                out = _dots(mine, theirs, r, c) + rest[r, c] < 0
                alive[r[out], c[out]] = False
                live -= int(np.count_nonzero(out))
            self.left[i] += live
        if own.norm.max(initial=0) * other.norm.max(initial=0) >= 2**52:  # beyond what doubles hold exactly
            r, c = np.nonzero(alive)
            dots = [sum(x * y for x, y in zip(own.whole[i].tolist(), other.whole[j].tolist(), strict=True)) for i, j in zip(r.tolist(), c.tolist(), strict=True)]
            exact = np.array([min(max(x, _LOW + 1), _HIGH) for x in dots], np.int64)
        elif live > DENSE * alive.size:
            part = own.v @ other.v.T
            r, c = np.nonzero(alive & (part >= floor))
            exact = part[r, c].astype(np.int64)
        else:
            r, c = np.nonzero(alive)
            exact = _dots(own.v, other.v, r, c).astype(np.int64)
        hit = exact >= self.score[r, -1]
        r, c, exact = r[hit], c[hit], exact[hit]
        if not len(r):
            return
        rows, starts = np.unique(r, return_index=True)
        for q, a, b in zip(rows.tolist(), starts.tolist(), [*starts[1:].tolist(), len(r)], strict=True):
            score, vec = exact[a:b], other.ids[c[a:b]]
            if len(score) > 4 * self.k:
                top = score >= np.partition(score, -self.k)[-self.k]
                score, vec = score[top], vec[top]
            score, vec = np.concatenate([self.score[q], score]), np.concatenate([self.vec[q], vec])
            order = np.lexsort((vec, ~score))[: self.k]  # ~ turns the order round without leaving the range
            self.score[q], self.vec[q] = score[order], vec[order]

    def batch(self) -> pa.RecordBatch:
        q, j = np.nonzero(self.score != _LOW)
        return pa.RecordBatch.from_arrays([pa.array(self.own.ids[q]), pa.array(self.vec[q, j]), pa.array(self.score[q, j])], names=["query_id", "vec_id", "score"])


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) per vector length of a batch."""
    ids, lists = batch.column(0).to_numpy(), batch.column(1)
    offsets = lists.offsets.to_numpy()
    sizes, flat = np.diff(offsets), lists.values.to_numpy()
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        if d:
            yield ids[rows], flat[offsets[rows][:, None] + np.arange(d)]


def _collected(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) by vector length of a bounded table (vec_id, v)."""
    table = rows.toArrow().combine_chunks()
    return {v.shape[1]: (ids, v) for batch in table.to_batches() for ids, v in _matrices(batch)}


def frames(candidates: DataFrame, rows: int = FIT_ROWS) -> dict[int, Frame]:
    """A frame per vector length, fitted on at most ``rows`` candidates chosen by a hash of the id."""
    picked = candidates.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id", "v").limit(rows)
    return {d: Frame.fit(ids, v) for d, (ids, v) in _collected(picked.select("vec_id", "v")).items()}


def _pass(candidates: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], fitted: dict[int, Frame], k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, of = {}, {}
        for d, (ids, v) in queries.items():
            of[d] = fitted.get(d) or Frame(np.zeros(d), np.eye(d), ids[:0], v[:0])
            best[d] = [Best(ids[a : a + QUERY_BLOCK], v[a : a + QUERY_BLOCK], k, of[d]) for a in range(0, len(ids), QUERY_BLOCK)]
        for batch in batches:
            for ids, v in _matrices(batch):
                for at in range(0, len(ids) if v.shape[1] in best else 0, BLOCK):
                    block = Block(ids[at : at + BLOCK], v[at : at + BLOCK], of[v.shape[1]])
                    for b in best[v.shape[1]]:
                        b.add(block)
        for b in (b for own in best.values() for b in own):
            yield b.batch()

    return map_arrow(candidates, run, SCHEMA)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query (``quantised`` tables)."""
    one = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    one = cut(one.withColumn("h", F.xxhash64("vec_id")), "queries")
    size = one.agg(F.sum(F.size("v") * 8 + 16)).first()[0] or 0
    passes = -(-size // pass_bytes) or 1
    candidates = cut(candidates, "vectors") if passes > 1 else candidates
    fitted = frames(candidates)
    kept = None
    for first in range(0, passes, WAVE):
        wave = None
        for p in range(first, min(passes, first + WAVE)):
            part = _pass(candidates, _collected(one.where(F.pmod("h", F.lit(passes)) == p).select("vec_id", "v")), fitted, k)
            wave = part if wave is None else wave.unionAll(part)
        wave = cut(wave, "best")
        kept = wave if kept is None else kept.unionAll(wave)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(rows.where(F.col("vec_id") % 100 == 0), rows)


ORACLE = """
with q as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select a.vec_id as query_id, b.vec_id as vec_id,
         cast(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) as bigint) as score
  from q a join q b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where a.vec_id % 100 = 0
),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""
