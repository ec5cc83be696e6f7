"""SimHash near duplicates by bit-sliced comparison.

Every text becomes a 64-bit fingerprint. Distinct fingerprints are cut into ``BLOCKS`` bit blocks;
two that differ in at most ``RADIUS`` bits agree in at least ``BLOCKS - RADIUS`` blocks, so they
share one of the ``C(BLOCKS, BLOCKS - RADIUS)`` keys made of that many blocks and no link is lost.
Inside a key the fingerprints are stored vertically (one word per bit and 64 rows); distances of one
row to 64 others are counted at once by carry-save adders, and a block is abandoned as soon as all
its counters passed the radius. Keys with more than ``CHUNK`` fingerprints are dealt out as pairs of
chunks, so no task holds more than two chunks of a key. Links leave a task as a spanning forest.

Defined cases: a null or blank text has fingerprint 0; repeated rows share a fingerprint and a
class; a null ``doc_id`` is ignored when a class's smallest id is sought (null only if the class has
no id); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.llm.arrow import forest, map_arrow, map_texts, runs
from linkforge.operators.components import connected_components
from linkforge.runtime import cut

SHINGLE = 3
SEED = 42
RADIUS = 3
BLOCKS = 5
CHUNK = 2048
#: Rows that one bit-sliced pass takes together.
PASS_ROWS = 32_768
#: Names that no table of documents has.
_ID, _CONTENT = "__linkforge_id", "__linkforge_content"
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed integer."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(raw[at : at + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((ones * 2 > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a whole text, as a signed integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]]).tolist()
        hashes = np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)], np.uint64)
    return majority(hashes)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, content, fp): the fingerprint of every row's whole text."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return map_texts(docs, lambda t: (fingerprint(t),), [doc_id, "content"], text, f"`{doc_id}` {kind}, content long, fp long", ["fp"], [pa.int64()])


def key_column(fp: Column, blocks: int = BLOCKS, radius: int = RADIUS) -> Column:
    """Array of one key per choice of ``blocks - radius`` blocks: the chosen bits, tagged by the choice."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(masks[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(n).alias("table"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("bits")))
    return F.array(*keys)


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes (64, words) of the rows; row r is bit r % 64 of word r // 64."""
    n = -len(fps) % 64
    bits = np.unpackbits(np.concatenate([fps, np.zeros(n, np.uint64)]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8").reshape(64, -1)


def near(planes: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Packed rows within ``radius`` bits of each query: (queries, words); ``radius`` is below 4.

    ``planes`` is (64, words), or (64, queries) with one word of rows per query.
    """
    wide = planes.shape[1] if planes.ndim == 2 else planes.shape[2]
    one = np.zeros((len(queries), wide), np.uint64)
    two, over = one.copy(), one.copy()
    for plane in range(64):
        flip = np.where(queries >> np.uint64(plane) & np.uint64(1), _ONES, np.uint64(0))[:, None]
        differs = planes[plane] ^ flip
        carry = one & differs
        one ^= differs
        over |= two & carry
        two ^= carry
        if plane % 8 == 7 and (over == _ONES).all():
            return np.zeros_like(over)  # every lane is beyond the radius: abandon the block
    if radius < 3:
        over |= two & one if radius == 2 else two | (one if radius == 0 else np.uint64(0))
    return ~over


def _small_runs(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Linked row pairs of runs of at most 64 rows, all runs of similar size side by side."""
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for low, high in ((2, 2), (3, 4), (5, 8), (9, 16), (17, 32), (33, 64)):
        chosen = np.flatnonzero((sizes >= low) & (sizes <= high))
        for at in range(0, len(chosen), 4096):
            own = chosen[at : at + 4096]
            first, size = starts[own], sizes[own]
            rows = np.minimum(first[:, None] + np.arange(64), (first + size - 1)[:, None])
            bits = np.unpackbits(fps[rows].astype("<u8").view(np.uint8).reshape(len(own), 64, 8), axis=2, bitorder="little")
            planes = np.packbits(bits.transpose(2, 0, 1).copy(), axis=2, bitorder="little").view("<u8").reshape(64, len(own), 1)
            for k in range(high - 1):
                live = np.flatnonzero(size > k + 1)
                if not len(live):
                    break
                hit = near(planes[:, live], fps[first[live] + k], radius)[:, 0]
                later = hit & (_ONES << np.uint64(k + 1))
                some = np.flatnonzero(later)
                if len(some):
                    lanes = np.unpackbits(later[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    i, j = np.nonzero(lanes)
                    fits = j < size[live][some][i]
                    base = first[live][some][i[fits]]
                    pairs.append((base + k, base + j[fits]))
    return [(int(x), int(y)) for a, b in pairs for x, y in zip(a, b, strict=True)]


def _large_run(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    planes = _planes(fps)
    n = len(fps)
    packed = np.zeros((n, planes.shape[1] * 8), np.uint8)
    for at in range(0, n, 256):
        packed[at : at + 256] = near(planes, fps[at : at + 256], radius).astype("<u8").view(np.uint8).reshape(-1, planes.shape[1] * 8)
    spare = np.packbits((np.arange(planes.shape[1] * 64) < n).astype(np.uint8), bitorder="little")
    packed &= spare
    return forest(packed, n)


def links_in_runs(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Row pairs that connect, run by run, all rows within ``radius`` bits of each other."""
    found = _small_runs(fps, starts, sizes, radius)
    for start, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        found += [(a + start, b + start) for a, b in _large_run(fps[start : start + size], radius)]
    return found


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints (column ``fp``) within ``radius`` bits."""
    keyed = distinct.select("fp", F.explode(key_column(F.col("fp"), blocks, radius)).alias("k")).select("fp", "k.table", "k.bits")
    sizes = cut(keyed.groupBy("table", "bits").count().where("count > 1"), "keys")
    split = F.ceil(F.col("count") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = (
        keyed.join(sizes.withColumn("parts", split), ["table", "bits"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("table", "bits", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["table", "bits", "x", "y"], PASS_ROWS):
            fps = table.column("fp").to_numpy().view(np.uint64)
            change = np.zeros(len(fps), bool)
            change[0] = True
            for c in ("table", "bits", "x", "y"):
                v = table.column(c).to_numpy()
                change[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(change)
            pairs = links_in_runs(fps, starts, np.diff(np.append(starts, len(fps))), radius)
            if pairs:
                a, b = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], names=["a", "b"])

    order = ["table", "bits", "x", "y"]
    return map_arrow(cells.repartition(*order).sortWithinPartitions(*order), run, "a long, b long")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, content (a hash of the text), fp, class_fp and component_id.

    ``class_fp`` names the class (its smallest fingerprint), ``component_id`` is its smallest id.
    """
    prints = cut(fingerprints(docs.select(doc_id, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("content"), text), doc_id, text), "prints")
    distinct = cut(prints.groupBy("fp").agg(F.min(doc_id).alias("low")), "distinct")
    nodes = connected_components(fingerprint_links(distinct, radius), "a", "b")
    nodes = cut(nodes.join(distinct, nodes.node == distinct.fp).select("fp", F.col("component").alias("class_fp"), "low"), "nodes")
    lows = nodes.groupBy("class_fp").agg(F.min("low").alias("component_id"))
    linked = nodes.join(lows, "class_fp").select("fp", "class_fp", "component_id")
    of = distinct.join(linked, "fp", "left")
    of = cut(of.select("fp", F.coalesce("class_fp", "fp").alias("class_fp"), F.coalesce("component_id", "low").alias("component_id")), "classes")
    return prints.join(of, "fp", "left").select(doc_id, "content", "fp", "class_fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, fp, component_id), the smallest id of its class."""
    return classes(docs, doc_id, text, radius).select(doc_id, "fp", "component_id")


def keep_rows(docs: DataFrame, best: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``best`` (id, content) names, each once.

    Rows move once, to meet the small table. Only rows that occur several times are told apart in a
    second, filtered reading; there are few names of such rows, if any.
    """
    content = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    same = F.col(doc_id).eqNullSafe(F.col(_ID)) & (content == F.col(_CONTENT))
    best = cut(best.select(F.col("id").alias(_ID), F.col("content").alias(_CONTENT)), "best")
    times = docs.select(F.col(doc_id).alias("i"), content.alias("c")).groupBy("i", "c").count().where("count > 1")
    many = cut(best.join(times, F.col(_ID).eqNullSafe(F.col("i")) & (F.col(_CONTENT) == F.col("c")), "left_semi"), "many")
    once = best.join(many.select(F.col(_ID).alias("i"), F.col(_CONTENT).alias("c")), F.col(_ID).eqNullSafe(F.col("i")) & (F.col(_CONTENT) == F.col("c")), "left_anti")
    repeated = docs.join(many, same).dropDuplicates([_ID, _CONTENT]).select(*docs.columns)
    return docs.join(once, same, "left_semi").unionAll(repeated)


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each class: the one of the smallest id (rows without an id last)."""
    first = F.struct(F.col(doc_id).isNull().alias("unknown"), F.col(doc_id).alias("id"), "content")
    best = classes(docs, doc_id, text, radius).groupBy("class_fp").agg(F.min(first).alias("best"))
    return keep_rows(docs, best.select("best.id", "best.content"), doc_id, text)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
