"""Sharding by fixed virtual slots.

Records are hashed by content into ``SLOTS`` virtual slots, so equal texts share a slot. Bytes are
added up per slot, and a versioned map assigns slots to shards: the heaviest slot goes to the
lightest shard. A group of equal texts above ``1 / APART`` of a shard's fair share is a part of its
own, so that it weighs on no neighbour; at most ``APART`` groups a shard can be that heavy. Only a
group that alone exceeds a whole fair share is dealt out, by record id, as no shard could hold it. The
map is stored as rows (version, vslot, part, shard), is bounded by the number of slots whatever the
data, and is edited, not rebuilt, when shards are added or weights drift: an edit writes the next
version and moves as few slots as it needs.

The law is ``bytes``: shard sizes are near equal (a single record larger than a shard's fair share
is the only exception). Places within a shard are counted in two levels, by bounded chunks of a slot
and then within them, so a slot of very many small records is spread over many tasks.

Defined cases: a null text has no bytes, weighs 16 and its text's CRC is that of the empty string;
repeated rows are separate records; null ids hash like any value; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkforge.runtime import cut, exists, new_path

SHARDS = 40
SLOTS = 8192
#: A group of equal texts heavier than this part of a shard's fair share is placed on its own.
APART = 16
#: Parts per fair share that a group too heavy for one shard is dealt into.
DEAL = 4
#: Records of a slot that are numbered together.
CHUNK = 65_536
OVERHEAD = 16
MAP_SCHEMA = "version int, vslot int, part int, shard int"
Weights = dict[tuple[int, int], tuple[int, int]]
Assignment = dict[tuple[int, int], int]


def records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, salt, content, vslot): one narrow row per record."""
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        doc_id,
        (F.octet_length(content) + OVERHEAD).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.xxhash64(doc_id, F.octet_length(content)).alias("salt"),
        F.xxhash64(content).alias("content"),
    ).withColumn("vslot", F.pmod("content", F.lit(slots)).cast("int"))


def with_parts(recs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``recs`` with ``part``: 0, or a number of its own for a heavy group of equal texts (several if no shard can hold it)."""
    fair = max(1, (recs.agg(F.sum("size")).first()[0] or 0) / shards)
    groups = recs.groupBy("content", "vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    heavy = groups.where((F.col("b") * APART > fair) & (F.col("n") > 1)).collect()  # at most APART * shards rows
    rows, used = [], defaultdict(lambda: 1)
    for r in sorted(heavy, key=lambda r: (r["vslot"], r["content"])):
        parts = math.ceil(DEAL * r["b"] / fair) if r["b"] > fair else 1
        rows.append((r["content"], used[r["vslot"]], parts))
        used[r["vslot"]] += parts
    if not rows:
        return recs.withColumn("part", F.lit(0))
    own = F.broadcast(recs.sparkSession.createDataFrame(rows, "content long, base int, parts int"))
    part = F.coalesce(F.col("base") + F.pmod("salt", F.col("parts")), F.lit(0)).cast("int")
    return recs.join(own, "content", "left").withColumn("part", part).drop("base", "parts")


def slot_weights(recs: DataFrame) -> Weights:
    """Bytes and rows of every slot part; bounded by the slots, not by the data."""
    rows = recs.groupBy("vslot", "part").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return {(r["vslot"], r["part"]): (r["b"], r["n"]) for r in rows}


def assign(weights: Weights, shards: int = SHARDS) -> Assignment:
    """The first map: the heaviest slot to the lightest shard, ties by slot and shard number."""
    heap = [(0, s) for s in range(shards)]
    out: Assignment = {}
    for key in sorted(weights, key=lambda k: (-weights[k][0], k)):
        load, s = heapq.heappop(heap)
        out[key] = s
        heapq.heappush(heap, (load + weights[key][0], s))
    return out


def rebalance(weights: Weights, old: Assignment, shards: int, tolerance: float = 0.003) -> Assignment:
    """An edited map: slots move only out of shards above the fair share, into those below it."""
    out = {k: old[k] for k in old if old[k] < shards}
    load = defaultdict(int)
    held: dict[int, list] = defaultdict(list)
    for k, s in out.items():
        load[s] += weights.get(k, (0, 0))[0]
        held[s].append(k)
    fair = sum(w[0] for w in weights.values()) / max(1, shards)
    loose = [k for k in weights if k not in out]
    for s in sorted(held):
        for k in sorted(held[s], key=lambda k: (-weights.get(k, (0, 0))[0], k)):  # the largest that fit, so few move
            w = weights.get(k, (0, 0))[0]
            if load[s] <= fair * (1 + tolerance):
                break
            if load[s] - w >= fair * (1 - tolerance):
                load[s] -= w
                loose.append(k)
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for k in sorted(loose, key=lambda k: (-weights.get(k, (0, 0))[0], k)):
        size, s = heapq.heappop(heap)
        out[k] = s
        heapq.heappush(heap, (size + weights.get(k, (0, 0))[0], s))
    return out


def map_table(spark, assignment: Assignment, version: int = 1) -> DataFrame:
    return spark.createDataFrame([(version, v, p, s) for (v, p), s in sorted(assignment.items())], MAP_SCHEMA)


def store_map(spark, assignment: Assignment, path: str, version: int) -> None:
    """Append one version of the map at ``path``; earlier versions stay readable."""
    map_table(spark, assignment, version).coalesce(1).write.mode("append").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> tuple[int, Assignment]:
    """A version of the stored map, the latest by default."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    version = (table.agg(F.max("version")).first()[0] or 0) if version is None else version
    return version, {(r["vslot"], r["part"]): r["shard"] for r in table.where(F.col("version") == version).collect()}


def place(recs: DataFrame, assignment: Assignment, weights: Weights, version: int = 1) -> DataFrame:
    """Each record's shard and its place there, gapless from 0: by slot, then by id within the slot."""
    start: dict[tuple[int, int], int] = {}
    filled: dict[int, int] = defaultdict(int)
    for key in sorted(weights):
        start[key] = filled[assignment[key]]
        filled[assignment[key]] += weights[key][1]
    rows = [(v, p, assignment[v, p], at, -(-weights[v, p][1] // CHUNK)) for (v, p), at in start.items()]
    where = F.broadcast(recs.sparkSession.createDataFrame(rows, "vslot int, part int, shard int, first long, chunks int"))  # one row per slot part
    own = recs.join(where, ["vslot", "part"]).withColumn("chunk", F.pmod("salt", F.col("chunks")))
    chunks = own.where("chunks > 1").groupBy("vslot", "part", "chunk").count()  # rows / CHUNK of them
    before = F.sum("count").over(Window.partitionBy("vslot", "part").orderBy("chunk")) - F.col("count")
    chunks = chunks.withColumn("before", before).drop("count")
    within = Window.partitionBy("vslot", "part", "chunk").orderBy("salt", *[c for c in recs.columns if c not in ("vslot", "part", "salt")])
    return (
        own.withColumn("rank", F.row_number().over(within) - 1)
        .join(chunks, ["vslot", "part", "chunk"], "left")
        .withColumn("slot", F.col("first") + F.coalesce("before", F.lit(0)) + F.col("rank"))
        .withColumn("map_version", F.lit(version))
    )


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", map_path: str | None = None) -> DataFrame:
    """All records with their shard by the stored map at ``map_path``.

    Where there is no map yet (or no path is given), the first one is made; otherwise its latest
    version is used, or edited into the next one if it no longer fits the weights or the shards.
    """
    spark = docs.sparkSession
    recs = with_parts(cut(records(docs, doc_id, text), "records"), shards)
    weights = slot_weights(recs)
    path = map_path or new_path(spark, "map")
    version, old = load_map(spark, path) if exists(spark, path) else (0, None)
    new = assign(weights, shards) if old is None else rebalance(weights, old, shards)
    if new != old:
        version += 1
        store_map(spark, new, path, version)
    version, assignment = load_map(spark, path, version)
    return place(recs, assignment, weights, version)


def query(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "part", "map_version"
    )
