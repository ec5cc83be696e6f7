"""Near duplicates by Jaccard similarity of word shingles, exact and without losing a pair.

A text is the set of hashes of its runs of ``SHINGLE`` words. SimHash fingerprints of these hashes
are compared bit-sliced first (``simhash.fingerprint_links``), which proposes most links of large
groups at the price of one comparison a text; a proposal counts only if the whole sets are similar.
The rest is found by prefixes: all texts order their hashes alike (those that a sample shows to be
common come last, the more common the later), and two sets of similarity ``SIMILARITY`` or more
share a hash among the first ``n - ceil(SIMILARITY * n) + 1`` of each, so joining on these keys loses
no pair; the sample changes the work only, never the result. In every key all sets are first compared
with the one that holds most of what others hold; of what is not yet connected, a pair is compared
whole only if the keys it shares leave room for similarity. Pairs of small keys come from a join,
those of crowded keys from matrix products over pairs of bounded chunks. Equal sets are collapsed first.

Whole sets are fetched for the candidates alone, by a second reading of the texts, so no text is
shuffled before the rows to keep are chosen.

Defined cases: words are split at ASCII white space and ASCII letters are lowered; a text of fewer
words than a shingle is one shingle; null and blank texts are equal empty sets; repeated rows share a
class; null ids come last; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.llm import simhash
from linkforge.llm.arrow import map_arrow, map_texts, runs
from linkforge.operators.components import connected_components
from linkforge.runtime import cut, discard

SHINGLE = 5
SEED = 42
#: The least similarity as a fraction, so that it is compared in whole numbers.
SIMILARITY = (4, 5)
#: Rows looked at for common hashes, and the common hashes kept at most.
SAMPLE, COMMON = 10_000, 100_000
#: Keys of more sets are crowded; so many sets of a crowded key are compared with as many at once.
CROWD, CHUNK = 32, 1024
#: Bits of the filter that leaves most texts out of the second reading, in words of 4,096 bytes.
FILTER_BITS = 1 << 26
_WORD_BITS = 32_768
#: Sets that a task remembers while it compares pairs.
REMEMBERED = 64
#: Names that no table of documents has.
_ID, _CONTENT = simhash._ID, simhash._CONTENT


def hashes(text: str, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of a whole text's word shingles in order, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    ends = ends[shingle - 1 :].tolist() or [len(joined) + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends, strict=False)], np.uint64)


def shingles(text: str, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of a whole text's word shingles."""
    return np.unique(hashes(text, shingle, seed).view(np.int64))


def _node(own: np.ndarray) -> int:
    """Name of a set."""
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def _common(docs: DataFrame, doc_id: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes that several sampled rows hold, and the place of each by frequency."""
    every = max(1, docs.count() // SAMPLE)
    picked = docs.where(F.pmod(F.xxhash64(doc_id, text), F.lit(every)) == 0)
    held = map_texts(picked, lambda t: (shingles(t),), [], text, "hashes array<long>", ["hashes"], [pa.list_(pa.int64())])
    counts = held.select(F.explode("hashes").alias("h")).groupBy("h").count().where("count > 2")
    found = np.array([r["h"] for r in counts.orderBy(F.desc("count"), "h").limit(COMMON).collect()], np.int64)
    order = np.argsort(found)
    return found[order], (len(found) - order).astype(np.int64)


def _keys(own: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The hashes of a set of which a similar set must share one."""
    p, q = SIMILARITY
    known, place = common
    if len(known):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        late = known[at] == own
        last = own[late][np.argsort(place[at[late]], kind="stable")]
        own = np.concatenate([own[~late], last])
    return own[: len(own) - -(-p * len(own) // q) + 1]


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar; texts travel packed, which is far less than their hashes."""
    p, q = SIMILARITY
    a, b = (sets.select(F.col("node").alias(s), F.col("packed").alias(f"text_{s}")) for s in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def own(node: int, packed: pa.Scalar) -> np.ndarray:
            found = known.pop(node, None)
            if found is None:
                found = shingles(zlib.decompress(packed.as_py()).decode("utf-8", "surrogatepass"))
                if len(known) >= REMEMBERED:
                    del known[next(iter(known))]  # the one used longest ago
            known[node] = found
            return found

        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                one, two = own(x, batch.column(2)[i]), own(y, batch.column(3)[i])
                shared = len(np.intersect1d(one, two, assume_unique=True))
                if shared * (p + q) >= (len(one) + len(two)) * p:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return map_arrow(both, run, "a long, b long")


def _fits() -> Column:
    """Whether sets of sizes n_x and n_y can be similar."""
    p, q = SIMILARITY
    return F.least("n_x", "n_y") * q >= F.greatest("n_x", "n_y") * p


def _room() -> Column:
    """Whether sets that share ``shared`` keys can be similar: beyond its keys one of them has nothing but its tail."""
    p, q = SIMILARITY
    tail = F.ceil(F.greatest("n_x", "n_y") * p / q) - 1
    return (F.col("shared") + tail) * (p + q) >= (F.col("n_x") + F.col("n_y")) * p


def _open(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of the keys whose sets are not all known to be connected, with what each set belongs to (member,
    component) and how many sets hold the key."""
    now = blocks.join(parts, blocks.node == parts.member, "left").withColumn("of", F.coalesce("component", "node")).drop("member", "component")
    mixed = now.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high"), F.count(F.lit(1)).alias("many")).where("low < high").select("key", "many")
    return now.join(mixed, "key")


def _block_pairs(t: pa.Table) -> pa.RecordBatch | None:
    """Pairs of one crowded key's sets, or of one pair of its chunks, that the keys they share leave room for."""
    p, q = SIMILARITY
    t = t.combine_chunks()
    key, across = t.column("key")[0].as_py(), t.column("p")[0].as_py() != t.column("q")[0].as_py()
    node, n, of, own, other = (t.column(c).to_numpy() for c in ("node", "n", "of", "own", "others"))
    lists = t.column("crowded").chunk(0)
    row, flat = np.repeat(np.arange(len(node)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    values, column, held = np.unique(flat, return_inverse=True, return_counts=True)
    shared, before = (np.zeros((len(node), len(node)), np.float32) for _ in range(2))
    wanted = np.flatnonzero(held > 1)
    for at in range(0, len(wanted), CHUNK):
        part = wanted[at : at + CHUNK]
        place = np.full(len(values), -1)
        place[part] = np.arange(len(part))
        some = place[column] >= 0
        grid = np.zeros((len(node), len(part)), np.float32)
        grid[row[some], place[column[some]]] = 1
        shared += grid @ grid.T
        early = grid[:, values[part] < key]
        if early.shape[1]:
            before += early @ early.T
    least, most = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    tail = -(-most * p // q) - 1
    room = (shared + np.minimum(other[:, None], other[None, :]) + tail) * (p + q) >= (least + most) * p
    hit = (of[:, None] < of[None, :]) & (before == 0) & (least * q >= most * p) & room  # a pair counts where its first crowded key is
    if across:
        hit &= own[:, None] != own[None, :]
    x, y = np.nonzero(hit)
    cols = [node[x], n[x], node[y], n[y], shared[x, y].astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["x", "n_x", "y", "n_y", "shared"]) if len(x) else None


def _crowded(rows: DataFrame) -> DataFrame:
    """(x, n_x, y, n_y, shared): unconnected pairs that meet in crowded keys, with the crowded keys they share.

    A key's sets are dealt out as pairs of chunks and compared there all at once, by a product of their
    incidence with crowded keys; what leaves a task is only what may be similar, once a pair.
    """
    crowd = F.col("many") > CROWD
    held = rows.groupBy("node").agg(F.collect_list(F.when(crowd, F.col("key"))).alias("crowded"), F.count_if(~crowd).alias("others"))
    parts = F.ceil(F.col("many") / CHUNK).cast("int")
    dealt = (
        rows.where(crowd)
        .join(held, "node")
        .withColumn("own", F.pmod(F.xxhash64("node"), parts).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("key", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"), "node", "n", "of", "own", "others", "crowded")
    )
    order = ["key", "p", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, order, CHUNK):
            change = np.ones(table.num_rows, bool)
            change[1:] = np.any([(v := table.column(c).to_numpy())[1:] != v[:-1] for c in order], axis=0)
            starts = np.append(np.flatnonzero(change), table.num_rows).tolist()
            for i, j in zip(starts, starts[1:], strict=False):
                if (out := _block_pairs(table.slice(i, j - i))) is not None:
                    yield out

    return map_arrow(dealt.repartition(*order).sortWithinPartitions(*order), run, "x long, n_x long, y long, n_y long, shared long")


def _proposals(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are equal or linked, as a forest."""
    of = cut(nodes.groupBy("fp").agg(F.min("node").alias("low")), "prints")
    equal = nodes.join(of, "fp").where("node > low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    near = simhash.fingerprint_links(of)
    one, two = (of.select(F.col("fp").alias(s), F.col("low").alias(f"low_{s}")) for s in "ab")
    linked = near.join(one, "a").join(two, "b").select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b"))
    return equal.unionAll(linked)


def _links(blocks: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): links that connect exactly the similar sets that share a key; ``links`` are known ones."""
    stars = links.groupBy(F.col("b").alias("member")).agg(F.min("a").alias("component"))  # members of one star are connected
    rows = cut(_open(blocks, stars), "star")
    heft = rows.groupBy("node").agg(F.sum("many").alias("heft"))  # the least edited of many copies holds most of what they share
    centre = rows.join(heft, "node").groupBy("key").agg(F.max(F.struct("heft", "node", "n", "of")).alias("c"))
    sides = rows.join(centre, "key").where(F.col("of") != F.col("c.of")).select(F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("c.node").alias("y"), F.col("c.n").alias("n_y"))
    pairs = cut(sides.where(_fits()).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    links = cut(links.unionAll(_similar(pairs, sets)), "links")
    parts = cut(connected_components(links, "a", "b"), "parts").withColumnRenamed("node", "member")
    rows = cut(_open(blocks, parts), "open")
    few = rows.where(F.col("many") <= CROWD)
    one, two = (few.select("key", F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("of").alias(f"of_{s}")) for s in "xy")
    met = one.join(two, "key").where("of_x < of_y").where(_fits()).select("x", "n_x", "y", "n_y", F.lit(1).cast("long").alias("shared"))
    met = met.unionByName(_crowded(rows)).groupBy("x", "n_x", "y", "n_y").agg(F.sum("shared").alias("shared"))
    pairs = cut(met.where(_room()).select(F.col("x").alias("a"), F.col("y").alias("b")), "pairs")
    return links.unionAll(_similar(pairs, sets))


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, packed) of the wanted (id, content), the words of the text compressed: a second reading that skips texts by a filter.

    The filter is a bit map of fixed size over ids and contents; whatever it lets through beside the
    wanted rows costs work but changes nothing.
    """
    place = F.pmod(F.xxhash64(F.col(_ID), F.col(_CONTENT)), F.lit(FILTER_BITS))
    words = wanted.select(place.alias("h")).groupBy(F.floor(F.col("h") / _WORD_BITS).alias("word")).agg(F.bitmap_construct_agg(F.col("h") % _WORD_BITS).alias("bits"))
    bits = bytearray(FILTER_BITS // 8)
    for r in words.collect():  # FILTER_BITS in all, whatever the data
        bits[r["word"] * _WORD_BITS // 8 : (r["word"] + 1) * _WORD_BITS // 8] = r["bits"]
    bits = docs.sparkSession.sparkContext.broadcast(bytes(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            h = batch.column(0).to_numpy()
            for i in np.flatnonzero(known[h >> 3] >> (h & 7) & 1).tolist():
                words = (batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                packed = zlib.compress(b" ".join(words), 6)
                own = shingles(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([pa.array([_node(own)]), pa.array([packed], pa.binary())], names=["node", "packed"])

    content = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    read = docs.select(F.pmod(F.xxhash64(F.col(doc_id), content), F.lit(FILTER_BITS)).alias("h"), text)
    return map_arrow(read, run, "node long, packed binary").dropDuplicates(["node"])


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct set: the class it belongs to, and id and content of its first row."""
    common = _common(docs, doc_id, text)

    def measure(t: str) -> tuple:
        every = hashes(t)
        own = np.unique(every.view(np.int64))
        return _node(own), len(own), simhash.majority(every), _keys(own, common)

    kind = docs.schema[doc_id].dataType.simpleString()
    content = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("content")
    names, types = ["node", "n", "fp", "keys"], [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    schema = f"`{doc_id}` {kind}, content long, node long, n long, fp long, keys array<long>"
    prints = cut(map_texts(docs.select(doc_id, content, text), measure, [doc_id, "content"], text, schema, names, types), "prints")
    first = F.struct(F.col(doc_id).isNull().alias("unknown"), F.col(doc_id).alias("id"), "content", "n", "fp", "keys")
    nodes = cut(prints.groupBy("node").agg(F.min(first).alias("best")).select("node", "best.*"), "nodes")
    discard(prints)
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("key"), "shared")
    blocks = cut(keyed.join(shared, "key"), "blocks")
    narrow = cut(nodes.select("node", "fp", "unknown", "id", "content"), "narrow")
    discard(nodes)
    proposals = cut(_proposals(narrow.select("node", "fp")), "proposals")
    used = blocks.select("node").unionAll(proposals.select("a")).unionAll(proposals.select("b")).distinct()
    wanted = narrow.join(used, "node", "left_semi").select(F.col("id").alias(_ID), F.col("content").alias(_CONTENT))
    sets = cut(_sets(docs, wanted, doc_id, text), "sets")
    known = cut(_similar(proposals, sets), "links")
    linked = connected_components(cut(_links(blocks, sets, known), "links"), "a", "b").withColumnRenamed("node", "member")
    of = cut(narrow.join(linked, narrow.node == linked.member, "left").select("node", F.coalesce("component", "node").alias("class"), "unknown", "id", "content"), "classes")
    for table in (shared, blocks, narrow, proposals, sets, known):
        discard(table)
    return of


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class: the one of the smallest id (rows without an id last)."""
    best = classes(docs, doc_id, text).groupBy("class").agg(F.min(F.struct("unknown", "id", "content")).alias("best"))
    return simhash.keep_rows(docs, best.select("best.id", "best.content"), doc_id, text)
