"""Mixing, packing, sharding, embeddings and top-k: against plain versions, and on odd tables."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkforge.llm import embeddings, mixing, packing, sharding, topk
from linkforge.runtime import new_path


# --- mixing ----------------------------------------------------------------------------------


def fill(sizes, weights=(5, 2, 1)):
    """Targets by resharing the excess until none is above three times a source's size."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while len(capped) < len(names):
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(w[s] for s in names if s not in capped)
        new = {s for s in names if s not in capped and level * w[s] > 3 * sizes[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= new
    return {s: 3.0 * sizes[s] for s in names}


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {"a": 40, "b": 4000, "c": 9000, "é": 15, None: 2500}
    rows, i = [], 0
    for s, words in sizes.items():
        left = words
        while left:
            n = min(left, rng.randint(1, max(2, words // 8)))
            rows.append((i, s, "w " * n))
            left, i = left - n, i + 1
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.taken(docs, block_words=64).collect()
    want = fill(sizes)
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    per = Counter()
    for r in got:
        per[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6) and r["source_size"] == sizes[r["source"]]
    assert all(abs(per[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.taken(docs, block_words=64).collect()), key=str)
    slices = mixing.mix(docs, block_words=64).collect()
    words = Counter()
    for r in slices:
        words[r["doc_id"]] += r["to_word"] - r["from_word"]
    assert all(words[r["doc_id"]] == r["taken"] for r in got)
    first = Counter(r["source_no"] for r in slices if r["slot"] < 40)  # low discrepancy: every prefix is near its share
    share = sorted(want.values())
    assert max(first.values()) / 40 == pytest.approx(share[-1] / sum(share), abs=0.35)


def test_point_is_low_discrepancy(spark):
    u = sorted(r[0] for r in spark.range(1000).select(mixing.point(F.col("id"))).collect())
    gaps = np.diff([0, *u, 1])
    assert gaps.max() < 3 / 1000


def test_mixed_documents_and_odd_tables(odd_docs, no_docs):
    got = mixing.taken(odd_docs).collect()
    assert len(got) == odd_docs.count()
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns and out.count() >= 4
    assert mixing.taken(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


# --- packing ---------------------------------------------------------------------------------


def check_plan(counts, plan, cap):
    used = np.zeros_like(counts)
    for pattern, times in plan:
        assert sum(pattern) <= cap and times > 0
        for i in pattern:
            used[i] += times
    assert (used == counts).all()


def optimum(sizes, cap):
    """The fewest bins, by trying all placements."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= cap and bins[j] not in bins[:j]:
                go(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_bin_completion_reaches_the_optimum_of_small_cases():
    rng = random.Random(0)
    worse = 0
    for _ in range(150):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 10))]
        counts = np.bincount(sizes, minlength=21)
        plan = packing.complete(counts, 20)
        check_plan(counts, plan, 20)
        bins, best = sum(t for _, t in plan), optimum(sizes, 20)
        assert packing.lower_bound(counts, 20) <= best <= bins <= sum(t for _, t in packing.best_fit(counts, 20))
        worse += bins > best
    assert worse <= 1


def test_tokenizer_ids_equal_the_library(sf, spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    own, slow = packing.encoder(path), Tokenizer.from_file(path)
    texts = [r[0] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    rng = random.Random(2)
    texts += ["".join(rng.choice("aé ñ\n\t0'sl  <|endoftext|>文😀 -_%") for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    texts += ["", " ", "<|endoftext|> a <|endoftext|>", "it's we'll I'M", "a" * 3000, " \n \n  x"]
    for t in texts:
        assert own(t).tolist() == slow.encode(t, add_special_tokens=False).ids, t


def test_pack_is_gapless_and_whole(spark, odd_docs, no_docs):
    encode = packing.encoder(packing.default_tokenizer())
    rows = packing.pack(odd_docs).collect()
    docs = defaultdict(list)
    for r in odd_docs.collect():
        docs[r["doc_id"]].append(r["text"] or "")
    for i, texts in docs.items():
        ids = np.append(encode(texts[0]), np.uint32(2)).astype("<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: (r["piece"], r["sequence_id"], r["offset"]))
        assert len({r["piece"] for r in own}) * len(texts) == len(own)
        at = 0
        for r in own[:: len(texts)]:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(no_docs).count() == 0


def test_packing_query_covers_all_documents(spark, sf):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.query(spark, sf).collect()
    docs, places = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert docs.keys() == texts.keys()
    for i, t in texts.items():
        ids = np.array([*slow.encode(t, add_special_tokens=False).ids, 2], "<u4")
        own = sorted(docs[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 1024))) and all(r["length"] == 1024 for r in own[1:])
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 1024
    counts = np.bincount([r["length"] for r in rows], minlength=1025)
    assert len(places) <= 1.02 * packing.lower_bound(counts, 1024) + 1


# --- sharding --------------------------------------------------------------------------------


def test_sharding_is_balanced_and_gapless(spark, sf):
    rows = sharding.query(spark, sf).collect()
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in rows)
    assert max(load.values()) <= max(largest, 1.02 * sum(load.values()) / 40)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r["size"] == len((docs[r["doc_id"]] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((docs[r["doc_id"]] or "").encode()) for r in rows)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_equal_texts_share_a_shard(spark, sf, size):
    folder = sf.replace("sf0.001", size)
    rows = sharding.query(spark, folder).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    load, groups = Counter(), defaultdict(list)
    for r in rows:
        load[r["shard"]] += r["size"]
        groups[texts[r["doc_id"]]].append(r)
    fair = sum(load.values()) / sharding.SHARDS
    assert any(len(g) > 1 for g in groups.values())
    for own in groups.values():
        assert len({r["shard"] for r in own}) == 1 or sum(r["size"] for r in own) > fair
    assert max(load.values()) <= max(1.02 * fair, max(r["size"] for r in rows))


def test_sharding_follows_the_stored_map(spark):
    rows = [(i, f"text number {i} " * (i % 7 + 1)) for i in range(3000)]
    docs, path = spark.createDataFrame(rows, "doc_id long, text string"), new_path(spark, "map")
    first = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, 10, map_path=path).collect()}
    again = sharding.shard(docs, 10, map_path=path).collect()
    assert {r["doc_id"]: r["shard"] for r in again} == first and {r["map_version"] for r in again} == {1}
    grown = sharding.shard(docs, 11, map_path=path).collect()
    moved = [r for r in grown if r["shard"] != first[r["doc_id"]]]
    assert {r["map_version"] for r in grown} == {2} and 0 < len(moved) < 3000 / 11 * 1.5
    slots = defaultdict(list)
    for r in grown:
        slots[r["shard"]].append(r["slot"])
    assert len(slots) == 11 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_places_in_a_split_slot_are_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 16)
    docs = spark.createDataFrame([(i, "") for i in range(500)] + [(500, "long " * 9000), (500, "long " * 9000)], "doc_id long, text string")
    slots = defaultdict(list)
    for r in sharding.shard(docs, 3).collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and sum(map(len, slots.values())) == 502


def test_hot_slot_is_split_and_odd_tables(spark, odd_docs, no_docs):
    copies = spark.createDataFrame([(i, "same text " * 40) for i in range(3000)] + [(i, f"other {i}") for i in range(3000, 3300)], "doc_id long, text string")
    rows = sharding.shard(copies).collect()
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) <= 1.1 * sum(load.values()) / 40
    assert sharding.shard(odd_docs).count() == odd_docs.count() and sharding.shard(no_docs).count() == 0


def test_map_is_versioned_and_edited(spark):
    rng = random.Random(1)
    weights = {(v, 0): (rng.randint(1, 100), 1) for v in range(2000)}
    old = sharding.assign(weights, 40)
    new = sharding.rebalance(weights, old, 41)
    moved = [k for k in old if new[k] != old[k]]
    assert sum(new[k] == 40 for k in moved) >= 0.9 * len(moved) and 0 < len(moved) <= 2000 / 41 * 1.5
    load = Counter()
    for k, s in new.items():
        load[s] += weights[k][0]
    fair = sum(load.values()) / 41
    assert len(load) == 41 and max(load.values()) <= 1.03 * fair and min(load.values()) >= 0.9 * fair
    assert sharding.rebalance(weights, old, 40) == old
    path = new_path(spark, "map")
    sharding.store_map(spark, old, path, 1)
    sharding.store_map(spark, new, path, 2)
    assert sharding.load_map(spark, path) == (2, new) and sharding.load_map(spark, path, 1) == (1, old)


# --- embeddings ------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, node long, cell int, v int"


def _vectors(spark, n=400, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    for i in range(0, n, 3):
        base[i] = base[rng.integers(0, n // 6)] + rng.normal(size=dim) * rng.choice([0, 0.01, 0.1, 0.2])
    rows = [(i, [float(np.float32(x)) for x in base[i]], int(rng.integers(0, 3)), 0, 0, 0) for i in range(n)]
    odd = [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [1.0, None], 1), (n + 4, rows[0][1], None), (None, rows[0][1], rows[0][2]), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (n + 8, [float("inf")] * dim, 1)]
    rows += [(*o, 0, 0, 0) for o in odd]
    rows.append(rows[5])
    return spark.createDataFrame(rows, VECTORS), rows


@pytest.mark.parametrize(("chunk", "margin"), [(2048, embeddings.MARGIN), (16, embeddings.MARGIN), (2048, None), (16, None)])
def test_embedding_links_against_brute_force(spark, chunk, margin, monkeypatch):
    table, rows = _vectors(spark)
    monkeypatch.setattr(embeddings.cell_links, "__defaults__", (embeddings.COSINE, chunk))
    got = sorted(embeddings.near_duplicates(table, margin=margin, cell_rows=16).collect(), key=str)
    good = [k for k, r in enumerate(rows) if r[0] is not None and r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links = [(a, b) for a, b in combinations(good, 2) if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and _cos(rows[a][1], rows[b][1]) >= 0.93]
    degree, up = Counter(), {r[0]: r[0] for r in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        degree[a] += 1
        degree[b] += 1
        x, y = find(rows[a][0]), find(rows[b][0])
        up[max(x, y)] = min(x, y)
    want = sorted([(r[0], degree[k], find(r[0]) if r[0] is not None else None, r[0] is not None and find(r[0]) == r[0]) for k, r in enumerate(rows)], key=str)
    found = sum(r["n_links"] for r in got)
    assert found >= 0.99 * sum(degree.values())  # recall; nothing is linked that is not
    if margin is None or found == sum(degree.values()):
        assert sorted(map(tuple, got), key=str) == want


def _cos(a, b):
    a, b = np.array(a, np.float64), np.array(b, np.float64)
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def test_visits_miss_no_pair():
    rng = np.random.default_rng(3)
    x = embeddings._unit(rng.normal(size=(3000, 6)))
    c = embeddings.spherical_kmeans(x[:1000], 40)
    row, cell, home = embeddings._visits(x, c, None, 0.93)
    seen = np.zeros((len(x), len(c)), bool)
    seen[row, cell] = True
    a, b = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    assert len(a) > 5_000 and seen[np.arange(len(x)), home].all() and (seen[a, home[b]] | seen[b, home[a]]).all()
    assert seen.mean() < 0.5  # and yet most cells are not visited


def test_cells_grow():
    count = [embeddings.cell_count(n) for n in (0, 1, 257, 262_144, 1 << 20, 100_000_000, 10**9)]
    assert count == [1, 1, 2, 1024, 1024, 10_000, 31_622]


def test_embeddings_on_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("pass_bytes", [8 << 20, 600])
def test_top_k_is_exact(spark, pass_bytes):
    table, rows = _vectors(spark, 300, 24, 3)
    q = topk.quantised(table)
    got = defaultdict(list)
    for r in topk.top_k(q.where("vec_id % 20 = 0"), q, 10, pass_bytes).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    part = [(r[0], np.floor(1024 * np.array(r[1], np.float64)).astype(np.int64)) for r in rows if r[0] is not None and r[1] is not None and None not in r[1] and np.isfinite(r[1]).all()]
    for i, v in part:
        if i % 20 == 0:
            want = sorted(((-int(v @ w), j) for j, w in part if j != i and len(w) == len(v)))[:10] if len(v) else []
            assert got.get(i, []) == [(j, -s) for s, j in want]


def test_top_k_on_empty_table(spark):
    q = topk.quantised(spark.createDataFrame([], VECTORS))
    assert topk.top_k(q, q).count() == 0


def test_segment_bound_holds():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-500, 500, (50, 37)).astype(float), rng.integers(-500, 500, (60, 37)).astype(float)
    for s in ([0], [0, 1, 2, 30], *topk.levels(37)):
        assert (topk.stats(a, np.array(s)) @ topk.stats(b, np.array(s)).T + 1e-6 >= a @ b.T).all()


def _best(ids, v, k=10):
    frame = topk.Frame.fit(ids[: topk.FIT_ROWS], v[: topk.FIT_ROWS])
    best = topk.Best(ids[ids % 100 == 0], v[ids % 100 == 0], k, frame)
    for a in range(0, len(ids), 1000):
        best.add(topk.Block(ids[a : a + 1000], v[a : a + 1000], frame))
    return best


def test_clustered_vectors_are_mostly_pruned():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(50, 64))
    ids, v = np.arange(6000), np.floor(1024 * (centres[rng.integers(0, 50, 6000)] + 0.15 * rng.normal(size=(6000, 64)))).astype(np.int64)
    best = _best(ids, v)
    assert best.left[0] < best.pairs / 2 and best.left[-1] <= best.left[0]
    for i, q in enumerate(range(0, 6000, 100)):
        scores = v @ v[q]
        want = sorted((-int(s), int(j)) for j, s in zip(ids, scores, strict=True) if j != q)[:10]
        assert [(-s, j) for s, j in zip(best.score[i].tolist(), best.vec[i].tolist(), strict=True)] == want


def test_components_beyond_exact_doubles():
    v = np.array([[2**31, 3], [2**31 + 1, 2], [-(2**40), 2**40], [2**62, 2**62]])
    best = _best(np.array([100, 1, 2, 3]), v, 3)
    exact = {j: sum(int(a) * int(b) for a, b in zip(v[0], v[i], strict=True)) for i, j in ((1, 1), (2, 2), (3, 3))}
    want = sorted(((min(max(s, -(2**63) + 1), 2**63 - 1), j) for j, s in exact.items()), key=lambda x: (-x[0], x[1]))
    assert list(zip(best.score[0].tolist(), best.vec[0].tolist(), strict=True)) == want


def test_packing_reads_other_tokenizer_files(tmp_path):
    import public_tokenizers

    own = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert own("Hello there").dtype == np.uint32 and len(own("Hello there")) > 0
