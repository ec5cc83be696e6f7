"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of 5-word shingles."""

import random

import pytest

import corpus_pipeline
from linkforge.llm import shingles


def brute(rows):
    """Smallest id of every class of texts that five-word Jaccard similarity of 0.8 connects."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {find(i) for i in ids}


def edited(rng):
    """Texts of all lengths, copies of them with more and more words changed, and one large group."""
    word = lambda: f"w{rng.randint(0, 400)}"
    passage = [word() for _ in range(40)]
    texts = ["", "  ", "one two", "One  two", "a b c d e"]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([6, 30, 90, 400]))] + passage * rng.randint(0, 1)
        for changes in (0, 0, 1, 2, 4, 9):
            copy = list(base)
            for at in rng.sample(range(len(copy)), min(changes, len(copy))):
                copy[at] = word()
            texts.append(" ".join(copy))
    base = [word() for _ in range(120)]
    for _ in range(60):
        copy = list(base)
        for at in rng.sample(range(120), rng.randint(0, 6)):
            copy[at] = word()
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("sample", "crowd", "chunk"), [(10_000, 32, 1024), (20, 2, 8)])
def test_stage_equals_brute_force(spark, sample, crowd, chunk, monkeypatch):
    monkeypatch.setattr(shingles, "SAMPLE", sample)
    monkeypatch.setattr(shingles, "CROWD", crowd)
    monkeypatch.setattr(shingles, "CHUNK", chunk)
    rows = edited(random.Random(sample))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_stage_on_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).select("doc_id").collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_stage_on_odd_tables(spark, odd_docs, no_docs):
    kept = [r["doc_id"] for r in shingles.without_near_duplicates(odd_docs).collect()]
    assert sorted(kept, key=str) == [1, 3, 6, 8, 9, None]
    assert shingles.without_near_duplicates(no_docs).count() == 0


def test_sets_travel_packed(spark):
    from pyspark.sql import functions as F

    from linkforge.llm import shingles as sh

    body = " ".join(f"Word{i}" for i in range(400))
    rows = [(1, body), (2, body.replace("Word7 ", "other ")), (3, "\t" + body.lower() + "\n"), (4, None), (5, " \n"), (6, "Ünï ß " * 30), (7, "only two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    content = F.xxhash64(F.coalesce("text", F.lit("")))
    sets = sh._sets(docs, docs.select(F.col("doc_id").alias(sh._ID), content.alias(sh._CONTENT)), "doc_id", "text").cache()
    assert {r["node"] for r in sets.collect()} == {sh._node(sh.shingles(t or "")) for _, t in rows}
    size = sum(len(r["packed"]) for r in sets.collect())
    assert size * 3 < sum(8 * len(sh.shingles(t or "")) for _, t in rows)  # well under the hashes
    nodes = sets.select("node")
    got = {(r["a"], r["b"]) for r in sh._similar(nodes.select(F.col("node").alias("a")).crossJoin(nodes.select(F.col("node").alias("b"))), sets).collect()}
    own = {sh._node(sh.shingles(t or "")): set(sh.shingles(t or "").tolist()) for _, t in rows}
    assert got == {(a, b) for a in own for b in own if 9 * len(own[a] & own[b]) >= 4 * (len(own[a]) + len(own[b]))}
