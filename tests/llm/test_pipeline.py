"""The corpus pipeline, stage by stage."""

import math

from pyspark.sql import functions as F

import corpus_pipeline
from linkforge.llm import mixing, packing, pii, toxicity
from linkforge.runtime import cut
from test_shingles import brute


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before, kept = docs.columns, docs.count(), {}
    for name, stage in corpus_pipeline.STAGES:
        new = cut(stage(spark, docs, sf), name)
        kept[name] = new.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert new.columns == columns
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            logit = model.scorer()
            low = {r["doc_id"] for r in docs.collect() if 1 / (1 + math.exp(-logit(r["text"] or ""))) < model.thresholds.get(r["lang"], 0.5)}
            assert {r["doc_id"] for r in new.select("doc_id").collect()} == low
        if name == "simhash_near_dedup":
            want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
            assert {r["doc_id"] for r in new.select("doc_id").collect()} == want
        if name == "pii":
            had = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert all(r["text"] == pii.redact(had[r["doc_id"]] or "") and r["n_chars"] == len(r["text"]) for r in new.collect() if r["text"] is not None)
        if name == "source_mixing":
            took = {r["doc_id"]: r for r in mixing.taken(docs).collect()}
            got = {r["doc_id"]: r["count"] for r in new.groupBy("doc_id").count().collect()}
            assert all(got.get(i, 0) == (int(r["taken"] / r["size"] + 0.5) if r["size"] else 1) for i, r in took.items())
        if name == "packing":
            encode, lengths = packing.encoder(packing.default_tokenizer()), {}
            for r in docs.collect():
                lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + len(encode(r["text"] or "")) + 1
            assert {r["doc_id"]: r["n"] for r in new.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == lengths
            assert new.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
        docs = new
    assert kept["toxicity"] <= before and kept["packing"] >= kept["source_mixing"]
    assert corpus_pipeline.run(spark, sf).count() == kept["packing"]


def test_stages_on_odd_tables(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 0, 0), (2, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = cut(stage(spark, docs, str(tmp_path)), name)
            assert (out.count() > 0) == (docs.count() > 0)
            docs = out
