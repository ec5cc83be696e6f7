"""Toxicity by a convolutional text classifier, trained here in numpy.

A word's vector is the sum of two hashed embeddings, of the word and of its first four letters, so
inflected and compounded forms share what is learned. Filters of several widths slide over the
whole text, each is pooled by its maximum, and a logistic layer scores the pooled values. The model
is fitted on a bounded sample of the labelled rows (``SAMPLE`` rows per class, of texts up to
``TRAIN_CHARS`` characters); rows whose CRC-32 of the id is divisible by 5 are never learned from.
Scores use the text alone. The threshold 0.5 is calibrated on a fifth of the sample that the model
is not fitted on (on all of it where a class has under ``CALIBRATION_ROWS`` texts), and languages
with enough labelled rows there get a threshold of their own for rejection.

Defined cases: a null or empty text is scored like any other (by the padding alone); repeated rows
get equal scores and are learned from once (as toxic if any is labelled so), of rows that share an id the first text; a null id counts as the empty string for the hold-out rule; without labels
of both kinds nothing can be told apart and every score is 0; an empty table gives no rows; further columns
are ignored. Whole texts are scored, however long, in one pass with bounded tables.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from linkforge.llm.arrow import map_arrow
from linkforge.llm.convolution import SEED, Model, _sigmoid, train, train_apart  # noqa: F401

#: Labelled rows per class that the model is fitted on, the longest text among them, and their UTF-8 bytes in all.
SAMPLE = 3000
TRAIN_CHARS = 60_000
TRAIN_BYTES = 96 << 20


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sampled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(text, _toxic, lang): a bounded sample of rows that may be learned from, in one partition."""
    own = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    own = own.where(F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1) & ~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    order = [F.xxhash64(F.lit(seed), "_id"), F.col("_id")]
    ids = [own.where(F.col("_toxic") == k).orderBy(*order).limit(rows) for k in (0, 1)]
    ids = F.broadcast(ids[0].unionAll(ids[1]))  # at most 2 * rows rows
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce("text", F.lit(""))
    own_text = docs.select("doc_id", text.alias("text"), lang.alias("lang")).where(F.char_length("text") <= TRAIN_CHARS)
    met = own_text.join(ids, F.col("doc_id") == F.col("_id"))
    one = met.groupBy("_id", "_toxic").agg(F.min(F.struct("text", "lang")).alias("own"))  # an id counts once, by its first text
    upto = F.sum(F.octet_length("own.text")).over(Window.orderBy(*order))  # over at most 2 * rows rows
    return one.withColumn("upto", upto).where(F.col("upto") <= TRAIN_BYTES).select("own.text", "_toxic", "own.lang").coalesce(1)


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, seed: int = SEED) -> tuple[list[str], list[int], list[str | None]]:
    """Texts, labels and languages of ``sampled``."""
    got = sampled(docs, labels, rows, seed).collect()
    return [r["text"] for r in got], [r["_toxic"] for r in got], [r["lang"] for r in got]


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, the score in [0, 1] of the whole text."""
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logit = model.scorer()
        for batch in batches:
            if model.constant is not None:
                scores = np.full(batch.num_rows, model.constant)
            else:
                scores = _sigmoid(np.array([logit(t.as_py() or "") for t in batch.column(place)], np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return map_arrow(docs, run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def threshold(model: Model):
    """The rejection threshold of a row, by language."""
    out = F.lit(0.5)
    for lang, t in model.thresholds.items():
        out = F.when(F.col("lang") == lang, t).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the sample, trained by the task that gathers it; the driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        own = pickle.dumps(train_apart(*([r[i] for r in rows] for i in range(3))))
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary())], names=["model"])

    got = map_arrow(sampled(docs, labels), run, "model binary").first()  # no row where the sample has no partition
    return pickle.loads(got["model"]) if got else train([], [])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "lang", "text"), model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        threshold(model).alias("threshold"),
        (F.col("score") >= threshold(model)).alias("rejected"),
    )
