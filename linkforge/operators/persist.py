"""Candidate persistence, replay and validation.

Edges and the S1 manifest are Parquet, in a folder per stage and target source, ordered within
range partitions; the manifest is made from the edges as written. A checksum is taken over the sums of
the rows' SHA-256, so it does not depend on how rows are laid out; the summary has those of the inputs too. ``export_jsonl``
writes the ordered single-file form.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.operators.candidates import candidate_order, counts
from linkforge.operators.postings import keys

SCHEMA_VERSION = "candidates-v2"
SIGNALS = "struct<name:boolean,address_token:boolean,postal:boolean,number:boolean,country:boolean>"
REASONS = ("has_candidates", "zero_candidates_missing_signals", "zero_candidates_no_matching_index_keys", "zero_candidates_filtered_or_invalid_keys")
COVERAGE = ("has_candidates_complete_entity_coverage", "has_candidates_incomplete_entity_coverage", "coverage_unknown")


def families_of(stages: Column, names: list[str]) -> Column:
    """Names of the stages whose bits are set, in order."""
    return F.filter(F.array(*[F.when(stages.bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())


def availability(prepared: DataFrame) -> DataFrame:
    """(s1_id, signals): which kinds of keys an entity has, as a struct of booleans."""
    kinds = ("name", "address_token", "postal", "number")
    has = [F.exists(keys(k), lambda x: x != "").alias(k) for k in kinds]
    return prepared.select(F.col("entity_id").alias("s1_id"), F.struct(*has, (F.col("country_clean") != "").alias("country")).alias("signals"))


def edge_table(edges: DataFrame, stage: str, target_source: str, threshold: int | None, split_id: str | None = None, names: list[str] | None = None, signals: DataFrame | None = None) -> DataFrame:
    """Candidate rows with their order and provenance.

    ``edges`` may carry ``stages`` bits; ``names`` then tells the blocking family of each bit, and
    without them the stage is the only family. ``signals`` (s1_id, signals) comes from ``availability``.
    Edges that carry ``candidate_order`` are distinct and keep it.
    """
    if target_source not in ("S2", "S3"):
        raise ValueError(f"target must be S2 or S3: {target_source}")
    done = ["candidate_order"] if "candidate_order" in edges.columns else []
    if names and done:
        own = edges.select("s1_id", "target_id", families_of(F.col("stages"), names).alias("blocking_families"), *done)
    elif names:
        own = edges.groupBy("s1_id", "target_id").agg(F.bit_or("stages").alias("stages"))
        own = own.select("s1_id", "target_id", families_of(F.col("stages"), names).alias("blocking_families"))
    else:
        own = (edges.select("s1_id", "target_id", *done) if done else edges.select("s1_id", "target_id").distinct()).withColumn("blocking_families", F.array(F.lit(stage)))
    if signals is not None:
        own = own.join(signals.select("s1_id", "signals"), "s1_id", "left")
    else:
        own = own.withColumn("signals", F.lit(None).cast(SIGNALS))
    out = own if done else candidate_order(own)
    return out.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(split_id).cast("string").alias("split_id"), F.lit(target_source).alias("target_source"), "s1_id", "target_id",
        F.lit(stage).alias("stage_id"), F.lit(threshold).cast("int").alias("threshold"), "blocking_families", F.col("signals").alias("signal_availability"), "candidate_order",
    )


def manifest_table(universe: DataFrame, edges: DataFrame, target_source: str, with_signal: DataFrame | None = None, with_match: DataFrame | None = None) -> DataFrame:
    """One row per S1 entity: its candidates, and why it has none.

    ``with_signal`` lists the entities (id) that have a key, ``with_match`` those that share one with
    the target before caps and countries take any away; without them that reason is not told apart.
    """
    out = counts(universe, edges.select("s1_id", "target_id").distinct()).withColumn("target_source", F.lit(target_source))
    for name, ids, absent in (("signal", with_signal, True), ("match", with_match, False)):
        if ids is None:
            out = out.withColumn(name, F.lit(absent))
        else:
            out = out.join(ids.select(F.col("id").alias("s1_id"), F.lit(True).alias(name)).distinct(), "s1_id", "left").fillna(False, [name])
    reason = F.when(F.col("candidates") > 0, REASONS[0]).when(~F.col("signal"), REASONS[1]).when(F.col("match"), REASONS[3]).otherwise(REASONS[2])
    return out.select("target_source", "s1_id", F.col("candidates").alias("candidate_count"), (F.col("candidates") > 0).alias("has_candidates"), reason.alias("reason"))


def coverage(manifest: DataFrame, edges: DataFrame, truth: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(s1_id, candidate_count, truth, recovered, state): evaluation only, never an input of a matcher.

    Entities without candidates keep their reason; the others are covered wholly or in part, or
    unknown where ``labelled`` (s1_id) lists the entities that have labels and leaves them out.
    """
    hits = truth.select("s1_id", "target_id").distinct().join(edges.select("s1_id", "target_id", F.lit(1).alias("hit")).distinct(), ["s1_id", "target_id"], "left")
    per = hits.groupBy("s1_id").agg(F.count(F.lit(1)).alias("truth"), F.count("hit").alias("recovered"))
    out = manifest.join(per, "s1_id", "left").fillna(0, ["truth", "recovered"])
    if labelled is not None:
        out = out.join(labelled.select("s1_id", F.lit(True).alias("known")).distinct(), "s1_id", "left").fillna(False, ["known"])
    else:
        out = out.withColumn("known", F.lit(True))
    state = F.when(~F.col("has_candidates"), F.col("reason")).when(~F.col("known"), COVERAGE[2]).when(F.col("recovered") == F.col("truth"), COVERAGE[0]).otherwise(COVERAGE[1])
    return out.select("s1_id", "candidate_count", "truth", "recovered", state.alias("state"))


def line(columns: list[str]):
    """Canonical JSON of a row: keys in order, nulls kept, ASCII only."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"})


def checksum(table: DataFrame, order: list[str]) -> str:
    """Order-independent content checksum: row count and SHA-256 of the sums of all parts of the rows' SHA-256."""
    rows = table.select(F.sha2(line(table.columns).cast("binary"), 256).alias("h"))
    parts = [F.coalesce(F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).cast("string").alias(f"d{i}") for i in range(8)]
    row = rows.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    return f"{row['n']}:{hashlib.sha256(','.join(row[1:]).encode()).hexdigest()}"


def persist(
    universe: DataFrame, edges: DataFrame, path: str, stage: str, target_source: str, threshold: int | None = None, with_signal: DataFrame | None = None, with_match: DataFrame | None = None,
    split_id: str | None = None, names: list[str] | None = None, signals: DataFrame | None = None, inputs: dict[str, DataFrame] | None = None,
) -> dict:
    """Write edges, S1 manifest and summary below ``path``; returns the summary.

    ``inputs`` names the tables the edges come from, whose checksums go into the summary.
    """
    rows = edge_table(edges, stage, target_source, threshold, split_id, names, signals)
    base, spark = f"{path}/{stage}/{target_source}", universe.sparkSession
    rows.repartitionByRange("s1_id").sortWithinPartitions("s1_id", "target_id").write.mode("overwrite").parquet(f"{base}/candidates")
    manifest = manifest_table(universe, spark.read.parquet(f"{base}/candidates"), target_source, with_signal, with_match)
    manifest.repartitionByRange("s1_id").sortWithinPartitions("s1_id").write.mode("overwrite").parquet(f"{base}/s1_manifest")
    summary = summarise(spark.read.parquet(f"{base}/candidates"), spark.read.parquet(f"{base}/s1_manifest"))
    summary |= {"schema_version": SCHEMA_VERSION, "stage_id": stage, "target_source": target_source, "threshold": threshold, "split_id": split_id, "families": names or [stage]}
    summary["input_checksums"] = {k: checksum(t, []) for k, t in (inputs or {}).items()}
    spark.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/manifest")
    return summary


def summarise(rows: DataFrame, manifest: DataFrame) -> dict:
    repeats = rows.groupBy("s1_id", "target_id").count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).first()["n"]
    m = manifest.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("has_candidates")).alias("z")).first()
    return {"s1_rows": m["n"], "zero_candidate_rows": m["z"], "duplicate_rows": repeats, "candidate_checksum": checksum(rows, ["s1_id", "target_id"]), "s1_checksum": checksum(manifest, ["s1_id"])}


def replay(spark, path: str, stage: str, target_source: str) -> DataFrame:
    """The persisted edges; a wrong target or a repeated edge is an error."""
    rows = spark.read.parquet(f"{path}/{stage}/{target_source}/candidates")
    if rows.where(F.col("target_source") != target_source).limit(1).count():
        raise ValueError("candidates of another target")
    if rows.groupBy("s1_id", "target_id").count().where("count > 1").limit(1).count():
        raise ValueError("repeated candidate edge")
    return rows


def validate(spark, path: str, stage: str, target_source: str, universe: DataFrame, inputs: dict[str, DataFrame] | None = None) -> dict:
    """Check order, S1 universe, counts and checksums of a persisted stage, and of ``inputs``; returns its summary."""
    base = f"{path}/{stage}/{target_source}"
    rows, manifest = replay(spark, path, stage, target_source), spark.read.parquet(f"{base}/s1_manifest")
    if candidate_order(rows.drop("candidate_order").withColumn("_o", F.lit(0))).join(rows.select("s1_id", "target_id", F.col("candidate_order").alias("had")), ["s1_id", "target_id"]).where("had <> candidate_order").limit(1).count():
        raise ValueError("candidate order differs")
    ids = manifest.select("s1_id")
    if universe.join(ids, "s1_id", "left_anti").limit(1).count() or ids.join(universe, "s1_id", "left_anti").limit(1).count():
        raise ValueError("S1 manifest does not match the universe")
    per = counts(ids, rows).join(manifest, "s1_id").where(F.col("candidates") != F.col("candidate_count"))
    if per.limit(1).count():
        raise ValueError("candidate counts differ")
    stored = json.loads(spark.read.text(f"{base}/manifest").first()[0])
    for k, v in summarise(rows, manifest).items():
        if stored.get(k) != v:
            raise ValueError(f"summary differs: {k}")
    for k, t in (inputs or {}).items():
        if stored["input_checksums"].get(k) != checksum(t, []):
            raise ValueError(f"input differs: {k}")
    return stored


def export_jsonl(rows: DataFrame, path: str, order: list[str]) -> None:
    """One ordered text file of canonical lines."""
    rows.orderBy(*order).select(line(rows.columns).alias("value")).coalesce(1).write.mode("overwrite").text(path)
