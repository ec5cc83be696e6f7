"""Rules for result lists, checked on raw lines so that malformed ones are seen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkforge.functions.text import source_of
from linkforge.runtime import exists

#: Examples shown of a broken rule.
EXAMPLES = 5
#: Characters of an example; what is longer is cut.
LONGEST = 200
HEADERS = {"matching": ("source1_entity_id", "matched_entity_ids"), "candidates": ("source1_entity_id", "candidate_entity_ids")}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): raw lines numbered from 1 in file order.

    Row ids rise without gaps within a split of a file, so a line's number is its place in its split
    behind the lines of all splits before it; only one row per split is summed up in order.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.withColumn("before", before).drop("n")
    return lines.join(splits, ["file", "start"]).select((F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "value")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines with their parts: fields, s1_id and ids."""
    own = lines.where(F.trim("value") != "").withColumn("fields", F.split("value", "\t"))
    listed = F.filter(F.transform(F.split(F.coalesce(F.get("fields", F.lit(1)), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return own.withColumn("s1_id", F.trim(F.get("fields", F.lit(0)))).withColumn("ids", listed)


def _broken(rows: DataFrame, rule: str, level: str, what: Column) -> DataFrame:
    """(rule, level, x): one row for every time that a rule is broken."""
    return rows.select(F.lit(rule).alias("rule"), F.lit(level).alias("level"), F.substring(what.cast("string"), 1, LONGEST).alias("x"))


def _issues(broken: list[DataFrame]) -> DataFrame:
    """(rule, level, n, examples): how often each rule is broken, with its first five examples.

    Equal examples are counted before anything else, and a rule keeps five of them from every
    partition, so no task holds all that breaks a rule.
    """
    per = reduce(DataFrame.unionAll, broken).groupBy("rule", "level", "x").agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("rule", "level").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("rule").orderBy("x"))
    first = per.select("rule", "x", place.alias("place")).where(F.col("place") <= EXAMPLES)
    first = first.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("x")), "|").alias("examples"))
    return total.join(first, "rule", "left").select("rule", "level", "n", F.coalesce("examples", F.lit("")).alias("examples"))


def list_issues(lines: DataFrame, kind: str, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Broken rules of one result list (``lines``: line_no, value) against the S1 ids it must have."""
    header = HEADERS[kind]
    rows = parse_lines(lines)
    first = lines.where("line_no = 1")
    head = F.transform(F.split(F.lower(F.trim("value")), "\t"), lambda x: F.trim(x))
    good = head == F.array(*[F.lit(h) for h in header])
    comma = F.lower(F.trim("value")).startswith(",".join(header)[:20]) & ~F.col("value").contains("\t")
    body = rows.where("line_no > 1")
    shaped = body.where(F.size("fields") == 2)
    last = shaped.groupBy("s1_id").agg(F.max_by("ids", "line_no").alias("ids"), F.count(F.lit(1)).alias("n"))
    flat = shaped.select("s1_id", F.explode("ids").alias("id"))
    per = shaped.select("line_no", "s1_id", F.explode("ids").alias("id")).groupBy("line_no", "s1_id", "id").count()
    need = required.select("s1_id").distinct()
    nothing = lines.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    out = [
        _broken(nothing, "empty_file", "error", F.lit("")),
        _broken(first.where(comma), "comma_separated", "error", F.col("value")),
        _broken(first.where(~good & ~comma), "wrong_header", "error", F.col("value")),
        _broken(body.where(F.size("fields") != 2), "malformed_row", "error", F.col("line_no")),
        _broken(last.where("n > 1"), "repeated_s1_row", "error", F.col("s1_id")),
        _broken(per.where("count > 1"), "repeated_id_in_list", "error", F.col("id")),
        _broken(flat.where("s1_id = id"), "self_match", "error", F.col("id")),
        _broken(flat.where(~source_of(F.col("id")).isin("S2", "S3")), "wrong_prefix", "error", F.col("id")),
        _broken(need.join(last, "s1_id", "left_anti"), "missing_s1", "error", F.col("s1_id")),
        _broken(last.join(need, "s1_id", "left_anti"), "extra_s1", "error", F.col("s1_id")),
    ]
    if known is not None:
        out.append(_broken(flat.join(known.select(F.col("entity_id").alias("id")), "id", "left_anti"), "unknown_id", "error", F.col("id")))
    return _issues(out)


def file_issues(spark: SparkSession, path: str, kind: str, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Broken rules of the result list at ``path``; a file that is not there breaks one rule and no other is looked at."""
    if exists(spark, path):
        return list_issues(read_lines(spark, path), kind, required, known)
    return spark.createDataFrame([("missing_file", "error", 1, path)], "rule string, level string, n long, examples string")


def last_lists(lines: DataFrame) -> DataFrame:
    """(s1_id, target_id) of the last row of every S1 id."""
    shaped = parse_lines(lines).where("line_no > 1").where(F.size("fields") == 2)
    return shaped.groupBy("s1_id").agg(F.max_by("ids", "line_no").alias("ids")).select("s1_id", F.explode("ids").alias("target_id")).distinct()


def not_candidates(matching: DataFrame, candidates: DataFrame) -> DataFrame:
    """Warning row for matched ids outside the candidates."""
    outside = last_lists(matching).join(last_lists(candidates), ["s1_id", "target_id"], "left_anti")
    return _issues([_broken(outside, "match_not_candidate", "warning", F.col("target_id"))])
