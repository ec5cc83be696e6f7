"""Data quality, truth integrity and shift checks, as aggregates over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.functions.text import has_non_ascii, match_bucket, source_of, valid_id
from linkforge.operators.components import connected_components


def collisions(prepared: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Per text representation: distinct non-empty values, values and rows that repeat, the largest
    bucket and empty rows; one scan for all representations."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("representation"), F.col(c).alias("value")) for c in columns])).alias("p")
    per = prepared.select(pairs).select("p.*").groupBy("representation", "value").agg(F.count(F.lit(1)).alias("n"))
    full, many = F.col("value") != "", F.col("n") > 1
    return per.groupBy("representation").agg(
        F.lit(label).alias("source"),
        F.count_if(full).alias("unique_values"),
        F.count_if(full & many).alias("duplicated_values"),
        F.coalesce(F.sum(F.when(full & many, F.col("n"))), F.lit(0)).alias("rows_in_duplicates"),
        F.coalesce(F.max(F.when(full, F.col("n"))), F.lit(0)).alias("max_bucket"),
        F.coalesce(F.sum(F.when(~full, F.col("n"))), F.lit(0)).alias("empty_rows"),
    )


def lengths(table: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: length extremes, mean, median, deviation, tails, and counts of odd lengths."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.char_length(F.coalesce(c, F.lit(""))).alias("n")) for c in columns])).alias("p")
    n = F.col("n")
    p = F.percentile(n, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return table.select(pairs).select("p.*").groupBy("field").agg(
        F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"), p[1].alias("median"), F.round(F.stddev_samp(n), 6).alias("std"),
        p[0].alias("p5"), p[2].alias("p95"), F.count_if(n <= 2).alias("up_to_two"), F.count_if(n == 0).alias("empty"), F.count_if(n > 200).alias("over_200"),
    )


def top_values(table: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return table.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def duplicates(table: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, keys that repeat."""
    per = table.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"))


def prefixes(table: DataFrame) -> DataFrame:
    """(prefix, rows, valid): ids by source prefix, and how many are well formed."""
    return table.groupBy(source_of(F.col("entity_id")).alias("prefix")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(valid_id(F.col("entity_id"))).alias("valid"))


def token_counts(table: DataFrame, column: str) -> DataFrame:
    """(tokens, rows): how many rows have how many words."""
    words = F.filter(F.split(F.coalesce(column, F.lit("")), r"\s+"), lambda w: w != "")
    return table.groupBy(F.size(words).cast("long").alias("tokens")).agg(F.count(F.lit(1)).alias("rows"))


def non_ascii_characters(table: DataFrame, column: str) -> DataFrame:
    """(character, n, rows): characters beyond ASCII, how often they occur and in how many rows."""
    odd = table.where(has_non_ascii(F.col(column))).select(F.filter(F.split(column, ""), lambda c: has_non_ascii(c)).alias("c"))
    one = lambda n, rows: lambda c: F.struct(c.alias("character"), F.lit(n).alias("n"), F.lit(rows).alias("rows"))
    both = F.concat(F.transform("c", one(1, 0)), F.transform(F.array_distinct("c"), one(0, 1)))
    return odd.select(F.inline(both)).groupBy("character").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))


def match_counts(universe: DataFrame, truth: DataFrame) -> DataFrame:
    """Per S1 entity: its S2 and S3 matches and its bucket, singletons included."""
    per = truth.groupBy("s1_id").agg(F.count_if(F.col("target_source") == "S2").alias("s2"), F.count_if(F.col("target_source") == "S3").alias("s3"))
    out = universe.join(per, "s1_id", "left").fillna(0, ["s2", "s3"])
    n = F.col("s2") + F.col("s3")
    return out.withColumn("matches", n).withColumn("bucket", F.when(n == 0, "0").when(n == 1, "1").otherwise("2+"))


def match_histogram(counted: DataFrame) -> DataFrame:
    """(matches, entities, s2_only, s3_only, both)."""
    two, three = F.col("s2") > 0, F.col("s3") > 0
    return counted.groupBy("matches").agg(F.count(F.lit(1)).alias("entities"), F.count_if(two & ~three).alias("s2_only"), F.count_if(three & ~two).alias("s3_only"), F.count_if(two & three).alias("both"))


def country_patterns(counted: DataFrame) -> DataFrame:
    m = F.col("matches")
    return counted.groupBy("country").agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(m == 0).alias("zero"), F.count_if(m == 1).alias("one"), F.count_if(m > 1).alias("many"), F.round(F.avg(m), 6).alias("mean"), F.max(m).alias("most")
    )


def bucket_crosstab(counted: DataFrame) -> DataFrame:
    """Countries against buckets."""
    out = counted.groupBy("country").pivot("bucket", ["0", "1", "2+"]).agg(F.count(F.lit(1))).fillna(0)
    return out.select("country", F.col("0").alias("zero"), F.col("1").alias("one"), F.col("2+").alias("two_or_more"))


def reuse(truth: DataFrame) -> DataFrame:
    """Targets that several S1 entities match, and how often."""
    return truth.groupBy("target_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def truth_integrity(s1: DataFrame, targets: DataFrame, lists: DataFrame) -> DataFrame:
    """(check, violations) of a truth table (source1_entity_id, matched_entity_ids) against the sources."""
    own = lists.select(F.col("source1_entity_id").alias("s1_id"), "matched_entity_ids")
    parts = own.select("s1_id", F.explode(F.split("matched_entity_ids", ",")).alias("raw")).select("s1_id", F.trim("raw").alias("target_id")).where("target_id <> ''")
    ids, there = s1.select(F.col("entity_id").alias("s1_id")), targets.select(F.col("entity_id").alias("target_id"))
    per = parts.groupBy("s1_id", "target_id").agg(F.count(F.lit(1)).alias("n"))

    def row(name: str, frame: DataFrame) -> DataFrame:
        return frame.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")

    checks = [
        row("truth_id_not_in_s1", own.join(ids, "s1_id", "left_anti")),
        row("s1_without_truth_row", ids.join(own, "s1_id", "left_anti")),
        row("unknown_target", per.join(there, "target_id", "left_anti")),
        row("s1_in_list", per.where(source_of(F.col("target_id")) == "S1")),
        row("repeated_in_list", per.where("n > 1")),
        row("wrong_prefix", per.where(~source_of(F.col("target_id")).isin("S2", "S3"))),
        row("malformed_id", per.where(~valid_id(F.col("target_id")))),
        row("empty_list", own.where(match_bucket(F.col("matched_entity_ids")) == "0")),
        row("repeated_truth_row", own.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionAll(c)
    return out


def components(truth: DataFrame) -> DataFrame:
    """(s1_id, component) over S1 entities that share targets; the smallest id names a component."""
    return connected_components(truth, "s1_id", "target_id").where(F.col("node").startswith("S1-")).select(F.col("node").alias("s1_id"), "component")


def component_extents(truth: DataFrame) -> DataFrame:
    """(component, s1, s2, s3): entities of every source in each component."""
    nodes = connected_components(truth, "s1_id", "target_id")
    own = source_of(F.col("node"))
    return nodes.groupBy("component").agg(*[F.count_if(own == s).alias(s.lower()) for s in ("S1", "S2", "S3")])


def largest_components(extents: DataFrame) -> DataFrame:
    """One row: components, and the most entities of every source, of S2 and S3, and of all in one of them."""
    targets = F.col("s2") + F.col("s3")
    most = [F.coalesce(F.max(c), F.lit(0)).alias(f"largest_{n}") for n, c in (("s1", F.col("s1")), ("s2", F.col("s2")), ("s3", F.col("s3")), ("targets", targets), ("all", F.col("s1") + targets))]
    return extents.agg(F.count(F.lit(1)).alias("components"), *most)


def component_sizes(labelled: DataFrame) -> DataFrame:
    """(size, components)."""
    return labelled.groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("components"))


def shift(train: DataFrame, test: DataFrame) -> DataFrame:
    """(country, train_rows, test_rows, is_new): how the countries of two tables differ."""
    a = train.groupBy("country").agg(F.count(F.lit(1)).alias("train_rows"))
    b = test.groupBy("country").agg(F.count(F.lit(1)).alias("test_rows"))
    out = a.join(b, "country", "full").fillna(0, ["train_rows", "test_rows"])
    return out.withColumn("is_new", (F.col("train_rows") == 0) & (F.col("test_rows") > 0))


def length_shift(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """(field, train_mean, test_mean, train_median, test_median, mean_difference): how lengths differ between two tables."""
    a, b = (lengths(t, columns).select("field", F.col("mean").alias(f"{s}_mean"), F.col("median").alias(f"{s}_median")) for t, s in ((train, "train"), (test, "test")))
    return a.join(b, "field").withColumn("mean_difference", F.round(F.col("test_mean") - F.col("train_mean"), 6))


def first_match(lists: DataFrame) -> DataFrame:
    """(s1_id, target_id): the first id of every S1 entity's list; entities without one are left out."""
    first = F.substring_index("matched_entity_ids", ",", 1)
    return lists.select(F.col("source1_entity_id").alias("s1_id"), first.alias("target_id")).where("target_id <> ''")


def preview(table: DataFrame, k: int, key: str = "entity_id") -> DataFrame:
    """The first and the last k rows by key, told apart by ``part``; a smaller table shows its rows in both."""
    head = table.orderBy(key).limit(k).withColumn("part", F.lit("head"))
    return head.unionByName(table.orderBy(F.desc(key)).limit(k).withColumn("part", F.lit("tail")))


def overlap(a: DataFrame, b: DataFrame, key: str = "entity_id") -> DataFrame:
    """Ids that two tables share."""
    return a.select(key).intersect(b.select(key))
