"""Readers and writers of entity tables, truth lists and result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ENTITY_COLUMNS = ("entity_id", "business_name", "business_address", "country")
ENTITY = StructType([StructField(c, StringType()) for c in ENTITY_COLUMNS])
TRUTH = StructType([StructField(c, StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: StructType = ENTITY) -> DataFrame:
    """A headed TSV with all columns as strings and missing values empty, never null."""
    frame = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return frame.fillna("")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct first-column ids of a headed TSV; blank lines are ignored."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    header = F.trim(F.substring_index(F.lower("value"), "\t", 1)).isin("entity_id", "source1_entity_id")
    return lines.where(~header).select(F.trim(F.substring_index("value", "\t", 1)).alias("entity_id")).distinct()


def lookup(records: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """Records whose id is listed."""
    return records.join(ids.select(key).distinct(), key, "left_semi")


def truth_edges(lists: DataFrame) -> DataFrame:
    """(s1_id, target_source, target_id) of comma lists; blanks and repeats are dropped."""
    rows = lists.select(F.trim("source1_entity_id").alias("s1_id"), F.explode(F.split("matched_entity_ids", ",")).alias("raw"))
    rows = rows.select("s1_id", F.trim("raw").alias("target_id")).where("target_id <> ''").distinct()
    return rows.select("s1_id", F.substring_index("target_id", "-", 1).alias("target_source"), "target_id")


def inventory(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, path, present, bytes) of files or folders, by the file system that holds them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for name, p in paths.items():
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        there = fs.exists(path)
        rows.append((name, p, there, fs.getContentSummary(path).getLength() if there else 0))
    return spark.createDataFrame(rows, "name string, path string, present boolean, bytes long")


def result_lists(universe: DataFrame, edges: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """One row per S1 id with its sorted comma list, empty where it has none."""
    lists = edges.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias(column))
    return universe.join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def write_lists(lists: DataFrame, path: str) -> None:
    """Result lists as headed TSV without quoting."""
    lists.write.option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "").csv(path)
