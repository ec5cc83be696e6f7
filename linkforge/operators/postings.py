"""Posting tables: one narrow row per entity and blocking key, and key frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.functions import address, text


def prepare(entities: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Entities with their text representations; raw columns are kept.

    ``ascii_only`` is for tables known to be ASCII and keeps the plan free of Python.
    """
    norm = text.ascii_safe if ascii_only else text.safe
    out = entities.withColumns({"name_clean": norm(F.col("business_name")), "country_clean": norm(F.col("country")), "address_clean": norm(F.col("business_address"))})
    out = out.withColumn("name_compact", text.compact(F.col("name_clean")))
    return out.withColumn("name_core", text.core(F.col("name_compact")))


def _one(name: str):
    return lambda: F.array(F.col(name))


#: Key families: what a posting's key is made of.
FAMILIES: dict[str, object] = {
    "name": _one("name_clean"),
    "compact_name": _one("name_compact"),
    "core_name": _one("name_core"),
    "name_token_unicode": lambda: text.token_set(F.col("name_clean")),
    "name_token_compact": lambda: text.token_set(F.col("name_compact")),
    "address_token": lambda: address.informative(F.col("address_clean")),
    "postal": lambda: address.postal(F.col("address_clean")),
    "number": lambda: address.numbers(F.col("address_clean")),
}


def keys(family: str) -> Column:
    """The family's keys of a prepared row, as an array."""
    if family not in FAMILIES:
        raise ValueError(f"unknown key family: {family}")
    return FAMILIES[family]()


def postings(prepared: DataFrame, family: str) -> DataFrame:
    """(id, country, key): distinct non-empty keys of every entity; an empty country is kept."""
    own = prepared.select(F.col("entity_id").alias("id"), F.col("country_clean").alias("country"), F.explode(F.array_distinct(keys(family))).alias("key"))
    return own.where("key <> ''")


def frequencies(posted: DataFrame) -> DataFrame:
    """(key, freq): in how many entities a key occurs, over all countries."""
    return posted.groupBy("key").agg(F.count(F.lit(1)).alias("freq"))


def with_frequency(posted: DataFrame, freq: DataFrame) -> DataFrame:
    """Postings with the target's frequency of their key; a key the target lacks has 0."""
    return posted.join(freq, "key", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))


def capped(posted: DataFrame, freq: DataFrame, cap: int | None) -> DataFrame:
    """Postings whose key occurs at most ``cap`` times in the target (no cap: all of them)."""
    return with_frequency(posted, freq).where(F.col("freq") <= cap) if cap is not None else posted


def block_sizes(target: DataFrame, country_aware: bool = True) -> DataFrame:
    """Rows per block of the target's postings; country-aware blocks need a country."""
    if country_aware:
        return target.where("country <> ''").groupBy("country", "key").agg(F.count(F.lit(1)).alias("size"))
    return target.groupBy("key").agg(F.count(F.lit(1)).alias("size"))


def block_statistics(sizes: DataFrame) -> DataFrame:
    """One row: blocks, largest block, blocks beyond 100, 1,000 and 10,000 rows, exact percentiles."""
    p = F.percentile("size", F.array(F.lit(0.95), F.lit(0.99)))
    return sizes.agg(
        F.count(F.lit(1)).alias("blocks"),
        F.coalesce(F.max("size"), F.lit(0)).alias("max_block"),
        F.count_if(F.col("size") > 100).alias("over_100"),
        F.count_if(F.col("size") > 1000).alias("over_1000"),
        F.count_if(F.col("size") > 10000).alias("over_10000"),
        p[0].alias("p95"),
        p[1].alias("p99"),
    )


def block_report(target: DataFrame, family: str, cap: int, country_aware: bool = True) -> DataFrame:
    """One row of a key family: distinct keys, those up to the cap, and the statistics of its blocks."""
    own = postings(target, family)
    known = frequencies(own).agg(F.count(F.lit(1)).alias("distinct_keys"), F.count_if(F.col("freq") <= cap).alias("keys_up_to_cap"))
    return known.crossJoin(block_statistics(block_sizes(own, country_aware))).select(F.lit(family).alias("family"), "*")  # one row each


def extraction_statistics(prepared: DataFrame, family: str) -> DataFrame:
    """One row: rows, rows with a key, with several, occurrences, and distinct keys."""
    own = prepared.select(F.size(F.array_distinct(F.filter(keys(family), lambda k: k != ""))).alias("n"))
    counts = own.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n") > 0).alias("with_signal"), F.count_if(F.col("n") > 1).alias("with_multiple"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"))
    return counts.crossJoin(frequencies(postings(prepared, family)).agg(F.count(F.lit(1)).alias("distinct_keys")))  # one row each
