"""Why a true pair was missed: comparison features, categories and recoverability flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkforge.functions import address, text

#: The categories in order of precedence, and the overlapping flags.
CATEGORIES = (
    "word_order_change", "legal_suffix_variation", "additional_or_missing_tokens", "abbreviation_variation", "typo_or_spelling_variation",
    "partial_or_truncated_name", "transliteration_or_unicode_variation", "very_short_name", "weak_name_address_informative",
    "missing_or_empty_address", "exact_normalized_name_mismatch",
)
FLAGS = ("token_recoverable", "address_recoverable", "approximate_recoverable", "difficult")


def pair_frame(pairs: DataFrame, s1: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs with both sides' representations as columns a_* and b_*; tables are prepared ones.

    Words, numbers and postal codes are taken once per entity, before the join; those that nothing
    reads are pruned.
    """
    own = {c: F.col(c) for c in ("business_name", "name_clean", "name_compact", "name_core", "address_clean", "country_clean")}
    clean = F.col("address_clean")
    own |= {"name_words": text.split_words(F.col("name_compact")), "address_tokens": address.tokens(clean), "numbers": address.numbers(clean), "postal": address.postal(clean)}
    left = s1.select(F.col("entity_id").alias("s1_id"), *[c.alias(f"a_{n}") for n, c in own.items()])
    right = target.select(F.col("entity_id").alias("target_id"), *[c.alias(f"b_{n}") for n, c in own.items()])
    return pairs.join(left, "s1_id").join(right, "target_id")


def diagnose(frame: DataFrame) -> DataFrame:
    """``frame`` with name and address similarity, recoverability flags and one category per pair."""
    a, b = F.col("a_name_compact"), F.col("b_name_compact")
    out = frame.withColumns({"ta": F.col("a_name_words"), "tb": F.col("b_name_words"), "aa": F.col("a_address_tokens"), "ab": F.col("b_address_tokens")})
    out = out.withColumns(
        {
            "name_similarity": text.levenshtein_similarity(a, b),
            "name_jaccard": text.jaccard(F.col("ta"), F.col("tb")),
            "address_jaccard": text.jaccard(F.col("aa"), F.col("ab")),
            "subset": text.subset_either(F.col("ta"), F.col("tb")),
            "has_addresses": (F.col("a_address_clean") != "") & (F.col("b_address_clean") != ""),
        }
    )
    sim, jac = F.col("name_similarity"), F.col("name_jaccard")
    out = out.withColumn("address_recoverable", F.col("has_addresses") & ((F.col("address_jaccard") >= 0.5) | text.shares_digits(F.col("a_address_clean"), F.col("b_address_clean"))))
    out = out.withColumns(
        {
            "token_recoverable": (jac >= 0.5) | F.col("subset"),
            "approximate_recoverable": (sim >= 0.75) & (jac < 0.5) & ~F.col("subset"),
            "difficult": (sim < 0.75) & (jac < 0.5) & ~F.col("address_recoverable"),
        }
    )
    differs = a != b
    longest = F.greatest(F.char_length(a), F.char_length(b))
    most = F.greatest(F.size("ta"), F.size("tb"))
    other_words = F.array_sort(F.array_distinct("ta")) != F.array_sort(F.array_distinct("tb"))
    category = (
        F.when(text.same_words(F.col("ta"), F.col("tb")) & differs, "word_order_change")
        .when((F.col("a_name_core") != "") & (F.col("a_name_core") == F.col("b_name_core")) & differs, "legal_suffix_variation")
        .when(F.col("subset") & other_words, "additional_or_missing_tokens")
        .when(text.abbreviation(F.col("ta"), F.col("tb")), "abbreviation_variation")
        .when((sim >= 0.75) & differs, "typo_or_spelling_variation")
        .when((a.contains(b) | b.contains(a)) & differs, "partial_or_truncated_name")
        .when(text.has_non_ascii(F.col("a_business_name")) != text.has_non_ascii(F.col("b_business_name")), "transliteration_or_unicode_variation")
        .when((most <= 1) & (longest <= 4), "very_short_name")
        .when(F.col("address_recoverable") & (sim < 0.75), "weak_name_address_informative")
        .when(~F.col("has_addresses"), "missing_or_empty_address")
        .otherwise("exact_normalized_name_mismatch")
    )
    return out.withColumn("category", category).drop("ta", "tb", "aa", "ab")


def categories(diagnosed: DataFrame) -> DataFrame:
    """(category, pairs, percent), with the percentage to four places."""
    total = diagnosed.agg(F.count(F.lit(1)).alias("total"))
    per = diagnosed.groupBy("category").agg(F.count(F.lit(1)).alias("pairs"))
    return per.crossJoin(F.broadcast(total)).select("category", "pairs", F.round(100 * F.col("pairs") / F.col("total"), 4).alias("percent"))  # one row


def recoverability(diagnosed: DataFrame) -> DataFrame:
    """One row: pairs, and how many carry each (overlapping) flag."""
    return diagnosed.agg(F.count(F.lit(1)).alias("pairs"), *[F.count_if(F.col(f)).alias(f) for f in FLAGS])


def examples(diagnosed: DataFrame, n: int = 3) -> DataFrame:
    """Up to ``n`` pairs per category, by id."""
    place = F.row_number().over(Window.partitionBy("category").orderBy("s1_id", "target_id"))
    return diagnosed.withColumn("place", place).where(F.col("place") <= n).select("category", "place", "s1_id", "target_id")


def category_recovery(diagnosed: DataFrame, edges: DataFrame) -> DataFrame:
    """(category, pairs, recovered, rate): how a run covers the pairs of each category."""
    hit = diagnosed.select("category", "s1_id", "target_id").join(edges.withColumn("hit", F.lit(1)), ["s1_id", "target_id"], "left")
    per = hit.groupBy("category").agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("recovered"))
    return per.withColumn("rate", F.col("recovered") / F.col("pairs"))


def agreement(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """One row: share of equal, empty, distance and similarity means of two text columns; six places."""
    l, r = F.col(left), F.col(right)  # noqa: E741
    mean = lambda c: F.round(F.avg(c.cast("double")), 6)
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        mean((l == r).cast("int")).alias("exact"),
        F.count_if((l == "") | (r == "")).alias("empties"),
        mean(F.levenshtein(l, r)).alias("distance"),
        mean(text.levenshtein_similarity(l, r)).alias("similarity"),
        mean(text.jaccard(text.token_set(l), text.token_set(r))).alias("jaccard"),
    )
