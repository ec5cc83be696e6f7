"""Pair features with missingness flags, and deterministic matchers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkforge.functions import text


def _known(a: Column, b: Column) -> Column:
    return (a != "") & (b != "")


def pair_features(frame: DataFrame) -> DataFrame:
    """Features of candidate pairs (columns a_*, b_*); a missing value never equals anything."""
    na, nb, aa, ab = (F.col(c) for c in ("a_name_compact", "b_name_compact", "a_address_clean", "b_address_clean"))
    ta, tb, da, db = (F.col(c) for c in ("a_name_words", "b_name_words", "a_address_tokens", "b_address_tokens"))
    name, addr = _known(na, nb), _known(aa, ab)
    pa, pb, qa, qb = (F.col(c) for c in ("a_postal", "b_postal", "a_numbers", "b_numbers"))
    share = lambda x, y: F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(x)), F.lit(0.0))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return frame.select(
        "s1_id",
        "target_id",
        yes(name & (na == nb)).alias("name_exact"),
        F.when(name, text.jaccard(ta, tb)).otherwise(0.0).alias("name_overlap"),
        F.when(name, text.levenshtein_similarity(na, nb)).otherwise(0.0).alias("name_similarity"),
        F.abs(F.char_length(na) - F.char_length(nb)).alias("name_length_difference"),
        yes(~name).alias("name_missing"),
        yes(addr & (aa == ab)).alias("address_exact"),
        F.when(addr, text.jaccard(da, db)).otherwise(0.0).alias("address_overlap"),
        F.when(addr, share(da, db)).otherwise(0.0).alias("address_in_target"),
        F.when(addr, share(db, da)).otherwise(0.0).alias("target_in_address"),
        yes(F.arrays_overlap(qa, qb)).alias("number_agreement"),
        yes(F.arrays_overlap(pa, pb)).alias("postal_exact"),
        yes(~addr).alias("address_missing"),
        yes(_known(F.col("a_country_clean"), F.col("b_country_clean")) & (F.col("a_country_clean") == F.col("b_country_clean"))).alias("country_exact"),
    )


def provenance(tagged: DataFrame, names: list[str]) -> DataFrame:
    """(s1_id, target_id, from_*, family_count): which blocking families found a pair, from its ``stages`` bits."""
    flags = [(F.col("stages").bitwiseAND(F.lit(1 << i).cast("long")) != 0).cast("int").alias(f"from_{n}") for i, n in enumerate(names)]
    return tagged.select("s1_id", "target_id", *flags, F.bit_count("stages").alias("family_count"))


def with_provenance(features: DataFrame, tagged: DataFrame, names: list[str]) -> DataFrame:
    """Pair features with the flags of the blocking families; a pair that no family found has zeros."""
    own = provenance(tagged, names)
    return features.join(own, ["s1_id", "target_id"], "left").fillna(0, [f"from_{n}" for n in names] + ["family_count"])


def match_exact_name(features: DataFrame) -> DataFrame:
    """Pairs of equal names."""
    return features.where("name_exact = 1").select("s1_id", "target_id")


def match_signals(features: DataFrame) -> DataFrame:
    """Pairs of equal names, or of similar names with agreeing postal code and number."""
    close = (F.col("name_similarity") >= 0.8) & (F.col("postal_exact") == 1) & (F.col("number_agreement") == 1)
    return features.where((F.col("name_exact") == 1) | close).select("s1_id", "target_id")


def score(features: DataFrame) -> DataFrame:
    """A rule score in [0, 1] for ranking."""
    s = 0.5 * F.col("name_similarity") + 0.2 * F.col("name_overlap") + 0.15 * F.col("address_overlap") + 0.1 * F.col("postal_exact") + 0.05 * F.col("number_agreement")
    return features.withColumn("score", F.round(s, 9))


def rank(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Targets of each S1 entity by score, ties by id; the first k of them."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("score"), "target_id")))
    return out.where(F.col("rank") <= k) if k else out


def fit_matcher(features: DataFrame, labels: DataFrame, columns: list[str], split: DataFrame):
    """A logistic matcher fitted on the pairs of the S1 entities in ``split`` only."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    own = features.join(split.select("s1_id"), "s1_id", "left_semi").join(labels.select("s1_id", "target_id", F.lit(1.0).alias("label")), ["s1_id", "target_id"], "left").fillna(0.0, ["label"])
    assembled = VectorAssembler(inputCols=columns, outputCol="features").transform(own)
    return LogisticRegression(maxIter=20, regParam=1e-3).fit(assembled)
