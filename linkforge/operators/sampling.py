"""Reproducible samples by hash order: the same seed chooses the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Slices of the hash range that a stratum is ranked in: sixteen to this power.
SLICE_DIGITS = 3
#: Beginning of names that no table has.
_OWN = "__linkforge_"


def _hash(seed: int, key: str) -> Column:
    """The place of a row: MD5 of the seed and the key, which any engine can restate."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))


def _by(seed: int, key: str) -> list:
    return [_hash(seed, key), F.col(key)]


def stratified(rows: DataFrame, strata: list[str], fraction: float, key: str, seed: int = 42) -> DataFrame:
    """``round(fraction * n)`` rows of every stratum, half to even.

    Ranks are taken in two levels, by slice of the hash range and then within the slice, so that a
    stratum of very many rows is never sorted in one task. A null stratum is one of its own.
    """
    at, part, n, take, of, rank = (f"{_OWN}{x}" for x in ("at", "slice", "n", "take", "of", "place"))
    sliced = rows.withColumn(at, _hash(seed, key)).withColumn(part, F.substring(at, 1, SLICE_DIGITS))
    sizes = sliced.groupBy(*strata, part).agg(F.count(F.lit(1)).alias(n))
    whole, upto = Window.partitionBy(*strata), Window.partitionBy(*strata).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.bround(F.lit(fraction) * F.sum(n).over(whole)) - F.coalesce(F.sum(n).over(upto), F.lit(0))
    sizes = sizes.withColumn(take, wanted).where(F.col(take) > 0).select(*[F.col(c).alias(f"{_OWN}s{i}") for i, c in enumerate(strata)], F.col(part).alias(of), take)
    same = F.col(part) == F.col(of)
    for i, c in enumerate(strata):
        same = same & F.col(c).eqNullSafe(F.col(f"{_OWN}s{i}"))
    place = F.row_number().over(Window.partitionBy(*strata, part).orderBy(at, key))
    return sliced.join(sizes, same).withColumn(rank, place).where(F.col(rank) <= F.col(take)).select(*rows.columns)


def simple(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows of the table."""
    return rows.orderBy(*_by(seed, key)).limit(n)


def per_group(rows: DataFrame, group: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows of every group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*_by(seed, key)))
    return rows.withColumn(f"{_OWN}place", place).where(F.col(f"{_OWN}place") <= n).drop(f"{_OWN}place")
