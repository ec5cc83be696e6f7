"""Set algebra over candidate edges. Runs are tagged with stage bits and folded once, so every union
and every marginal figure comes from one aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_runs(runs: dict[str, tuple[str, DataFrame]], allow_empty: bool = False) -> DataFrame:
    """Distinct edges of named runs (target source, edges); mixed targets are an error."""
    if not runs:
        if allow_empty:
            return None
        raise ValueError("no runs to unite")
    if len({t for t, _ in runs.values()}) > 1:
        raise ValueError("runs of different targets cannot be united")
    return reduce(DataFrame.union, [e.select("s1_id", "target_id") for _, e in runs.values()]).distinct()


def tag(stages: list[DataFrame]) -> DataFrame:
    """(s1_id, target_id, stages): bit i is set where stage i has the edge."""
    rows = [e.select("s1_id", "target_id", F.lit(1 << i).cast("long").alias("b")) for i, e in enumerate(stages)]
    return reduce(DataFrame.unionAll, rows).groupBy("s1_id", "target_id").agg(F.bit_or("b").alias("stages"))


def upto(stage: int) -> Column:
    """Whether a tagged edge is in the union of stages 0 to ``stage``."""
    return F.col("stages").bitwiseAND(F.lit((1 << (stage + 1)) - 1).cast("long")) != 0


def counts(universe: DataFrame, edges: DataFrame) -> DataFrame:
    """(s1_id, candidates) for every entity of the universe, zeros included."""
    per = edges.groupBy("s1_id").agg(F.count(F.lit(1)).alias("candidates"))
    return universe.select("s1_id").join(per, "s1_id", "left").select("s1_id", F.coalesce("candidates", F.lit(0)).alias("candidates"))


def candidate_order(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Edges with the 0-based rank of the target within its S1 entity."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("s1_id").orderBy(*(by or []), "target_id")
    return edges.withColumn("candidate_order", F.row_number().over(w) - 1)


def missed(truth: DataFrame, edges: DataFrame) -> DataFrame:
    """True pairs that no candidate covers."""
    return truth.join(edges, ["s1_id", "target_id"], "left_anti")
