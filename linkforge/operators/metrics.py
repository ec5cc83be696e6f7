"""Blocking metrics. Every figure starts from the universe, so entities without candidates count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.functions.text import f05
from linkforge.operators.candidates import counts, tag, upto

FIELDS = (
    "candidate_pairs", "true_pairs", "recovered_pairs", "pair_recall", "complete_entities", "complete_entity_recall", "reduction_ratio",
    "mean_candidates", "median_candidates", "p95_candidates", "p99_candidates", "max_candidates", "zero_entities", "entities",
)


def _per_entity(universe: DataFrame, truth: DataFrame, tagged: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Per S1 entity: true pairs, and per named flag its candidates and recovered pairs.

    Edges that tell whether they are ``true`` are counted where they arise; others are joined with the truth.
    """
    if "true" in tagged.columns:
        aggs = [x for n, f in flags.items() for x in (F.count_if(f).alias(f"{n}_n"), F.count_if(f & F.col("true")).alias(f"{n}_hit"))]
        own = truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("truth"))
        return universe.select("s1_id").join(own, "s1_id", "left").join(tagged.groupBy("s1_id").agg(*aggs), "s1_id", "left").fillna(0)
    true = truth.select("s1_id", "target_id", F.lit(1).alias("true"))
    both = tagged.join(true, ["s1_id", "target_id"], "full").withColumn("stages", F.coalesce("stages", F.lit(0)))
    aggs = [F.count_if(F.col("true") == 1).alias("truth")]
    for name, flag in flags.items():
        aggs += [F.count_if(flag).alias(f"{name}_n"), F.count_if(flag & (F.col("true") == 1)).alias(f"{name}_hit")]
    return universe.select("s1_id").join(both.groupBy("s1_id").agg(*aggs), "s1_id", "left").fillna(0)


def _figures(name: str, targets: Column) -> Column:
    n, hit = F.col(f"{name}_n"), F.col(f"{name}_hit")
    pct = F.percentile(n, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    true, got, pairs, all_ = F.sum("truth"), F.sum(hit), F.sum(n), F.count(F.lit(1))
    complete = F.count_if(hit == F.col("truth"))
    space = (all_ * F.max(targets)).cast("double")
    return F.struct(
        F.lit(name).alias("stage"),
        F.coalesce(pairs, F.lit(0)).alias("candidate_pairs"),
        F.coalesce(true, F.lit(0)).alias("true_pairs"),
        F.coalesce(got, F.lit(0)).alias("recovered_pairs"),
        F.coalesce(F.try_divide(got, true), F.lit(1.0)).alias("pair_recall"),
        complete.alias("complete_entities"),
        F.coalesce(F.try_divide(complete, all_), F.lit(1.0)).alias("complete_entity_recall"),
        F.coalesce(1 - F.try_divide(pairs, space), F.lit(0.0)).alias("reduction_ratio"),
        F.avg(n).alias("mean_candidates"),
        pct[0].alias("median_candidates"),
        pct[1].alias("p95_candidates"),
        pct[2].alias("p99_candidates"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_candidates"),
        F.count_if(n == 0).alias("zero_entities"),
        all_.alias("entities"),
    )


def stage_metrics(universe: DataFrame, truth: DataFrame, target: DataFrame, stages: dict[str, DataFrame], cumulative: bool = False) -> DataFrame:
    """One row of metrics per stage, or per union of the stages so far; one aggregation for all."""
    return tagged_metrics(universe, truth, target, tag(list(stages.values())), list(stages), cumulative)


def tagged_metrics(universe: DataFrame, truth: DataFrame, target: DataFrame, tagged: DataFrame, names: list[str], cumulative: bool = False) -> DataFrame:
    """``stage_metrics`` of edges that carry stage bits."""
    flags = {n: upto(i) if cumulative else F.col("stages").bitwiseAND(F.lit(1 << i).cast("long")) != 0 for i, n in enumerate(names)}
    return _metric_rows(universe, truth, target, tagged, flags)


def _metric_rows(universe: DataFrame, truth: DataFrame, target: DataFrame, tagged: DataFrame, flags: dict[str, Column]) -> DataFrame:
    size = target.agg(F.count(F.lit(1)).alias("targets"))
    per = _per_entity(universe, truth, tagged, flags).crossJoin(F.broadcast(size))  # a single row
    return per.agg(F.array(*[_figures(n, F.col("targets")) for n in flags]).alias("m")).select(F.inline("m"))


def cap_metrics(universe: DataFrame, truth: DataFrame, target: DataFrame, edges: DataFrame, caps: list[int], name: str = "run") -> DataFrame:
    """One row of metrics per frequency cap of ``edges`` (s1_id, target_id, least), from one join."""
    bits = sum((F.when(F.col("least") <= c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(caps)), F.lit(0).cast("long"))
    flags = {f"{name}_freq{c}": F.col("stages").bitwiseAND(F.lit(1 << i).cast("long")) != 0 for i, c in enumerate(caps)}
    return _metric_rows(universe, truth, target, edges.select("s1_id", "target_id", bits.alias("stages")), flags)


def blocking_metrics(universe: DataFrame, truth: DataFrame, target: DataFrame, edges: DataFrame, name: str = "run") -> DataFrame:
    return stage_metrics(universe, truth, target, {name: edges})


def marginal_recovery(universe: DataFrame, truth: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """What each stage adds to the union of those before it; one row per stage but the first."""
    return tagged_recovery(universe, truth, tag(list(stages.values())), list(stages))


def tagged_recovery(universe: DataFrame, truth: DataFrame, tagged: DataFrame, names: list[str]) -> DataFrame:
    """``marginal_recovery`` of edges that carry stage bits."""
    per = _per_entity(universe, truth, tagged, {n: upto(i) for i, n in enumerate(names)})
    rows = []
    for before, now in zip(names, names[1:], strict=False):
        b, n, t = F.col(f"{before}_hit"), F.col(f"{now}_hit"), F.col("truth")
        gained = F.sum(n) - F.sum(b)
        added = F.sum(f"{now}_n") - F.sum(f"{before}_n")
        rows.append(
            F.struct(
                F.lit(now).alias("stage"),
                gained.alias("new_pairs"),
                F.count_if((b < t) & (n == t)).alias("new_complete"),
                F.sum(f"{before}_n").alias("before"),
                F.sum(f"{now}_n").alias("after"),
                added.alias("added"),
                F.coalesce(F.try_divide(gained, F.sum("truth")), F.lit(0.0)).alias("marginal_recall"),
                F.try_divide(added, gained).alias("cost"),
                F.try_divide(F.sum(f"{now}_n"), F.sum(f"{before}_n")).alias("growth"),
                F.try_divide(gained * 1_000_000, F.sum("truth") * added).alias("recall_per_million"),
                F.sum(t - b).alias("missed_before"),
                F.coalesce(F.try_divide(gained, F.sum(t - b)), F.lit(0.0)).alias("share_of_missed"),
            )
        )
    return per.agg(F.array(*rows).alias("m")).select(F.inline("m"))


def distribution(universe: DataFrame, edges: DataFrame) -> DataFrame:
    """(candidates, entities): how many entities have how many candidates, zero included."""
    return counts(universe, edges).groupBy("candidates").agg(F.count(F.lit(1)).alias("entities"))


def entity_scores(universe: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per S1 entity: precision, recall and F0.5 of its predicted targets.

    An entity without truth scores 1 if nothing is predicted for it and 0 otherwise.
    """
    per = _per_entity(universe, truth, predicted.select("s1_id", "target_id", F.lit(1).cast("long").alias("stages")).distinct(), {"p": F.col("stages") == 1})
    p = F.coalesce(F.try_divide("p_hit", "p_n"), F.lit(0.0))
    r = F.coalesce(F.try_divide("p_hit", "truth"), F.lit(0.0))
    score = F.when(F.col("truth") == 0, (F.col("p_n") == 0).cast("double")).otherwise(f05(p, r))
    return per.select("s1_id", "truth", F.col("p_n").alias("predicted"), F.col("p_hit").alias("hits"), p.alias("precision"), r.alias("recall"), score.alias("f05"))


def macro_f05(universe: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: F0.5 averaged over all S1 entities, and pair precision and recall."""
    s = entity_scores(universe, truth, predicted)
    return s.agg(
        F.avg("f05").alias("macro_f05"),
        F.coalesce(F.try_divide(F.sum("hits"), F.sum("predicted")), F.lit(0.0)).alias("pair_precision"),
        F.coalesce(F.try_divide(F.sum("hits"), F.sum("truth")), F.lit(1.0)).alias("pair_recall"),
        F.count_if(F.col("predicted") == 0).alias("abstentions"),
        F.count(F.lit(1)).alias("entities"),
    )


def grouped_metrics(universe: DataFrame, truth: DataFrame, edges: DataFrame, predicted: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """One row of pair and entity figures of candidates, predictions and ranks (s1_id, target_id, rank).

    Every S1 entity counts in the rates; the accuracies are over those with true targets, and an
    entity is right at k if one of its first k targets is true. Conversion is predictions per candidate.
    """
    tagged = tag([edges.distinct(), predicted.distinct(), ranked.where("rank = 1"), ranked.where(F.col("rank") <= k)])
    flags = {n: F.col("stages").bitwiseAND(F.lit(1 << i).cast("long")) != 0 for i, n in enumerate(("c", "p", "one", "k"))}
    per = _per_entity(universe, truth, tagged, flags)
    true, all_ = F.col("truth") > 0, F.count(F.lit(1))
    rate = lambda c: F.try_divide(F.count_if(c), all_)
    right = lambda c: F.try_divide(F.count_if(true & (F.col(c) > 0)), F.count_if(true))
    return per.agg(
        F.try_divide(F.sum("p_hit"), F.sum("p_n")).alias("pair_precision"),
        F.try_divide(F.sum("p_hit"), F.sum("truth")).alias("pair_recall"),
        F.try_divide(2 * F.sum("p_hit"), F.sum("p_n") + F.sum("truth")).alias("pair_f"),
        right("one_hit").alias("top_1_accuracy"),
        right("k_hit").alias("top_k_accuracy"),
        rate(F.col("p_hit") == F.col("truth")).alias("complete_entity_recall"),
        rate(F.col("p_n") == 0).alias("abstention_rate"),
        rate(~true & (F.col("p_n") > 0)).alias("false_alarm_rate"),
        F.try_divide(F.sum("p_n"), F.sum("c_n")).alias("conversion"),
        rate(F.col("c_n") == 0).alias("zero_candidate_rate"),
        rate((F.col("c_n") > 0) & (F.col("c_hit") < F.col("truth"))).alias("incomplete_coverage_rate"),
    )


def cost_model(metrics: DataFrame, ms_per_pair: list[float], bytes_per_pair: list[int]) -> DataFrame:
    """Modelled scoring seconds and gibibytes of each stage at several costs per pair."""
    grid = metrics.select("stage", "candidate_pairs").withColumn("ms", F.explode(F.array(*[F.lit(float(m)) for m in ms_per_pair]))).withColumn("pair_bytes", F.explode(F.array(*[F.lit(b) for b in bytes_per_pair])))
    return grid.select("stage", "ms", "pair_bytes", (F.col("candidate_pairs") * F.col("ms") / 1000).alias("seconds"), (F.col("candidate_pairs") * F.col("pair_bytes") / float(1 << 30)).alias("gib"))
