"""Whole evaluations of blocking over entity tables: each gives tables of figures, by target source.

An evaluation reads ``Data`` (S1, the targets, the truth lists), measures on a stratified validation
part of S1, and takes key frequencies over all target records. Every target is measured on its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.functions import text
from linkforge.operators import blocking, candidates, diagnose, metrics, postings, quality, sampling
from linkforge.plans.spec import Strategy, compile_strategy
from linkforge.runtime import cut
from linkforge.sources.tables import TRUTH, read_tsv, truth_edges

NAME_CAPS = (10, 25, 50, 100, 250)
SIGNAL_CAPS = (5, 10, 25, 50, 100, 250)
REPRESENTATIONS = ("name_token_unicode", "name_token_compact")
_NAMES, _ADDRESSES = ("business_name", "name_clean", "name_compact", "name_core"), ("business_address", "address_clean", "address_compact", "address_core")


@dataclass(frozen=True)
class Data:
    """S1 and target entities (raw columns) and truth lists."""

    s1: DataFrame
    targets: dict[str, DataFrame]
    lists: DataFrame

    @property
    def truth(self) -> DataFrame:
        return truth_edges(self.lists)


def read_data(spark: SparkSession, s1: str, s2: str, s3: str, truth: str) -> Data:
    return Data(read_tsv(spark, s1), {"S2": read_tsv(spark, s2), "S3": read_tsv(spark, s3)}, read_tsv(spark, truth, TRUTH))


@dataclass(frozen=True)
class Part:
    """What the evaluations of one target share: written once, read by every strategy."""

    universe: DataFrame
    s1: DataFrame
    target: DataFrame
    truth: DataFrame


def validation_ids(data: Data, fraction: float, seed: int) -> DataFrame:
    """(s1_id): a part of the truth's S1 entities, by raw country and match bucket."""
    rows = data.lists.select(F.col("source1_entity_id").alias("s1_id"), text.match_bucket(F.col("matched_entity_ids")).alias("bucket"))
    known = rows.join(data.s1.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    return sampling.stratified(known, ["country", "bucket"], fraction, "s1_id", seed).select("s1_id").distinct()


def parts(data: Data, fraction: float = 0.2, seed: int = 42) -> dict[str, Part]:
    """One part per target source."""
    ids = cut(validation_ids(data, fraction, seed), "validation")
    own = data.s1.join(ids.withColumnRenamed("s1_id", "entity_id"), "entity_id", "left_semi")
    s1 = cut(postings.prepare(own), "s1")
    links = cut(data.truth.join(ids, "s1_id", "left_semi"), "truth")
    return {n: Part(ids, s1, cut(postings.prepare(t), "target"), links.where(F.col("target_source") == n).select("s1_id", "target_id")) for n, t in data.targets.items()}


def _each(found: dict[str, Part], rows: Callable[[Part], DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [rows(p).select(F.lit(n).alias("target_source"), "*") for n, p in found.items()])


def _measure(p: Part, stages: dict[str, DataFrame], cumulative: bool = False) -> DataFrame:
    return metrics.stage_metrics(p.universe, p.truth, p.target, stages, cumulative)


def normalization(data: Data, sample: int = 20_000, seed: int = 42) -> dict[str, DataFrame]:
    """Collisions of every text representation in every source, and agreement of sampled true pairs."""

    def forms(entities: DataFrame) -> DataFrame:
        out = postings.prepare(entities).withColumn("address_compact", text.compact(F.col("address_clean")))
        return out.withColumn("address_core", text.core(F.col("address_compact")))

    tables = {"S1": data.s1, **data.targets}
    every = {n: cut(forms(t), n) for n, t in tables.items()}
    collisions = reduce(DataFrame.unionAll, [quality.collisions(t, [*_NAMES, *_ADDRESSES], n) for n, t in every.items()])
    pairs = data.truth.withColumn("pair", F.concat_ws("|", "s1_id", "target_id"))
    chosen = cut(sampling.per_group(pairs, "target_source", sample, "pair", seed).select("s1_id", "target_source", "target_id"), "pairs")
    rows = []
    for n in data.targets:
        left = every["S1"].select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"a_{c}") for c in (*_NAMES, *_ADDRESSES)])
        right = every[n].select(F.col("entity_id").alias("target_id"), *[F.col(c).alias(f"b_{c}") for c in (*_NAMES, *_ADDRESSES)])
        both = cut(chosen.where(F.col("target_source") == n).join(left, "s1_id").join(right, "target_id"), "both")
        rows += [diagnose.agreement(both, f"a_{c}", f"b_{c}").select(F.lit(n).alias("target_source"), F.lit(c).alias("representation"), "*") for c in (*_NAMES, *_ADDRESSES)]
    return {"collisions": collisions, "agreement": reduce(DataFrame.unionAll, rows)}


_EXACT = {"name_only": Strategy("shared", "name"), "compact_name": Strategy("shared", "compact_name"), "country_name": Strategy("shared", "name", True)}


def _exact(p: Part) -> dict[str, DataFrame]:
    return {k: compile_strategy(s, p.s1, p.target) for k, s in _EXACT.items()}


def baseline(data: Data, fraction: float = 0.2, seed: int = 42) -> dict[str, DataFrame]:
    """Exact-name strategies; the union of name and country-and-name is the name strategy itself."""

    def rows(p: Part) -> DataFrame:
        found = _exact(p)
        return _measure(p, found | {"name_country_union": candidates.union_runs({k: ("", found[k]) for k in ("name_only", "country_name")})})

    return {"metrics": _each(parts(data, fraction, seed), rows)}


def names(data: Data, fraction: float = 0.2, seed: int = 42, caps: tuple[int, ...] = NAME_CAPS) -> dict[str, DataFrame]:
    """Token strategies at every cap in both representations: shared tokens (one join for all caps),
    shared within a country, both of the two rarest, and the same two rarest."""
    found = parts(data, fraction, seed)
    out = []
    for r in REPRESENTATIONS:
        for label, country in (("rare_token", False), ("country_rare_token", True)):
            out.append(_each(found, lambda p, r=r, c=country, n=label: metrics.cap_metrics(p.universe, p.truth, p.target, blocking.least_frequency(p.s1, p.target, r, max(caps), c), list(caps), f"{n}_{r}")))
        for label, kind in (("two_token_intersection", "intersection"), ("two_token_signature", "signature")):
            out.append(_each(found, lambda p, r=r, k=kind, n=label: _measure(p, {f"{n}_{r}_freq{c}": compile_strategy(Strategy(k, r, cap=c), p.s1, p.target) for c in caps})))
    return {"metrics": reduce(DataFrame.unionByName, out)}


def addresses(data: Data, fraction: float = 0.2, seed: int = 42, caps: tuple[int, ...] = SIGNAL_CAPS, name_cap: int = 250) -> dict[str, DataFrame]:
    """Address tokens within a country at every cap, and what the widest adds to name tokens."""
    found = parts(data, fraction, seed)

    def added(p: Part) -> DataFrame:
        stages = {"name_token": Strategy("shared", "name_token_unicode", True, name_cap), "address_token": Strategy("shared", "address_token", True, max(caps))}
        return metrics.marginal_recovery(p.universe, p.truth, {k: compile_strategy(s, p.s1, p.target) for k, s in stages.items()})

    by_cap = _each(found, lambda p: metrics.cap_metrics(p.universe, p.truth, p.target, blocking.least_frequency(p.s1, p.target, "address_token", max(caps)), list(caps), "country_address_token"))
    blocks = _each(found, lambda p: postings.block_statistics(postings.block_sizes(postings.postings(p.target, "address_token"))))
    return {"metrics": by_cap, "marginal": _each(found, added), "blocks": blocks}


def signals(data: Data, fraction: float = 0.2, seed: int = 42, caps: tuple[int, ...] = SIGNAL_CAPS) -> dict[str, DataFrame]:
    """Postal codes without a cap, numbers at every cap, and both together, with and without country."""
    found = parts(data, fraction, seed)
    out = []
    for country, word in ((False, ""), (True, "country_")):
        out.append(_each(found, lambda p, c=country, w=word: _measure(p, {f"{w}postal": compile_strategy(Strategy("shared", "postal", c), p.s1, p.target)})))
        out.append(_each(found, lambda p, c=country, w=word: metrics.cap_metrics(p.universe, p.truth, p.target, blocking.least_frequency(p.s1, p.target, "number", max(caps), c), list(caps), f"{w}number")))
        out.append(_each(found, lambda p, c=country, w=word: _measure(p, {f"{w}postal_number_freq{x}": compile_strategy(Strategy("postal_number", country_aware=c, cap=x), p.s1, p.target) for x in caps})))
    extraction = reduce(DataFrame.unionAll, [_each(found, lambda p, f=f: postings.extraction_statistics(p.target, f).withColumn("signal", F.lit(f))) for f in ("postal", "number")])
    return {"metrics": reduce(DataFrame.unionByName, out), "extraction": extraction}


def cumulative(data: Data, fraction: float = 0.2, seed: int = 42, cap: int = 250) -> dict[str, DataFrame]:
    """The union grown by name tokens, address tokens, numbers, and postal codes with numbers.

    Names and addresses keep a cap of 250; ``cap`` bounds numbers and postal codes.
    """

    def stages(p: Part) -> dict[str, DataFrame]:
        a, b = p.s1, p.target
        return {
            "name_token": blocking.shared_key(a, b, "name_token_unicode", True, 250),
            "address_token": blocking.shared_key(a, b, "address_token", True, 250),
            "number": blocking.shared_key(a, b, "number", True, cap),
            "postal_number": blocking.postal_and_number(a, b, cap, cap, True),
        }

    found = {n: (p, {k: cut(e, k) for k, e in stages(p).items()}) for n, p in parts(data, fraction, seed).items()}
    each = lambda rows: reduce(DataFrame.unionByName, [rows(p, e).select(F.lit(n).alias("target_source"), "*") for n, (p, e) in found.items()])
    return {"metrics": each(lambda p, e: _measure(p, e, True)), "marginal": each(lambda p, e: metrics.marginal_recovery(p.universe, p.truth, e))}


def errors(data: Data, fraction: float = 0.2, seed: int = 42, sample: int = 1000) -> dict[str, DataFrame]:
    """Why true pairs are missed by the exact-name strategies: categories, flags and examples of a sample."""
    found = parts(data, fraction, seed)
    own = {}
    for n, p in found.items():
        exact = candidates.union_runs({k: (n, e) for k, e in _exact(p).items()})
        lost = candidates.missed(p.truth, exact).withColumn("pair", F.concat_ws("|", "s1_id", "target_id"))
        chosen = cut(sampling.simple(lost, sample, "pair", seed).drop("pair"), "missed")
        own[n] = cut(diagnose.diagnose(diagnose.pair_frame(chosen, p.s1, p.target)), "diagnosed")
    each = lambda rows: reduce(DataFrame.unionByName, [rows(d).select(F.lit(n).alias("target_source"), "*") for n, d in own.items()])
    return {"categories": each(diagnose.categories), "recoverability": each(diagnose.recoverability), "examples": each(diagnose.examples)}


KINDS: dict[str, Callable[..., dict[str, DataFrame]]] = {
    "normalization": normalization, "baseline": baseline, "names": names, "addresses": addresses, "signals": signals, "cumulative": cumulative, "errors": errors,
}


def write_json(tables: dict[str, DataFrame], path: str) -> None:
    """All tables as one JSON document; they hold a few rows per strategy."""
    out = {name: [json.loads(r) for r in t.toJSON().collect()] for name, t in tables.items()}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=2, sort_keys=True, ensure_ascii=False)
        f.write("\n")
