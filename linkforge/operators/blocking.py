"""Blocking: candidate edges (s1_id, target_id) by shared keys. Every join is an equi-join on keys,
bounded by the frequency cap where there is one, and runs as Catalyst and AQE choose. Edges are told
apart where they arise, by the keys that both entities hold, so pairs are neither moved nor sorted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkforge.operators.postings import capped, frequencies, keys, postings, with_frequency
from linkforge.runtime import cut


def _held(posted: DataFrame, on: list[str], name: str) -> DataFrame:
    """Postings (name, *on), each once; those of an entity with several carry all of them as ``name``_keys."""
    own = posted.groupBy("id").agg(F.collect_set(F.struct(*on)).alias("keys"))
    own = own.select(F.col("id").alias(name), F.when(F.size("keys") > 1, F.col("keys")).alias(f"{name}_keys"), F.explode("keys").alias("k"))
    return own.select(name, f"{name}_keys", *[F.col(f"k.{c}").alias(c) for c in on])


def _shared() -> Column:
    return F.array_intersect("s1_id_keys", "target_id_keys")


def _edges(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Distinct edges of postings (id, *on) that agree on ``on``: a pair counts at the least key it shares."""
    alone = F.col("s1_id_keys").isNull() | F.col("target_id_keys").isNull()  # nothing else to share
    both = _held(right, on, "target_id").join(_held(left, on, "s1_id"), on)  # a sort-merge join buffers its right side
    return both.where(alone | (F.array_min(_shared()) == F.struct(*on))).select("s1_id", "target_id")


def _sides(s1: DataFrame, target: DataFrame, family: str, country_aware: bool, cap: int | None, drop_blank_country: bool = False) -> tuple[DataFrame, DataFrame]:
    """Postings of both sources that may meet: keys up to the cap, and with a country where that counts."""
    left, right = postings(s1, family), postings(target, family)
    if cap is not None:
        freq = frequencies(right)
        left = left.join(freq.where(F.col("freq") <= cap), "key", "left_semi")
        right = capped(right, freq, cap).drop("freq")
    if country_aware:
        left = left.where("country <> ''")
    if country_aware or drop_blank_country:
        right = right.where("country <> ''")
    return left, right


def shared_key(s1: DataFrame, target: DataFrame, family: str, country_aware: bool = False, cap: int | None = None, drop_blank_country: bool = False) -> DataFrame:
    """Edges of entities that share any key of a family, at most ``cap`` frequent in the target.

    Country-aware edges also need equal, non-empty countries. ``drop_blank_country`` leaves targets
    without a country out of the other kind too.
    """
    return _edges(*_sides(s1, target, family, country_aware, cap, drop_blank_country), ["country", "key"] if country_aware else ["key"])


def _rarest_two(posted: DataFrame, freq: DataFrame, cap: int) -> DataFrame:
    """(id, first, second): the two rarest keys up to the cap, ties by key; entities with fewer have none."""
    kept = capped(posted, freq, cap).groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("freq", "key"))), 1, 2).alias("two"))
    return kept.where(F.size("two") == 2).select("id", F.col("two")[0]["key"].alias("first"), F.col("two")[1]["key"].alias("second"))


def two_token_intersection(s1: DataFrame, target: DataFrame, family: str, cap: int) -> DataFrame:
    """Edges to targets that hold both of an S1 entity's two rarest keys."""
    right = postings(target, family)
    two = _rarest_two(postings(s1, family), frequencies(right), cap)
    own = right.select(F.col("id").alias("target_id"), "key")
    first = two.join(own, F.col("first") == F.col("key")).select("id", "second", "target_id")
    both = first.join(own.select(F.col("target_id").alias("t2"), F.col("key").alias("k2")), (F.col("second") == F.col("k2")) & (F.col("target_id") == F.col("t2")))
    return both.select(F.col("id").alias("s1_id"), "target_id").distinct()


def two_token_signature(s1: DataFrame, target: DataFrame, family: str, cap: int) -> DataFrame:
    """Edges of entities whose own two rarest keys are the same pair."""
    right = postings(target, family)
    freq = frequencies(right)

    def signature(posted: DataFrame) -> DataFrame:
        return _rarest_two(posted, freq, cap).select("id", F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b"))

    return _edges(signature(postings(s1, family)), signature(right), ["a", "b"])


def combine(parts: list[DataFrame], how: str) -> DataFrame:
    """Intersection or union of the edges of several families."""
    if how not in ("intersection", "union"):
        raise ValueError(f"unknown combination: {how}")
    if not parts:
        raise ValueError("nothing to combine")
    out = parts[0]
    for p in parts[1:]:
        out = out.intersect(p) if how == "intersection" else out.union(p)
    return out.distinct()


def postal_and_number(s1: DataFrame, target: DataFrame, number_cap: int | None, postal_cap: int | None = None, country_aware: bool = False, how: str = "intersection") -> DataFrame:
    """Edges by postal codes and by numbers, united or intersected.

    The postings of both families are told apart by ``place``. United, edges meet in either. Intersected,
    they meet in one family, the capped one if only one is, and are kept if they share a key of the other
    too, so the pairs of the other family are never made.
    """
    if how not in ("intersection", "union"):
        raise ValueError(f"unknown combination: {how}")
    families = [("number", number_cap), ("postal", postal_cap)]
    if number_cap is None and postal_cap is not None:
        families.reverse()
    sides = [[p.withColumn("place", F.lit(i)) for p in _sides(s1, target, f, country_aware, cap)] for i, (f, cap) in enumerate(families)]
    left, right = (sides[0][i].unionByName(sides[1][i]) for i in (0, 1))
    on = ["place", "country", "key"] if country_aware else ["place", "key"]
    if how == "union":
        return _edges(left, right, on)
    a, b = (_held(p, on, name).where(f"place = 0 and exists({name}_keys, k -> k.place = 1)") for p, name in ((left, "s1_id"), (right, "target_id")))
    least = F.array_min(_shared()) == F.struct(*on)
    return b.join(a, on).where(least & F.exists(_shared(), lambda k: k["place"] == 1)).select("s1_id", "target_id")


def _holds(held: str, *places: int) -> Column:
    """Whether an array of keys has one of these places."""
    return F.exists(held, lambda k: k["place"].isin(*places))


def _placed(prepared: DataFrame, families: list[str]) -> DataFrame:
    """(id, country, place, key): the postings of several families, told apart by ``place``."""
    at = lambda i: lambda k: F.struct(F.lit(i).alias("place"), k.alias("key"))
    each = [F.transform(F.array_distinct(keys(f)), at(i)) for i, f in enumerate(families)]
    own = prepared.select(F.col("entity_id").alias("id"), F.col("country_clean").alias("country"), F.explode(F.concat(*each)).alias("k"))
    return own.select("id", "country", "k.place", "k.key").where("key <> ''")


def _met(posted: DataFrame, on: list[str], name: str, needs: list[list[int]], true: DataFrame | None = None) -> DataFrame:
    """(name, keys): the keys of each entity that can meet, sorted; those of a stage's other families count only
    beside one of its first. With ``true`` (id, of), entities also carry whom they truly match."""
    first = sorted({n[0] for n in needs})
    rows = posted.select("id", F.struct(*on).alias("k"))
    aggs = [F.array_sort(F.collect_set("k")).alias("keys")]
    if true is not None:
        rows = rows.withColumn("of", F.lit(None).cast("string")).unionByName(true, allowMissingColumns=True)
        aggs.append(F.collect_set("of").alias("of"))
    own = rows.groupBy(F.col("id").alias(name)).agg(*aggs)
    own = own.where(_holds("keys", *first))
    useful = {p: _holds("keys", *[n[0] for n in needs if p in n]) for n in needs for p in n if p not in first}
    return own.withColumn("keys", F.filter("keys", lambda k: reduce(Column.__or__, [(k["place"] == p) & u for p, u in useful.items()], k["place"].isin(first))))


def tagged(s1: DataFrame, target: DataFrame, stages: list[list[tuple[str, int | None]]], country_aware: bool = False, truth: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """(s1_id, target_id, stages): the edges of several stages, each once; bit i is set where stage i has the edge.

    A stage is a list of (family, cap): its entities share a key up to the cap in every one of them. All stages
    come from one join: pairs meet in the first family of a stage, count at the least key they share there and
    take their bits from the keys that both entities hold, so no pair is moved. With ``truth`` (s1_id, target_id)
    edges tell whether they are ``true``. ``ordered`` adds ``candidate_order``, the 0-based rank of the target
    within its S1 entity; S1 entities that hold the same keys are ranked once.
    """
    places = list(dict.fromkeys([s[0] for s in stages] + [f for s in stages for f in s]))
    needs = [[places.index(f) for f in s] for s in stages]
    left, right = (_placed(e, [f for f, _ in places]) for e in (s1, target))
    limits = [(F.col("place") == i) & (F.col("freq") > cap) for i, (_, cap) in enumerate(places) if cap is not None]
    if limits:  # keys beyond a cap are few beside the postings, so these need not be moved to lose them
        over = right.where(F.col("place").isin([i for i, (_, cap) in enumerate(places) if cap is not None])).groupBy("place", "key").agg(F.count(F.lit(1)).alias("freq"))
        beyond = cut(over.where(reduce(Column.__or__, limits)).select("place", "key"), "beyond")
        left, right = (p.join(beyond, ["place", "key"], "left_anti") for p in (left, right))
    if country_aware:
        left, right = left.where("country <> ''"), right.where("country <> ''")
    on = ["place", "country", "key"] if country_aware else ["place", "key"]
    whom = truth.select(F.col("target_id").alias("id"), F.col("s1_id").alias("of")) if truth is not None else None
    a, b = _met(left, on, "s1_id", needs), _met(right, on, "target_id", needs, whom)
    if ordered:
        alike = a.groupBy("keys").agg(F.min("s1_id").alias("like"))
        members, a = a.join(alike, "keys").select("s1_id", "like"), alike.select(F.col("like").alias("s1_id"), "keys")

    def posted(own: DataFrame, name: str) -> DataFrame:
        out = own.withColumn(f"{name}_keys", F.when(F.size("keys") > 1, F.col("keys"))).withColumn("k", F.explode(F.filter("keys", lambda k: k["place"].isin(sorted({n[0] for n in needs})))))
        return out.select(*[c for c in own.columns if c != "keys"], f"{name}_keys", *[F.col(f"k.{c}").alias(c) for c in on])

    both = posted(b, "target_id").join(posted(a, "s1_id"), on)
    alone = F.col("s1_id_keys").isNull() | F.col("target_id_keys").isNull()
    both = both.where(alone | (F.array_min(_shared()) == F.struct(*on)))
    bit = lambda i, held: F.when(held, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    here = [bit(i, F.col("place") == n[0]) for i, n in enumerate(needs) if len(n) == 1]
    every = [bit(i, reduce(Column.__and__, [_holds("shared", p) for p in n])) for i, n in enumerate(needs)]
    add = lambda bits: reduce(Column.__add__, bits, F.lit(0).cast("long"))
    both = both.withColumn("shared", F.when(~alone, _shared())).withColumn("stages", F.when(alone, add(here)).otherwise(add(every))).where("stages <> 0")
    hit = [F.array_contains("of", F.col("s1_id")).alias("true")] if truth is not None else []
    if not ordered:
        return both.select("s1_id", "target_id", "stages", *hit)
    ranked = both.withColumn("candidate_order", F.row_number().over(Window.partitionBy("s1_id").orderBy("target_id")) - 1)
    ranked = ranked.select(F.col("s1_id").alias("rank_of"), *[c for c in ("target_id", "stages", "of", "candidate_order") if c in ranked.columns])
    return ranked.join(members, F.col("rank_of").eqNullSafe(F.col("like"))).select("s1_id", "target_id", "stages", *hit, "candidate_order")


def least_frequency(s1: DataFrame, target: DataFrame, family: str, cap: int, country_aware: bool = True) -> DataFrame:
    """(s1_id, target_id, least): edges up to a cap with the smallest frequency of their shared keys.

    An edge is there at every cap from ``least`` on, so one join serves all caps up to ``cap``.
    """
    right = postings(target, family)
    right = capped(right, frequencies(right), cap)
    if country_aware:
        right = right.where("country <> ''")
    on = ["country", "key"] if country_aware else ["key"]
    left = postings(s1, family).withColumnRenamed("id", "s1_id")
    edges = left.select("s1_id", *on).join(right.withColumnRenamed("id", "target_id").select("target_id", "freq", *on), on)
    return edges.groupBy("s1_id", "target_id").agg(F.min("freq").alias("least"))


def sweep(s1: DataFrame, target: DataFrame, family: str, caps: list[int], country_aware: bool = True) -> DataFrame:
    """(cap, pairs, entities): candidates at every cap from one join."""
    least = least_frequency(s1, target, family, max(caps), country_aware)
    at = least.withColumn("cap", F.explode(F.array(*[F.lit(c) for c in caps]))).where(F.col("least") <= F.col("cap"))
    per = at.groupBy("cap", "s1_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("cap").agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("entities"))


def surviving_entities(s1: DataFrame, target: DataFrame, family: str, cap: int) -> DataFrame:
    """S1 ids with a key up to the cap, counting keys that the target lacks."""
    return with_frequency(postings(s1, family), frequencies(postings(target, family))).where(F.col("freq") <= cap).select("id").distinct()
