"""Blocking strategies against plain set logic, with their algebra and plans."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkforge.operators import blocking, candidates, metrics, postings
from linkforge.plans.spec import Strategy, absorb, compile_stages, compile_strategy, covers

S1 = [("S1-1", "Acme Foods Ltd", "12 Main St, 78701", "US"), ("S1-2", "Zeta Unseen", "34 Oak Rd, 411001", "India"), ("S1-3", "Acme Foods", "", ""), ("S1-4", "", "12 Main St", "US")]
S2 = [
    ("S2-1", "ACME foods ltd", "12 Main Street 78701", "us"), ("S2-2", "Acme Tools", "56 Main St 78701", "US"), ("S2-3", "Zeta Works", "34 Oak Road 411001", "India"),
    ("S2-4", "Foods Acme", "12 Elm", ""), ("S2-5", "Acme Foods", "99 Market", "India"), ("S2-6", "", "", "US"),
]


@pytest.fixture(scope="module")
def sources(spark):
    schema = "entity_id string, business_name string, business_address string, country string"
    return tuple(postings.prepare(spark.createDataFrame(r, schema)).cache() for r in (S1, S2))


def pairs(df):
    return {(r["s1_id"], r["target_id"]) for r in df.collect()}


def plain(sources, family, country=False, cap=None):
    rows = [[(r["entity_id"], r["country_clean"], set(r["k"]) - {""}) for r in s.select("*", postings.keys(family).alias("k")).collect()] for s in sources]
    freq = Counter(k for _, _, ks in rows[1] for k in ks)
    return {
        (a, b) for a, ca, ka in rows[0] for b, cb, kb in rows[1]
        if (not country or (ca and ca == cb)) and any(cap is None or freq[k] <= cap for k in ka & kb)
    }


@pytest.mark.parametrize("family", ["name", "compact_name", "name_token_unicode", "name_token_compact", "address_token", "postal", "number"])
@pytest.mark.parametrize("country", [False, True])
@pytest.mark.parametrize("cap", [None, 1, 2, 10])
def test_shared_keys(sources, family, country, cap):
    assert pairs(blocking.shared_key(*sources, family, country, cap)) == plain(sources, family, country, cap)


def test_unseen_tokens_come_first(sources):
    # "unseen" has frequency 0 in the target, sorts first and leaves S1-2 without candidates.
    got = pairs(blocking.two_token_intersection(*sources, "name_token_unicode", 10))
    assert not any(a == "S1-2" for a, _ in got)
    assert ("S1-3", "S2-4") in got and ("S1-3", "S2-5") in got
    assert "S1-2" in {r["id"] for r in blocking.surviving_entities(*sources, "name_token_unicode", 1).collect()}


def test_signature_lies_within_intersection(sources):
    for cap in (2, 4, 10):
        assert pairs(blocking.two_token_signature(*sources, "name_token_unicode", cap)) <= pairs(blocking.two_token_intersection(*sources, "name_token_unicode", cap))


def test_combinations_and_errors(sources):
    p, n = pairs(blocking.shared_key(*sources, "postal")), pairs(blocking.shared_key(*sources, "number", cap=2))
    assert pairs(blocking.postal_and_number(*sources, 2)) == p & n and pairs(blocking.postal_and_number(*sources, 2, how="union")) == p | n
    for bad in (lambda: blocking.combine([], "union"), lambda: blocking.combine([sources[0]], "xor"), lambda: postings.keys("nope"), lambda: compile_strategy(Strategy("nope"), *sources)):
        with pytest.raises(ValueError):
            bad()


def test_blank_country_targets(sources):
    every, known = pairs(blocking.shared_key(*sources, "name_token_unicode")), pairs(blocking.shared_key(*sources, "name_token_unicode", drop_blank_country=True))
    assert every - known == {p for p in every if p[1] == "S2-4"}


def test_sweep_equals_single_runs(sources):
    rows = {r["cap"]: (r["pairs"], r["entities"]) for r in blocking.sweep(*sources, "name_token_unicode", [1, 2, 3, 9]).collect()}
    for cap in (1, 2, 3, 9):
        own = pairs(blocking.shared_key(*sources, "name_token_unicode", True, cap))
        assert rows.get(cap, (0, 0)) == (len(own), len({a for a, _ in own}))


def test_absorption_keeps_the_union(sources):
    union = [Strategy("shared", "number", True, 10), Strategy("postal_number", country_aware=True, cap=10), Strategy("shared", "name", True), Strategy("shared", "name")]
    kept = absorb(union)
    assert kept == [union[0], union[3]]
    run = lambda ss: set().union(*(pairs(compile_strategy(s, *sources)) for s in ss))
    assert run(kept) == run(union)
    for a in union:
        for b in union:
            if covers(a, b):
                assert pairs(compile_strategy(b, *sources)) <= pairs(compile_strategy(a, *sources))
    assert absorb([union[2], union[2]]) == [union[2]]


def test_plans_have_no_cartesian_product(sources):
    for s in (Strategy("shared", "postal", True), Strategy("shared", "name_token_unicode", True, 5), Strategy("intersection", "name_token_unicode", cap=5), Strategy("signature", "name_token_unicode", cap=5), Strategy("postal_number", cap=5)):
        plan = compile_strategy(s, *sources)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_marginal_recovery_literals(spark):
    edge = lambda *e: spark.createDataFrame(list(e) or [], "s1_id string, target_id string")
    u = spark.createDataFrame([(f"S1-{i}",) for i in (1, 2, 3, 4)], "s1_id string")
    truth = edge(("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-2", "S2-3"), ("S1-3", "S2-4"))
    r = metrics.marginal_recovery(u, truth, {"a": edge(("S1-1", "S2-1")), "b": edge(("S1-1", "S2-2"), ("S1-2", "S2-3"))}).first()
    assert (r["new_pairs"], r["new_complete"], r["before"], r["after"], r["marginal_recall"], r["missed_before"], r["cost"]) == (2, 2, 1, 3, 0.5, 3, 1.0)
    none = metrics.marginal_recovery(u, truth, {"a": edge(("S1-1", "S2-1")), "b": edge(("S1-1", "S2-1"), ("S1-4", "S2-9"))}).first()
    assert none["new_pairs"] == 0 and none["cost"] is None and none["added"] == 1


def test_metrics_keep_entities_without_candidates(spark):
    u = spark.createDataFrame([(f"S1-{i}",) for i in range(1, 5)], "s1_id string")
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-2")], "s1_id string, target_id string")
    edges = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-3")], "s1_id string, target_id string")
    target = spark.range(10)
    r = metrics.blocking_metrics(u, truth, target, edges).first()
    assert (r["pair_recall"], r["complete_entity_recall"], r["zero_entities"], r["mean_candidates"], r["reduction_ratio"]) == (0.5, 0.75, 3, 0.5, 1 - 2 / 40)
    assert r["p95_candidates"] == pytest.approx(1.7)
    empty = metrics.blocking_metrics(u, truth.limit(0), target, edges.limit(0)).first()
    assert (empty["pair_recall"], empty["complete_entity_recall"], empty["candidate_pairs"]) == (1.0, 1.0, 0)
    f = metrics.macro_f05(u, truth, edges).first()
    one = 1.25 * 0.5 * 1.0 / (0.25 * 0.5 + 1.0)
    assert f["macro_f05"] == pytest.approx((one + 0 + 1 + 1) / 4)


def test_union_rules(spark):
    e = spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, target_id string")
    assert candidates.union_runs({"a": ("S2", e), "b": ("S2", e)}).count() == 1
    assert candidates.union_runs({}, allow_empty=True) is None
    for bad in ({}, {"a": ("S2", e), "b": ("S3", e)}):
        with pytest.raises(ValueError):
            candidates.union_runs(bad)


def test_block_statistics(spark):
    sizes = spark.createDataFrame([(101,), (1,)], "size long")
    r = postings.block_statistics(sizes).first()
    assert (r["blocks"], r["over_100"], r["max_block"]) == (2, 1, 101)
    assert postings.block_statistics(sizes.limit(0)).first()["max_block"] == 0


def test_cost_model(spark):
    m = spark.createDataFrame([("s", 1000)], "stage string, candidate_pairs long")
    r = metrics.cost_model(m, [2.0], [512]).first()
    assert (r["seconds"], r["gib"]) == (2.0, pytest.approx(0.0004768371582))
    assert F is not None


def above_join(df):
    """What the optimised plan does with pairs once they are joined."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


@pytest.mark.parametrize("country", [False, True])
def test_pairs_are_not_moved_to_be_told_apart(spark, country):
    schema = "entity_id string, business_name string, business_address string, country string"
    a = [("S1-1", "x", "12 Elm 78701, 78702", "US"), ("S1-1", "x", "12 Elm 78702, 78703", "India"), ("S1-2", "y", "5 Oak 78703", ""), (None, "z", "9 Ash 78701", "US")]
    b = [("S2-1", "x", "12 Elm 78702, 78701", "US"), ("S2-1", "x", "7 Elm 78703", "India"), ("S2-2", "y", "5 Oak 78703", "France"), (None, "z", "9 Ash 78701", "US")]
    pair = tuple(postings.prepare(spark.createDataFrame(r, schema)) for r in (a, b))
    got = blocking.shared_key(*pair, "postal", country)
    assert "Aggregate" not in above_join(got)
    rows = [(r["s1_id"], r["target_id"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain(pair, "postal", country)


@pytest.mark.parametrize("country", [False, True])
@pytest.mark.parametrize("caps", [(2, None), (None, 2), (None, None), (1, 1)])
def test_postal_codes_and_numbers_meet_once(sources, country, caps):
    n, p = plain(sources, "number", country, caps[0]), plain(sources, "postal", country, caps[1])
    for how, want in (("intersection", n & p), ("union", n | p)):
        got = blocking.postal_and_number(*sources, *caps, country, how)
        assert "Aggregate" not in above_join(got) and "Union" not in above_join(got)
        rows = [(r["s1_id"], r["target_id"]) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("name", ["candidate_families", "cost_model", "marginal_recovery", "metrics_by_stage", "metrics_cumulative", "metrics_cumulative_s3", "pair_provenance", "stage_tags"])
def test_stages_never_join_postal_codes_alone(spark, sf, name):
    from linkforge.queries import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Intersect" not in plan and "place#" in plan


STAGED = [("name_token_unicode", 2), ("address_token", 2), ("number", 2)]


@pytest.mark.parametrize("country", [False, True])
@pytest.mark.parametrize("alone", [False, True])
def test_stages_come_from_one_join(spark, sources, country, alone):
    of = [Strategy("shared", f, country, c) for f, c in STAGED] + [Strategy("postal_number", country_aware=country, cap=2)]
    sets = [plain(sources, f, country, c) for f, c in STAGED]
    sets.append(sets[2] & plain(sources, "postal", country))
    of, sets = (of[3:], sets[3:]) if alone else (of, sets)
    want = {(a, b, sum(1 << i for i, s in enumerate(sets) if (a, b) in s)) for a, b in set().union(*sets)}
    true = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-3"), ("S1-2", "S2-5"), ("S1-9", "S2-9")], "s1_id string, target_id string")
    got = compile_stages(of, *sources, true)
    assert "Aggregate" not in above_join(got) and "Union" not in above_join(got)
    rows = [(r["s1_id"], r["target_id"], r["stages"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {(r["s1_id"], r["target_id"]) for r in got.where(F.col("true")).collect()} == {r[:2] for r in want} & {("S1-1", "S2-1"), ("S1-2", "S2-3"), ("S1-2", "S2-5")}
    ranked = [(r["s1_id"], r["target_id"], r["stages"], r["candidate_order"]) for r in compile_stages(of, *sources, ordered=True).collect()]
    assert sorted(ranked) == [(*e, sum(o[0] == e[0] and o[1] < e[1] for o in want)) for e in sorted(want)]


def test_entities_alike_are_ranked_once(spark):
    schema = "entity_id string, business_name string, business_address string, country string"
    a = [(f"S1-{i}", "Acme", "12 Elm", "US") for i in range(5)] + [(None, "Acme", "9 Ash", "US"), (None, "Zeta", "", "US"), ("S1-5", "Acme Zeta", "", "US"), ("S1-6", "Acme", "", "India")]
    b = [("S2-1", "Acme", "12 Elm", "US"), ("S2-2", "Zeta", "9 Ash", "US"), ("S2-2", "Acme", "9 Ash", "US"), ("S2-3", "Zeta", "12 Oak", "US"), (None, "Acme", "12", "India")]
    pair = tuple(postings.prepare(spark.createDataFrame(r, schema)) for r in (a, b))
    of = [Strategy("shared", "name_token_unicode", True, 9), Strategy("shared", "number", True, 9)]
    sets = [plain(pair, s.family, True, 9) for s in of]
    want = {(x, y): sum(1 << i for i, s in enumerate(sets) if (x, y) in s) for x, y in sets[0] | sets[1]}
    rows = [tuple(r) for r in compile_stages(of, *pair, ordered=True).select("s1_id", "target_id", "stages", "candidate_order").collect()]
    assert len(rows) == len(want) and {r[:2]: r[2] for r in rows} == want
    assert {r[:2]: r[3] for r in rows} == {(x, y): sum(o == x and (z or "") < (y or "") for o, z in want) for x, y in want}


@pytest.mark.parametrize("name", ["candidate_families", "cost_model", "marginal_recovery", "metrics_by_stage", "metrics_cumulative", "metrics_cumulative_s3", "pair_provenance", "stage_tags"])
def test_stages_are_not_grouped_or_joined_by_pair(spark, sf, name):
    from linkforge.queries import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Union" not in x and ("Aggregate [s1_id" in x and "target_id" in x.split("]")[0] or "Join FullOuter" in x)]
