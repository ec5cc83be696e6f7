"""Whole evaluations over small tables, against plain sets."""

import json
from itertools import product

import pytest
from pyspark.sql import functions as F

from linkforge import evaluations as ev
from linkforge.__main__ import main

_NAMES = ("acme foods ltd", "acme tools", "zeta mills", "oak foods", "zeta oak mills ltd", "solo")


def _rows():
    s1 = [(f"S1-{i}", _NAMES[i % 6], f"{i % 9} elm road {4000 + i % 5}", ("US", "India", "")[i % 3]) for i in range(30)]
    target = lambda n, odd: [(f"{n}-{i}", _NAMES[(i + (i % 4 == 0)) % 6].upper(), f"{i % 9} elm rd, {4000 + i % 5}", ("US", "India", "")[i % 3]) for i in range(odd, 60, 2)]
    lists = [(f"S1-{i}", ",".join([f"S2-{i}"] * (i % 2 == 0) + [f"S3-{i + 1}"] * (i % 2 == 0 and i % 3 == 0))) for i in range(30)]
    return s1, target("S2", 0), target("S3", 1), lists


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder, rows = tmp_path_factory.mktemp("er"), _rows()
    heads = ["entity_id\tbusiness_name\tbusiness_address\tcountry"] * 3 + ["source1_entity_id\tmatched_entity_ids"]
    for name, head, table in zip(("s1", "s2", "s3", "truth"), heads, rows, strict=True):
        (folder / f"{name}.tsv").write_text("\n".join([head, *("\t".join(r) for r in table)]) + "\n")
    return folder


@pytest.fixture(scope="module")
def data(spark, files):
    return ev.read_data(spark, *[f"{files}/{n}.tsv" for n in ("s1", "s2", "s3", "truth")])


def _shared(s1, target, cap, country):
    words = {r[0]: set(r[1].lower().split()) for r in (*s1, *target)}
    freq = {}
    for t in target:
        for w in words[t[0]]:
            freq[w] = freq.get(w, 0) + 1
    return {(a[0], b[0]) for a, b in product(s1, target) if (not country or (a[3] == b[3] and a[3])) and any(freq[w] <= cap for w in words[a[0]] & words[b[0]])}


def test_name_evaluation_equals_sets(data):
    s1, s2, s3, lists = _rows()
    got = {(r["target_source"], r["stage"]): r for r in ev.names(data, 1.0, caps=(8, 20))["metrics"].collect()}
    assert len(got) == 2 * 2 * 2 * 4
    for n, target in (("S2", s2), ("S3", s3)):
        true = {(a, t) for a, ts in lists for t in ts.split(",") if t.startswith(n)}
        for cap, (label, country) in product((8, 20), (("rare_token", False), ("country_rare_token", True))):
            want, r = _shared(s1, target, cap, country), got[n, f"{label}_name_token_unicode_freq{cap}"]
            assert (r["candidate_pairs"], r["true_pairs"], r["recovered_pairs"], r["entities"]) == (len(want), len(true), len(want & true), 30)


def test_validation_part_keeps_strata(data):
    ids = {r[0] for r in ev.validation_ids(data, 0.4, 1).collect()}
    assert ids == {r[0] for r in ev.validation_ids(data, 0.4, 1).collect()} and 9 <= len(ids) <= 15


def test_cumulative_and_errors(data):
    out = ev.cumulative(data, 1.0)
    rows = out["metrics"].where(F.col("target_source") == "S2").collect()
    assert [r["stage"] for r in rows] == ["name_token", "address_token", "number", "postal_number"]
    assert all(a["candidate_pairs"] <= b["candidate_pairs"] for a, b in zip(rows, rows[1:], strict=False))
    assert out["marginal"].count() == 6
    lost = ev.errors(data, 1.0)
    assert lost["categories"].agg(F.sum("pairs")).first()[0] == lost["recoverability"].agg(F.sum("pairs")).first()[0] > 0


@pytest.mark.parametrize("kind", ["baseline", "signals", "addresses", "normalization"])
def test_evaluate_command(spark, files, tmp_path, kind):
    sources = [x for n in ("s1", "s2", "s3", "truth") for x in (f"--{n}", f"{files}/{n}.tsv")]
    assert main(["evaluate", kind, *sources, "--output", f"{tmp_path}/out.json", "--validation-fraction", "0.5", "--sample-size", "10"]) == 0
    out = json.loads((tmp_path / "out.json").read_text())
    if kind == "baseline":
        assert {r["stage"] for r in out["metrics"]} == {"name_only", "compact_name", "country_name", "name_country_union"} and len(out["metrics"]) == 8
    if kind == "signals":
        assert len(out["metrics"]) == 2 * 2 * (1 + 6 + 6) and len(out["extraction"]) == 4
    if kind == "addresses":
        assert len(out["metrics"]) == 12 and len(out["marginal"]) == 2
    if kind == "normalization":
        assert len(out["collisions"]) == 3 * 8 and len(out["agreement"]) == 2 * 8 and all(r["pairs"] <= 10 for r in out["agreement"])
