"""Figures of grouped evaluation, provenance, block reports, extents, previews, file rules, inputs, profiling."""

import pytest

from linkforge.operators import features, metrics, persist, postings, quality, validate
from linkforge.profile import Profile
from linkforge.runtime import new_path

ENTITY = "entity_id string, business_name string, business_address string, country string"
EDGE = "s1_id string, target_id string"


def test_grouped_metrics_by_hand(spark):
    u = spark.createDataFrame([(f"S1-{i}",) for i in range(1, 6)], "s1_id string")
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-2", "S2-3"), ("S1-3", "S2-4")], EDGE)
    edges = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-9"), ("S1-2", "S2-3"), ("S1-2", "S2-8"), ("S1-4", "S2-1")], EDGE)
    predicted = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-3"), ("S1-4", "S2-1")], EDGE)
    ranked = spark.createDataFrame([("S1-1", "S2-1", 1), ("S1-1", "S2-9", 2), ("S1-2", "S2-8", 1), ("S1-2", "S2-3", 2), ("S1-4", "S2-1", 1)], f"{EDGE}, rank int")
    r = metrics.grouped_metrics(u, truth, edges, predicted, ranked, 2).first()
    assert (r["pair_precision"], r["pair_recall"], r["pair_f"]) == (2 / 3, 0.5, 4 / 7)
    assert (r["top_1_accuracy"], r["top_k_accuracy"]) == (1 / 3, 2 / 3)
    assert (r["complete_entity_recall"], r["abstention_rate"], r["false_alarm_rate"]) == (0.6, 0.4, 0.2)
    assert (r["conversion"], r["zero_candidate_rate"], r["incomplete_coverage_rate"]) == (0.6, 0.4, 0.2)
    empty = metrics.grouped_metrics(u.limit(0), truth.limit(0), edges.limit(0), predicted.limit(0), ranked.limit(0), 2).first()
    assert empty["pair_f"] is None and empty["abstention_rate"] is None


def test_provenance_flags(spark):
    tagged = spark.createDataFrame([("S1-1", "S2-1", 5), ("S1-1", "S2-2", 2)], f"{EDGE}, stages long")
    own = spark.createDataFrame([("S1-1", "S2-1", 1), ("S1-1", "S2-3", 0)], f"{EDGE}, name_exact int")
    rows = {r["target_id"]: r for r in features.with_provenance(own, tagged, ["name", "number", "postal"]).collect()}
    assert (rows["S2-1"]["from_name"], rows["S2-1"]["from_number"], rows["S2-1"]["from_postal"], rows["S2-1"]["family_count"]) == (1, 0, 1, 2)
    assert rows["S2-3"]["family_count"] == 0 and rows["S2-3"]["from_name"] == 0


def test_block_report_and_tokens(spark):
    own = postings.prepare(spark.createDataFrame([("S2-1", "a b", "1 Elm Oak", "US"), ("S2-2", "a", "2 Elm", "US"), ("S2-3", "", "", "")], ENTITY))
    r = postings.block_report(own, "address_token", 1).first()
    assert (r["distinct_keys"], r["keys_up_to_cap"], r["blocks"], r["max_block"]) == (2, 1, 2, 2)
    assert {tuple(r) for r in quality.token_counts(own, "name_compact").collect()} == {(0, 1), (1, 1), (2, 1)}


def test_characters_count_occurrences_and_rows(spark):
    t = spark.createDataFrame([("éé",), ("éa",), ("a",), (None,)], "v string")
    assert [tuple(r) for r in quality.non_ascii_characters(t, "v").collect()] == [("é", 3, 2)]


def test_extents_of_components(spark):
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-1"), ("S1-2", "S3-4"), ("S1-3", "S2-7"), ("S1-3", "S2-8")], EDGE)
    extents = quality.component_extents(truth)
    assert {tuple(r) for r in extents.collect()} == {("S1-1", 2, 1, 1), ("S1-3", 1, 2, 0)}
    assert tuple(quality.largest_components(extents).first()) == (2, 2, 2, 1, 2, 4)


def test_first_match_preview_and_length_shift(spark):
    lists = spark.createDataFrame([("S1-1", "S2-5,S2-1"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    assert [tuple(r) for r in quality.first_match(lists).collect()] == [("S1-1", "S2-5")]
    t = spark.createDataFrame([(f"S2-{i}", "x" * i) for i in range(1, 6)], "entity_id string, v string")
    assert {(r["part"], r["entity_id"]) for r in quality.preview(t, 2).collect()} == {("head", "S2-1"), ("head", "S2-2"), ("tail", "S2-4"), ("tail", "S2-5")}
    r = quality.length_shift(t.where("v <= 'xx'"), t, ["v"]).first()
    assert (r["train_mean"], r["test_mean"], r["mean_difference"], r["test_median"]) == (1.5, 3.0, 1.5, 3.0)


def test_missing_and_empty_files_and_long_examples(spark, tmp_path):
    need = spark.createDataFrame([("S1-1",)], "s1_id string")
    missing = validate.file_issues(spark, f"{tmp_path}/none.tsv", "matching", need).collect()
    assert [(r["rule"], r["n"]) for r in missing] == [("missing_file", 1)]
    (tmp_path / "empty.tsv").write_text("")
    assert {r["rule"] for r in validate.file_issues(spark, f"{tmp_path}/empty.tsv", "matching", need).collect()} == {"empty_file", "missing_s1"}
    (tmp_path / "long.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\t" + "S9-" + "1" * 500 + "\n")
    row = next(r for r in validate.file_issues(spark, f"{tmp_path}/long.tsv", "matching", need).collect() if r["rule"] == "wrong_prefix")
    assert row["examples"] == "S9-" + "1" * 197


def test_checksums_of_inputs(spark):
    u = spark.createDataFrame([("S1-1",)], "s1_id string")
    edges = spark.createDataFrame([("S1-1", "S2-1")], EDGE)
    source = spark.createDataFrame([("S2-1", "é", None, "US"), ("S2-2", "b", "c", "US")], ENTITY)
    path = new_path(spark, "p")
    persist.persist(u, edges, path, "m", "S2", inputs={"S2": source})
    assert persist.validate(spark, path, "m", "S2", u, {"S2": source.repartition(3)})["input_checksums"]["S2"].startswith("2:")
    with pytest.raises(ValueError, match="input differs"):
        persist.validate(spark, path, "m", "S2", u, {"S2": source.limit(1)})
    assert persist.checksum(source, []) != persist.checksum(source.unionAll(source.limit(1)), [])
    assert source.select(persist.line(["business_name"])).first()[0] == '{"business_name":"\\u00E9"}'


def test_profile_of_a_run(spark):
    ticks = iter([0.0, 1.5, 2.0, 2.5])
    p = Profile(clock=lambda: next(ticks))
    for _ in range(2):
        with p.phase("load"):
            p.count("rows", 3)
    assert p.seconds == {"load": 2.0} and p.counters == {"rows": 6}
    assert {tuple(r) for r in p.rows(spark).collect()} == {("seconds", "load", 2.0), ("counter", "rows", 6.0)}
