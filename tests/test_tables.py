"""Sources, persistence, validation, components, sampling, quality, streaming, registry."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from linkforge.operators import components, diagnose, features, persist, postings, quality, sampling, validate
from linkforge.operators.components import connected_components
from linkforge.runtime import new_path
from linkforge.sources import tables
from linkforge.streaming import incremental


def test_tsv_reading_and_truth(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t Acme \t\tUS\nS1-2\tB\tx\t\n")
    rows = tables.read_tsv(spark, str(tmp_path / "s.tsv")).collect()
    assert [tuple(r) for r in rows] == [("S1-1", " Acme ", "", "US"), ("S1-2", "B", "x", "")]
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2,,S2-1\nS1-2\t\n")
    lists = tables.read_tsv(spark, str(tmp_path / "t.tsv"), tables.TRUTH)
    assert {tuple(r) for r in tables.truth_edges(lists).collect()} == {("S1-1", "S2", "S2-1"), ("S1-1", "S3", "S3-2")}
    assert {r[0] for r in tables.read_ids(spark, str(tmp_path / "t.tsv")).collect()} == {"S1-1", "S1-2"}
    inv = {r["name"]: (r["present"], r["bytes"]) for r in tables.inventory(spark, {"s": str(tmp_path / "s.tsv"), "no": str(tmp_path / "none")}).collect()}
    assert inv["s"][0] and inv["s"][1] > 0 and inv["no"] == (False, 0)
    tables.write_lists(tables.result_lists(lists.select(F.col("source1_entity_id").alias("s1_id")), tables.truth_edges(lists)), str(tmp_path / "out"))
    back = tables.read_tsv(spark, str(tmp_path / "out"), tables.TRUTH).collect()
    assert {tuple(r) for r in back} == {("S1-1", "S2-1,S3-2"), ("S1-2", "")}


def _run(spark):
    u = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    return u, spark.createDataFrame([("S1-2", "S2-3"), ("S1-2", "S2-1")], "s1_id string, target_id string")


def test_persist_replay_validate(spark):
    u, edges = _run(spark)
    path = new_path(spark, "p")
    summary = persist.persist(u, edges, path, "m", "S2", 5)
    assert summary["zero_candidate_rows"] == 1 and summary["s1_rows"] == 2
    back = persist.replay(spark, path, "m", "S2")
    assert [(r["s1_id"], r["target_id"], r["candidate_order"]) for r in back.orderBy("candidate_order").collect()] == [("S1-2", "S2-1", 0), ("S1-2", "S2-3", 1)]
    assert persist.validate(spark, path, "m", "S2", u)["candidate_checksum"] == summary["candidate_checksum"]
    with pytest.raises(ValueError, match="S1 manifest"):
        persist.validate(spark, path, "m", "S2", u.limit(1))
    with pytest.raises(ValueError, match="S2 or S3"):
        persist.persist(u, edges, path, "m", "S1")
    again = persist.persist(u, edges.orderBy(F.desc("target_id")), new_path(spark, "p"), "m", "S2", 5)
    assert again["candidate_checksum"] == summary["candidate_checksum"]


def test_provenance_and_states(spark):
    u, _ = _run(spark)
    edges = spark.createDataFrame([("S1-2", "S2-3", 1), ("S1-2", "S2-1", 2), ("S1-2", "S2-1", 1)], "s1_id string, target_id string, stages long")
    schema = "entity_id string, business_name string, business_address string, country string"
    own = postings.prepare(spark.createDataFrame([("S1-1", "", "", ""), ("S1-2", "Acme", "12 Oak", "US")], schema))
    rows = persist.edge_table(edges, "m", "S2", 5, "v1", ["name", "number"], persist.availability(own)).orderBy("candidate_order").collect()
    assert [(r["target_id"], r["blocking_families"], r["split_id"]) for r in rows] == [("S2-1", ["name", "number"], "v1"), ("S2-3", ["name"], "v1")]
    assert rows[0]["signal_availability"].asDict() == {"name": True, "address_token": True, "postal": False, "number": True, "country": True}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    none = edges.limit(0)
    reasons = lambda s, m: [r["reason"] for r in persist.manifest_table(u, none, "S2", s, m).orderBy("s1_id").collect()]
    assert reasons(ids("S1-2"), ids()) == ["zero_candidates_missing_signals", "zero_candidates_no_matching_index_keys"]
    assert reasons(ids("S1-2"), ids("S1-2"))[1] == "zero_candidates_filtered_or_invalid_keys"
    manifest = persist.manifest_table(u, edges, "S2", ids("S1-2"))
    truth = spark.createDataFrame([("S1-2", "S2-1"), ("S1-2", "S2-9")], "s1_id string, target_id string")
    states = lambda t, known=None: [r["state"] for r in persist.coverage(manifest, edges, t, known).orderBy("s1_id").collect()]
    assert states(truth) == ["zero_candidates_missing_signals", "has_candidates_incomplete_entity_coverage"]
    assert states(truth.limit(1))[1] == "has_candidates_complete_entity_coverage"
    assert states(truth, u.limit(0))[1] == "coverage_unknown"


def test_replay_rejects_repeats_and_other_targets(spark):
    u, edges = _run(spark)
    for wrong, message in ((persist.edge_table(edges, "m", "S3", 1), "another target"), (persist.edge_table(edges, "m", "S2", 1).unionAll(persist.edge_table(edges, "m", "S2", 1)), "repeated")):
        path = new_path(spark, "p")
        wrong.write.parquet(f"{path}/m/S2/candidates")
        with pytest.raises(ValueError, match=message):
            persist.replay(spark, path, "m", "S2")
    assert u.count() == 2


def test_validator_rules(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\nS1-1\tS2-2\n\nS1-2\tS1-2\nbroken\nS1-9\tX-1\n")
    lines = validate.read_lines(spark, str(tmp_path / "m.tsv"))
    need = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "s1_id string")
    known = spark.createDataFrame([("S2-1",), ("S2-2",)], "entity_id string")
    got = {r["rule"]: r["n"] for r in validate.list_issues(lines, "matching", need, known).collect()}
    assert got == {"malformed_row": 1, "repeated_s1_row": 1, "repeated_id_in_list": 1, "self_match": 1, "wrong_prefix": 2, "missing_s1": 1, "extra_s1": 1, "unknown_id": 2}
    assert {tuple(r) for r in validate.last_lists(lines).where("s1_id = 'S1-1'").collect()} == {("S1-1", "S2-2")}
    (tmp_path / "c.tsv").write_text("source1_entity_id,candidate_entity_ids\nS1-1\tS2-1\n")
    bad = validate.read_lines(spark, str(tmp_path / "c.tsv"))
    assert "comma_separated" in {r["rule"] for r in validate.list_issues(bad, "candidates", need).collect()}
    assert validate.not_candidates(lines, bad).first()["level"] == "warning"


def test_line_numbers_over_splits_and_files(spark, tmp_path):
    want = []
    for name in ("a.tsv", "b.tsv"):
        rows = [f"{name}-{i}" * (i % 5) for i in range(4000)]
        (tmp_path / name).write_text("\n".join(rows) + "\n")
        want += rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = validate.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["value"] for r in sorted(got, key=lambda r: r["line_no"])] == want
    assert sorted(r["line_no"] for r in got) == list(range(1, len(want) + 1))


def test_examples_of_broken_rules_are_few_and_first(spark):
    need = spark.range(50).select(F.format_string("S1-%02d", "id").alias("s1_id"))
    head = spark.createDataFrame([(1, "source1_entity_id\tmatched_entity_ids")], "line_no long, value string")
    row = validate.list_issues(head, "matching", need).first()
    assert (row["rule"], row["n"], row["examples"]) == ("missing_s1", 50, "S1-00|S1-01|S1-02|S1-03|S1-04")


def test_small_graphs_take_one_task_and_large_ones_the_rounds(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(rng.randrange(-300, 300) << 40, rng.randrange(-300, 300) << 40) for _ in range(280)] + [(i, i + 1) for i in range(40)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    monkeypatch.setattr(components, "ALONE", 0)
    rounds = sorted(map(tuple, connected_components(df, "a", "b").collect()))
    monkeypatch.undo()

    def none(edges):
        raise AssertionError("a small graph took a round")

    monkeypatch.setattr(components, "_large_star", none)
    alone = connected_components(df, "a", "b")
    assert alone.rdd.getNumPartitions() == 1 and alone.dtypes == [("node", "bigint"), ("component", "bigint")]
    assert sorted(map(tuple, alone.collect())) == rounds


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    for n, m in ((1, 0), (40, 30), (60, 59), (200, 150)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if n != 60 else [(i, i + 1) for i in range(59)]
        up = list(range(n))

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        df = spark.createDataFrame([*edges, *edges[:3], (None, 1)], "a long, b long")
        got = {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}
        assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_samples_are_stable(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("g"))
    a = sampling.stratified(rows, ["g"], 0.2, "k")
    assert {r["g"]: r["count"] for r in a.groupBy("g").count().collect()} == {0: 67, 1: 67, 2: 67}
    assert {r["k"] for r in a.collect()} == {r["k"] for r in sampling.stratified(rows.repartition(7), ["g"], 0.2, "k").collect()}
    assert sampling.simple(rows, 10, "k").count() == 10 and sampling.per_group(rows, "g", 4, "k").count() == 12


def test_stratified_sample_follows_the_hash_order(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 2).alias("g"))
    hashed = [(hashlib.md5(f"42|{r['k']}".encode()).hexdigest(), r["k"], r["g"]) for r in rows.collect()]
    want = set()
    for g in (None, 0, 1):
        own = sorted((h, k) for h, k, of in hashed if of == g)
        want |= {k for _, k in own[: round(0.3 * len(own))]}
    got = sampling.stratified(rows, ["g"], 0.3, "k")
    assert got.columns == rows.columns and {r["k"] for r in got.collect()} == want
    assert sampling.stratified(rows.limit(0), ["g"], 0.3, "k").count() == 0
    clashing = rows.withColumnsRenamed({"k": "_at"}).withColumn("_n", F.lit(1)).withColumn("_place", F.lit(2))
    assert {r["_at"] for r in sampling.stratified(clashing, ["g"], 0.3, "_at").collect()} == want


def test_diagnosis_precedence(spark):
    schema = "entity_id string, business_name string, business_address string, country string"
    cases = [
        ("Foods Acme", "Acme Foods", "word_order_change"), ("Acme Ltd", "Acme Inc", "legal_suffix_variation"), ("Acme Foods", "Acme Foods Intl", "additional_or_missing_tokens"),
        ("Intl Mach", "International Machines", "abbreviation_variation"), ("Custmers", "Kustmers", "typo_or_spelling_variation"), ("Foodstuffs", "Megafoodstuffsandbeyond", "partial_or_truncated_name"),
        ("Caféteria wwwww", "zzzzzzz yyyyyyyy", "transliteration_or_unicode_variation"), ("xy", "zw", "very_short_name"), ("Alphabet", "Zyxwvuts", "missing_or_empty_address"),
    ]
    left = postings.prepare(spark.createDataFrame([(f"S1-{i}", a, "", "US") for i, (a, _, _) in enumerate(cases)], schema))
    right = postings.prepare(spark.createDataFrame([(f"S2-{i}", b, "", "US") for i, (_, b, _) in enumerate(cases)], schema))
    pairs = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(len(cases))], "s1_id string, target_id string")
    got = {r["s1_id"]: r["category"] for r in diagnose.diagnose(diagnose.pair_frame(pairs, left, right)).collect()}
    assert [got[f"S1-{i}"] for i in range(len(cases))] == [c for _, _, c in cases]


def test_missing_values_never_agree(spark):
    schema = "entity_id string, business_name string, business_address string, country string"
    a = postings.prepare(spark.createDataFrame([("S1-1", "", "", "")], schema))
    b = postings.prepare(spark.createDataFrame([("S2-1", "", "", "")], schema))
    pairs = spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, target_id string")
    r = features.pair_features(diagnose.pair_frame(pairs, a, b)).first()
    assert (r["name_exact"], r["address_exact"], r["country_exact"], r["name_missing"], r["address_missing"], r["name_overlap"]) == (0, 0, 0, 1, 1, 0.0)


def test_matcher_learns_from_its_split_only(spark):
    rng = random.Random(0)
    rows = [(f"S1-{i}", f"S2-{i}-{j}", rng.random() + (j == 0)) for i in range(40) for j in range(3)]
    f = spark.createDataFrame(rows, "s1_id string, target_id string, x double")
    labels = f.where("target_id like '%-0'").select("s1_id", "target_id")
    split = f.where("cast(substring(s1_id, 4) as int) < 30").select("s1_id").distinct()
    model = features.fit_matcher(f, labels, ["x"], split)
    assert model.coefficients[0] > 0


def test_quality_figures(spark):
    t = spark.createDataFrame([("S1-1", "é", 1), ("S2-x", "ab", 1), ("S2-2", "", 2)], "entity_id string, v string, k int")
    assert {r["prefix"]: (r["rows"], r["valid"]) for r in quality.prefixes(t).collect()} == {"S1": (1, 1), "S2": (2, 1)}
    assert {r["character"] for r in quality.non_ascii_characters(t, "v").collect()} == {"é"}
    assert tuple(quality.duplicates(t, "k").first()) == (3, 2, 1)
    assert quality.lengths(t, ["v"]).first()["median"] == 1.0


def test_streamed_targets_meet_postings(spark, tmp_path):
    schema = "entity_id string, business_name string, business_address string, country string"
    s1 = postings.prepare(spark.createDataFrame([("S1-1", "Acme Foods", "", "US")], schema))
    spark.createDataFrame([("S2-1", "ACME foods", "", "us"), ("S2-2", "Zeta", "", "US")], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    found = incremental.stream_candidates(stream, postings.postings(s1, "name_token_unicode"), "name_token_unicode", True)
    incremental.start(found, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("S1-1", "S2-1")}


def test_registry(spark, sf):
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(oracle) >= 60
    assert entry.entry(spark).count() == 4


@pytest.mark.parametrize("name", ["block_country_name", "block_compact_name_beyond_ascii", "grouped_metrics", "threshold_sweep", "diagnose_pairs", "metrics_exact_name", "truth_integrity", "collision_stats", "persist_roundtrip", "norm_core"])
def test_queries_equal_their_oracle(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "nation", "orders", "documents"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda rows, cols: sorted(str([round(float(r[cols.index(c)]), 9) if isinstance(r[cols.index(c)], (int, float)) and not isinstance(r[cols.index(c)], bool) else str(r[cols.index(c)]) for c in sorted(cols)]) for r in rows)
    assert key([tuple(r) for r in got.collect()], got.columns) == key(want.fetchall(), want.columns)
