"""The command line's two commands."""

from linkforge.__main__ import main


def test_validate_and_query(spark, sf, tmp_path, capsys):
    (tmp_path / "s1.tsv").write_text("entity_id\tbusiness_name\nS1-1\ta\nS1-2\tb\n")
    (tmp_path / "good.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\n")
    (tmp_path / "bad.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\n")
    (tmp_path / "cand.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-9\nS1-2\t\n")
    s1 = ["-s", f"{tmp_path}/s1.tsv"]
    assert main(["validate", "-m", f"{tmp_path}/good.tsv", *s1]) == 0
    assert main(["validate", "-m", f"{tmp_path}/bad.tsv", *s1]) == 1
    assert main(["validate", "-m", f"{tmp_path}/good.tsv", "-c", f"{tmp_path}/cand.tsv", *s1]) == 0
    assert "match_not_candidate" in capsys.readouterr().out
    assert main(["query", "source_prefix", sf, "--output", f"{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
