"""Command line: ``python -m linkforge query NAME SF_DIR [--output PATH]``,
``python -m linkforge validate -m MATCHING -s S1 [-c CANDIDATES] [-t TARGET]`` and
``python -m linkforge evaluate KIND --s1 S1 --s2 S2 --s3 S3 --truth TRUTH --output FILE``.

``validate`` prints every broken rule and ends with 1 if one of them is an error.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge import evaluations, queries
from linkforge.operators import validate
from linkforge.runtime import exists
from linkforge.sources.tables import read_ids


def issues(spark: SparkSession, matching: str, s1: str, candidates: str | None = None, targets: list[str] | None = None) -> DataFrame:
    """Broken rules of a matching list and, where given, of its candidate list."""
    required = read_ids(spark, s1).withColumnRenamed("entity_id", "s1_id")
    known = None
    for path in targets or []:
        ids = read_ids(spark, path)
        known = ids if known is None else known.unionAll(ids)
    out = validate.file_issues(spark, matching, "matching", required, known).select(F.lit("matching").alias("list"), "*")
    if candidates:
        out = out.unionAll(validate.file_issues(spark, candidates, "candidates", required, known).select(F.lit("candidates"), "*"))
        if exists(spark, matching) and exists(spark, candidates):
            lists = (validate.read_lines(spark, p) for p in (matching, candidates))
            out = out.unionAll(validate.not_candidates(*lists).select(F.lit("matching"), "*"))
    return out


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="linkforge")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("query", help="run a registered query")
    run.add_argument("name", choices=sorted(queries.QUERIES))
    run.add_argument("sf_dir")
    run.add_argument("--output", help="Parquet folder; without it rows are shown")
    check = commands.add_parser("validate", help="check result lists")
    check.add_argument("-m", "--matching", required=True)
    check.add_argument("-s", "--s1", required=True)
    check.add_argument("-c", "--candidates")
    check.add_argument("-t", "--targets", nargs="*", help="tables of known target ids")
    measure = commands.add_parser("evaluate", help="evaluate blocking over headed TSV tables")
    measure.add_argument("kind", choices=list(evaluations.KINDS))
    for name in ("s1", "s2", "s3", "truth", "output"):
        measure.add_argument(f"--{name}", required=True)
    measure.add_argument("--validation-fraction", type=float, default=0.2)
    measure.add_argument("--sample-size", type=int, help="pairs that normalization and errors look at")
    measure.add_argument("--seed", type=int, default=42)
    own = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if own.command == "query":
        result = queries.QUERIES[own.name](spark, own.sf_dir)
        result.write.parquet(own.output) if own.output else result.show(50, truncate=False)
        return 0
    if own.command == "evaluate":
        options = {"seed": own.seed} | ({"fraction": own.validation_fraction} if own.kind != "normalization" else {})
        if own.sample_size is not None and own.kind in ("normalization", "errors"):
            options["sample"] = own.sample_size
        data = evaluations.read_data(spark, own.s1, own.s2, own.s3, own.truth)
        evaluations.write_json(evaluations.KINDS[own.kind](data, **options), own.output)
        return 0
    rows = issues(spark, own.matching, own.s1, own.candidates, own.targets).collect()  # a row per rule
    for r in rows:
        print(f"{r['level']}: {r['list']}: {r['rule']}: {r['n']} ({r['examples']})")
    return int(any(r["level"] == "error" for r in rows))


if __name__ == "__main__":
    sys.exit(main())
