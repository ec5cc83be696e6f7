"""Entity fixtures derived from the star-schema tables, in SQL that Spark and DuckDB share.

They have exact truth by foreign key, singletons, distractors, empty addresses and countries, and
suffix, abbreviation, extra-word, spelling and case noise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BASE = """
select c_custkey as ck,
       concat(lower(c_mktsegment), ' ', replace(c_name, '#', ' '), ' Private Limited') as business_name,
       concat(case when c_custkey % 7 = 0 then 'Unit 4B, ' else '' end,
              cast(c_custkey % 97 as varchar(20)), ' ', n_name, ' Road, ',
              cast(10000 + c_custkey % 400 as varchar(20))) as business_address,
       case when c_nationkey % 3 = 0 then 'US' when c_nationkey % 3 = 1 then 'India' else 'France' end as country
from customer join nation on c_nationkey = n_nationkey
"""

_S1 = """
select concat('S1-', cast(ck as varchar(20))) as entity_id, business_name, business_address, country
from er_base where ck % 10 <> 9
"""


def _target(name: str, odd: int) -> str:
    return f"""
select concat('{name}-', cast(o_orderkey as varchar(20))) as entity_id,
       case when o_orderkey % 12 in (0, 1) then upper(business_name)
            when o_orderkey % 12 in (2, 3) then replace(business_name, ' Private Limited', ' Pvt. Ltd.')
            when o_orderkey % 12 in (4, 5) then replace(business_name, ' Private Limited', '')
            when o_orderkey % 12 in (6, 7) then concat(business_name, ' dba ', lower(o_orderpriority))
            when o_orderkey % 12 in (8, 9) then replace(business_name, 'Customer', 'Custmer')
            else business_name end as business_name,
       case when o_orderkey % 20 in (0, 1) then ''
            when o_orderkey % 3 = 0 then replace(business_address, 'Road', 'Rd')
            else business_address end as business_address,
       case when o_orderkey % 50 in (0, 1) then '' else country end as country
from orders join er_base on o_custkey = ck
where o_orderkey % 2 = {odd} and o_custkey % 5 <> 0
"""


_TRUTH = """
select concat('S1-', cast(o_custkey as varchar(20))) as s1_id,
       case when o_orderkey % 2 = 0 then 'S2' else 'S3' end as target_source,
       concat(case when o_orderkey % 2 = 0 then 'S2-' else 'S3-' end, cast(o_orderkey as varchar(20))) as target_id
from orders join customer on o_custkey = c_custkey
where o_custkey % 5 <> 0 and o_custkey % 10 <> 9
"""

CTES = {"er_base": _BASE, "er_s1": _S1, "er_s2": _target("S2", 0), "er_s3": _target("S3", 1), "er_truth": _TRUTH}


def with_fixtures(body: str, *more: str) -> str:
    """A DuckDB query over the fixtures: ``more`` are further CTEs ("name as (...)")."""
    head = [f"{name} as ({sql})" for name, sql in CTES.items()]
    return "with recursive " + ",\n".join([*head, *more]) + "\n" + body


_plans: dict[tuple[str, str], dict[str, DataFrame]] = {}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the fixture tables as a DataFrame; its analysed plan (no data) is kept per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _plans:
        for old in [k for k in _plans if k[0] != key[0]]:
            del _plans[old]
        _plans[key] = {}
    if name not in _plans[key]:
        _plans[key][name] = _fixture(spark, sf_dir, name)
    return _plans[key][name]


def _fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "orders")}
    for t in ("er_base",) if name not in ("er_base", "er_truth") else ():
        tables[t] = fixture(spark, sf_dir, t)
    sql = CTES[name]
    used = {t: df for t, df in tables.items() if f" {t}" in sql}
    for t in used:
        sql = sql.replace(f"from {t} ", f"from {{{t}}} ").replace(f"from {t}\n", f"from {{{t}}}\n").replace(f"join {t} ", f"join {{{t}}} ")
    return spark.sql(sql, **used)
