"""DuckDB SQL over the fixtures, written independently of the DataFrame plans."""

from __future__ import annotations

from linkforge.functions.address import GENERIC_WORDS
from linkforge.functions.text import LEGAL_WORDS
from linkforge.sources.fixtures import with_fixtures


def safe(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


def compact(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({safe(x)}, '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def norm(name: str, table: str) -> str:
    return f"""{name} as (
  select *, array_to_string(list_filter(string_split(cm, ' '), lambda t: t <> '' and t not in ({_in(LEGAL_WORDS)})), ' ') as co
  from (select entity_id as id, business_name as raw_name, business_address as raw_address, country as raw_country,
               {safe("business_name")} as nm, {compact("business_name")} as cm, {safe("country")} as cc,
               {safe("business_address")} as ac, {compact("business_address")} as ad from {table}))"""


NORMS = (norm("n1", "er_s1"), norm("n2", "er_s2"), norm("n3", "er_s3"))

KEYS = {
    "name": "[nm]",
    "compact_name": "[cm]",
    "core_name": "[co]",
    "name_token_unicode": "string_split(nm, ' ')",
    "name_token_compact": "string_split(cm, ' ')",
    "address_token": f"list_filter(string_split(ad, ' '), lambda t: t not in ({_in(GENERIC_WORDS)}) and length(t) >= 2 and not regexp_matches(t, '^[0-9]+$'))",
    "number": "list_filter(string_split(regexp_replace(ad, '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: regexp_matches(t, '^[0-9]+[a-z]?$'))",
    "postal": "list_filter(string_split(regexp_replace(ac, '[^a-z0-9_]+', ' ', 'g'), ' '), lambda t: regexp_matches(t, '^[0-9]{4,6}$'))",
}


def posts(name: str, source: str, family: str) -> str:
    return f"{name} as (select * from (select distinct id, cc, unnest({KEYS[family]}) as k from {source}) where k <> '')"


def freq(name: str, post: str) -> str:
    return f"{name} as (select k, count(*) as n from {post} group by k)"


def shared(name: str, family: str, cap: int | None = None, country: bool = False, target: str = "n2", tag: str = "") -> list[str]:
    """CTEs that end in ``name`` (s1_id, target_id)."""
    a, b, f = f"p1{tag}{name}", f"p2{tag}{name}", f"f{tag}{name}"
    limit = f"join {f} on {f}.k = b.k and {f}.n <= {cap}" if cap is not None else ""
    same = "and a.cc = b.cc and a.cc <> ''" if country else ""
    return [posts(a, "n1", family), posts(b, target, family), freq(f, b), f"{name} as (select distinct a.id as s1_id, b.id as target_id from {a} a join {b} b on a.k = b.k {same} {limit})"]


def rarest_two(name: str, post: str, f: str, cap: int) -> str:
    return f"""{name} as (
  select id, max(case when r = 1 then k end) as a, max(case when r = 2 then k end) as b from (
    select p.id, p.k, row_number() over (partition by p.id order by coalesce(f.n, 0), p.k) as r
    from {post} p left join {f} f on f.k = p.k where coalesce(f.n, 0) <= {cap}) where r <= 2 group by id having count(*) = 2)"""


def fix(body: str, *ctes: str) -> str:
    return with_fixtures(body, *NORMS, *ctes)


def truth(source: str = "S2") -> str:
    return f"truth as (select distinct s1_id, target_id from er_truth where target_source = '{source}')"


def metrics(stage: str, edges: str, target: str = "n2") -> str:
    """A metrics row of an edge CTE against the CTE ``truth``."""
    return f"""select '{stage}' as stage, cast(coalesce(sum(n), 0) as bigint) as candidate_pairs, cast(coalesce(sum(t), 0) as bigint) as true_pairs,
  cast(coalesce(sum(h), 0) as bigint) as recovered_pairs, case when sum(t) = 0 then 1.0 else sum(h)::double / sum(t) end as pair_recall,
  count(*) filter (where h = t) as complete_entities, count(*) filter (where h = t)::double / count(*) as complete_entity_recall,
  1 - sum(n)::double / (count(*)::double * (select count(*) from {target})) as reduction_ratio, sum(n)::double / count(*) as mean_candidates,
  quantile_cont(n, 0.5)::double as median_candidates, quantile_cont(n, 0.95)::double as p95_candidates, quantile_cont(n, 0.99)::double as p99_candidates,
  max(n) as max_candidates, count(*) filter (where n = 0) as zero_entities, count(*) as entities
from ({per_entity(edges)})"""


def per_entity(edges: str) -> str:
    return f"""select u.id as s1_id, coalesce(c.n, 0) as n, coalesce(t.n, 0) as t, coalesce(h.n, 0) as h from n1 u
  left join (select s1_id, count(*) as n from {edges} group by 1) c on c.s1_id = u.id
  left join (select s1_id, count(*) as n from truth group by 1) t on t.s1_id = u.id
  left join (select s1_id, count(*) as n from {edges} join truth using (s1_id, target_id) group by 1) h on h.s1_id = u.id"""
