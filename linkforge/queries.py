"""Registry of the record-linkage queries (``QUERIES``) and their oracle SQL (``ORACLE``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge import oracle as o
from linkforge.functions import address, text
from linkforge.operators import blocking, candidates, diagnose, features, metrics, persist, postings, quality, sampling, validate
from linkforge.plans.spec import Strategy, absorb, compile_stages, compile_strategy
from linkforge.runtime import cut, new_path
from linkforge.sources.fixtures import fixture
from linkforge.sources.tables import result_lists, truth_edges

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def entities(spark: SparkSession, d: str, n: int) -> DataFrame:
    """Prepared fixture entities of source n; the fixtures are ASCII."""
    return postings.prepare(fixture(spark, d, f"er_s{n}"), ascii_only=True)


def universe(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "er_s1").select(F.col("entity_id").alias("s1_id"))


def truth(spark: SparkSession, d: str, source: str = "S2") -> DataFrame:
    return fixture(spark, d, "er_truth").where(F.col("target_source") == source).select("s1_id", "target_id").distinct()


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


# --- text and address functions --------------------------------------------------------------

_DOC_SAFE = "trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\\s+', ' ', 'g'))"


@query("norm_safe", f"select doc_id, md5({_DOC_SAFE}) as digest, length({_DOC_SAFE}) as n from documents")
def norm_safe(spark, d):
    s = text.safe(F.col("text"))
    return documents(spark, d).select("doc_id", s.alias("s")).select("doc_id", F.md5(F.col("s").cast("binary")).alias("digest"), F.char_length("s").cast("long").alias("n"))


_DOC_COMPACT = f"trim(regexp_replace(regexp_replace({_DOC_SAFE}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("norm_compact", f"select doc_id, md5({_DOC_COMPACT}) as digest from documents")
def norm_compact(spark, d):
    return documents(spark, d).select("doc_id", F.md5(text.compact(text.safe(F.col("text"))).cast("binary")).alias("digest"))


@query("norm_core", o.fix("select id, cm as name_compact, co as name_core from n2"))
def norm_core(spark, d):
    return entities(spark, d, 2).select(F.col("entity_id").alias("id"), "name_compact", "name_core")


def _joined(fn) -> Query:
    def run(spark, d):
        return entities(spark, d, 2).select(F.col("entity_id").alias("id"), F.array_join(F.array_sort(fn(F.col("address_clean"))), " ").alias("value"))

    return run


def _joined_sql(expr: str) -> str:
    return o.fix(f"select id, array_to_string(list_sort(list_distinct({expr})), ' ') as value from n2")


query("addr_tokens", _joined_sql("list_filter(string_split(ad, ' '), lambda t: t <> '')"))(_joined(address.tokens))
query("addr_informative", _joined_sql(o.KEYS["address_token"]))(_joined(address.informative))
query("addr_numbers", _joined_sql(o.KEYS["number"]))(_joined(address.numbers))
query("addr_postal", _joined_sql(o.KEYS["postal"]))(_joined(address.postal))


@query("parse_address", o.fix(f"select id, ac as address_clean, len(list_distinct(list_filter(string_split(ad, ' '), lambda t: t <> ''))) as tokens, len(list_distinct({o.KEYS['address_token']})) as informative, len(list_distinct({o.KEYS['number']})) as numbers, len(list_distinct({o.KEYS['postal']})) as postal from n3"))
def parse_address(spark, d):
    p = entities(spark, d, 3).select(F.col("entity_id").alias("id"), address.parse(F.col("address_clean")).alias("p"))
    return p.select("id", "p.address_clean", *[F.size(f"p.{c}").cast("long").alias(c) for c in ("tokens", "informative", "numbers", "postal")])


# --- blocking --------------------------------------------------------------------------------


def _strategy(name: str, s: Strategy, ctes: list[str]) -> None:
    def run(spark, d):
        return compile_strategy(s, entities(spark, d, 1), entities(spark, d, 2))

    query(name, o.fix("select s1_id, target_id from e", *ctes))(run)


_strategy("block_name_only", Strategy("shared", "name"), o.shared("e", "name"))
_strategy("block_compact_name", Strategy("shared", "compact_name"), o.shared("e", "compact_name"))
_strategy("block_country_name", Strategy("shared", "name", True), o.shared("e", "name", country=True))
_strategy("block_rare_token", Strategy("shared", "name_token_unicode", False, 10), o.shared("e", "name_token_unicode", 10))
_strategy("block_country_rare_token", Strategy("shared", "name_token_unicode", True, 10), o.shared("e", "name_token_unicode", 10, True))
_strategy("block_country_rare_token_compact", Strategy("shared", "name_token_compact", True, 5), o.shared("e", "name_token_compact", 5, True))
_strategy("block_addr_token", Strategy("shared", "address_token", True, 250), o.shared("e", "address_token", 250, True))
_strategy("block_postal", Strategy("shared", "postal"), o.shared("e", "postal"))
_strategy("block_country_postal", Strategy("shared", "postal", True), o.shared("e", "postal", country=True))
_strategy("block_number_cap", Strategy("shared", "number", False, 25), o.shared("e", "number", 25))
_strategy("block_country_number_cap", Strategy("shared", "number", True, 25), o.shared("e", "number", 25, True))


@query("block_name_union", o.fix("select s1_id, target_id from e1 union select s1_id, target_id from e2", *o.shared("e1", "name"), *o.shared("e2", "name", country=True)))
def block_name_union(spark, d):
    a, b = entities(spark, d, 1), entities(spark, d, 2)
    runs = {s.name: ("S2", compile_strategy(s, a, b)) for s in (Strategy("shared", "name"), Strategy("shared", "name", True))}
    return candidates.union_runs(runs)


#: Accented names: composed, decomposed and in other case, by the id's last digits.
_ACCENTED = "case cast(split_part(entity_id, '-', 2) as bigint) % 3 when 0 then replace(business_name, 'Customer', 'Café Zürich') when 1 then replace(business_name, 'Customer', 'Cafe\u0301 ZU\u0308RICH') else replace(business_name, 'Customer', 'मुंबई Straße') end"
_SAFE = "trim(regexp_replace(replace(lower(nfc_normalize(business_name)), 'ß', 'ss'), '\\s+', ' ', 'g'))"
_ACCENTS = tuple(
    f"a{n} as (select id, nm, trim(regexp_replace(regexp_replace(nm, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as cm, cc from (select entity_id as id, {_SAFE} as nm, {o.safe('country')} as cc from (select * replace ({_ACCENTED} as business_name) from er_s{n})))"
    for n in (1, 2)
)


def _accented(spark, d, n: int) -> DataFrame:
    return postings.prepare(fixture(spark, d, f"er_s{n}").withColumn("business_name", F.expr(_ACCENTED)))


def _accented_strategy(name: str, s: Strategy) -> None:
    def run(spark, d):
        return compile_strategy(s, _accented(spark, d, 1), _accented(spark, d, 2))

    cap = f"join f on f.k = b.k and f.n <= {s.cap}" if s.cap else ""
    same = "and a.cc = b.cc and a.cc <> ''" if s.country_aware else ""
    ctes = [*_ACCENTS, o.posts("p1", "a1", s.family), o.posts("p2", "a2", s.family), o.freq("f", "p2")]
    query(name, o.fix(f"select distinct a.id as s1_id, b.id as target_id from p1 a join p2 b on a.k = b.k {same} {cap}", *ctes))(run)


_accented_strategy("block_name_beyond_ascii", Strategy("shared", "name"))
_accented_strategy("block_compact_name_beyond_ascii", Strategy("shared", "compact_name"))
_accented_strategy("block_token_beyond_ascii", Strategy("shared", "name_token_unicode", True, 10))


def _family_pair(name: str, country: bool, how: str) -> None:
    def run(spark, d):
        return blocking.postal_and_number(entities(spark, d, 1), entities(spark, d, 2), 25, None, country, how)

    word = "intersect" if how == "intersection" else "union"
    query(name, o.fix(f"select s1_id, target_id from ep {word} select s1_id, target_id from en", *o.shared("ep", "postal", None, country), *o.shared("en", "number", 25, country)))(run)


_family_pair("block_postal_number", False, "intersection")
_family_pair("block_country_postal_number", True, "intersection")
_family_pair("block_postal_or_number", False, "union")

_CAP = 5000
_PAIR = [o.posts("p1", "n1", "name_token_unicode"), o.posts("p2", "n2", "name_token_unicode"), o.freq("f", "p2"), o.rarest_two("r1", "p1", "f", _CAP)]


@query("block_multi_intersection", o.fix("select distinct r1.id as s1_id, x.id as target_id from r1 join p2 x on x.k = r1.a join p2 y on y.k = r1.b and y.id = x.id", *_PAIR))
def block_multi_intersection(spark, d):
    return compile_strategy(Strategy("intersection", "name_token_unicode", cap=_CAP), entities(spark, d, 1), entities(spark, d, 2))


@query("block_multi_signature", o.fix("select r1.id as s1_id, r2.id as target_id from r1 join r2 on least(r1.a, r1.b) = least(r2.a, r2.b) and greatest(r1.a, r1.b) = greatest(r2.a, r2.b)", *_PAIR, o.rarest_two("r2", "p2", "f", _CAP)))
def block_multi_signature(spark, d):
    return compile_strategy(Strategy("signature", "name_token_unicode", cap=_CAP), entities(spark, d, 1), entities(spark, d, 2))


def _token_freq(name: str, family: str) -> None:
    def run(spark, d):
        return postings.frequencies(postings.postings(entities(spark, d, 2), family))

    query(name, o.fix("select k as key, n as freq from f", o.posts("p", "n2", family), o.freq("f", "p")))(run)


_token_freq("token_freq_unicode", "name_token_unicode")
_token_freq("token_freq_compact", "name_token_compact")
_token_freq("token_freq_address", "address_token")

_SWEEP = [5, 10, 25, 50, 100, 250]


@query(
    "threshold_sweep",
    o.fix(
        "select c.cap, cast(count(*) as bigint) as pairs, count(distinct s1_id) as entities from m join (select unnest([5, 10, 25, 50, 100, 250]) as cap) c on m.least <= c.cap group by c.cap",
        o.posts("p1", "n1", "address_token"), o.posts("p2", "n2", "address_token"), o.freq("f", "p2"),
        "m as (select a.id as s1_id, b.id as target_id, min(f.n) as least from p1 a join p2 b on a.k = b.k and a.cc = b.cc and a.cc <> '' join f on f.k = b.k group by 1, 2)",
    ),
)
def threshold_sweep(spark, d):
    return blocking.sweep(entities(spark, d, 1), entities(spark, d, 2), "address_token", _SWEEP)


@query("surviving_entities", o.fix("select distinct p.id from p1 p left join f on f.k = p.k where coalesce(f.n, 0) <= 5", o.posts("p1", "n1", "name_token_unicode"), o.posts("p2", "n2", "name_token_unicode"), o.freq("f", "p2")))
def surviving_entities(spark, d):
    return blocking.surviving_entities(entities(spark, d, 1), entities(spark, d, 2), "name_token_unicode", 5)


@query("block_stats", o.fix("select count(*) as blocks, max(n) as max_block, count(*) filter (where n > 100) as over_100, count(*) filter (where n > 1000) as over_1000, count(*) filter (where n > 10000) as over_10000, quantile_cont(n, 0.95)::double as p95, quantile_cont(n, 0.99)::double as p99 from b", o.posts("p", "n2", "address_token"), "b as (select cc, k, count(*) as n from p where cc <> '' group by cc, k)"))
def block_stats(spark, d):
    return postings.block_statistics(postings.block_sizes(postings.postings(entities(spark, d, 2), "address_token")))


_REPORTED = ("address_token", "postal", "number")


def _report_sql(f: str) -> str:
    return "(" + o.fix(f"select '{f}' as family, (select count(*) from f) as distinct_keys, (select count(*) from f where n <= 25) as keys_up_to_cap, count(*) as blocks, max(n) as max_block, count(*) filter (where n > 100) as over_100, count(*) filter (where n > 1000) as over_1000, count(*) filter (where n > 10000) as over_10000, quantile_cont(n, 0.95)::double as p95, quantile_cont(n, 0.99)::double as p99 from b", o.posts("p", "n2", f), o.freq("f", "p"), "b as (select cc, k, count(*) as n from p where cc <> '' group by cc, k)") + ")"


@query("block_report", " union all ".join(_report_sql(f) for f in _REPORTED))
def block_report(spark, d):
    e = entities(spark, d, 2)
    rows = [postings.block_report(e, f, 25) for f in _REPORTED]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("signal_stats", " union all ".join("(" + o.fix(f"select '{f}' as signal, count(*) as rows, count(*) filter (where n > 0) as with_signal, count(*) filter (where n > 1) as with_multiple, cast(sum(n) as bigint) as occurrences, (select count(distinct k) from p) as distinct_keys from (select len(list_distinct({o.KEYS[f]})) as n from n2)", o.posts("p", "n2", f)) + ")" for f in ("postal", "number")))
def signal_stats(spark, d):
    e = entities(spark, d, 2)
    rows = [postings.extraction_statistics(e, f).withColumn("signal", F.lit(f)) for f in ("postal", "number")]
    return rows[0].unionByName(rows[1])


# --- stages, unions, metrics -----------------------------------------------------------------

_STAGES = {
    "name_token": Strategy("shared", "name_token_unicode", True, 250),
    "address_token": Strategy("shared", "address_token", True, 250),
    "number": Strategy("shared", "number", True, 250),
    "postal_number": Strategy("postal_number", country_aware=True, cap=250),
}


def stages(spark, d, n: int = 2, true: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """The stages' edges with their bits, over entities that are normalised once."""
    a, b = (cut(entities(spark, d, i).select("entity_id", "country_clean", "name_clean", "address_clean"), name) for i, name in ((1, "s1"), (n, "target")))
    return compile_stages(list(_STAGES.values()), a, b, true, ordered)


def _stage_ctes(target: str = "n2") -> list[str]:
    out = [o.truth("S2" if target == "n2" else "S3")]
    out += o.shared("e0", "name_token_unicode", 250, True, target) + o.shared("e1", "address_token", 250, True, target) + o.shared("e2", "number", 250, True, target)
    out += o.shared("ep", "postal", None, True, target) + ["e3 as (select s1_id, target_id from ep intersect select s1_id, target_id from e2)"]
    out += [f"u{i} as (" + " union ".join(f"select s1_id, target_id from e{j}" for j in range(i + 1)) + ")" for i in range(4)]
    return out


_NAMES = list(_STAGES)


def _metric_rows(prefix: str, target: str = "n2") -> str:
    return " union all ".join(o.metrics(n, f"{prefix}{i}", target) for i, n in enumerate(_NAMES))


def _stage_metrics(spark, d, n: int, cumulative: bool) -> DataFrame:
    true = cut(truth(spark, d, f"S{n}"), "truth")
    return metrics.tagged_metrics(universe(spark, d), true, fixture(spark, d, f"er_s{n}"), stages(spark, d, n, true), _NAMES, cumulative)


@query("metrics_by_stage", o.fix(_metric_rows("e"), *_stage_ctes()))
def metrics_by_stage(spark, d):
    return _stage_metrics(spark, d, 2, False)


@query("metrics_cumulative", o.fix(_metric_rows("u"), *_stage_ctes()))
def metrics_cumulative(spark, d):
    return _stage_metrics(spark, d, 2, True)


@query("metrics_cumulative_s3", o.fix(_metric_rows("u", "n3"), *_stage_ctes("n3")))
def metrics_cumulative_s3(spark, d):
    return _stage_metrics(spark, d, 3, True)


_CAPS = (5, 10, 25)


def _cap_metrics(name: str, family: str) -> None:
    def run(spark, d):
        a, b = cut(entities(spark, d, 1), "s1"), cut(entities(spark, d, 2), "target")
        edges = blocking.least_frequency(a, b, family, max(_CAPS))
        return metrics.cap_metrics(universe(spark, d), truth(spark, d), b, edges, list(_CAPS), family)

    rows = " union all ".join(o.metrics(f"{family}_freq{c}", f"g{c}") for c in _CAPS)
    query(name, o.fix(rows, o.truth(), *[x for c in _CAPS for x in o.shared(f"g{c}", family, c, True)]))(run)


for _name, _family in (("metrics_token_caps", "name_token_unicode"), ("metrics_compact_token_caps", "name_token_compact"), ("metrics_address_caps", "address_token"), ("metrics_number_caps", "number")):
    _cap_metrics(_name, _family)


_EXACT = {"name_only": Strategy("shared", "name"), "compact_name": Strategy("shared", "compact_name"), "country_name": Strategy("shared", "name", True)}


@query("metrics_exact_name", o.fix(" union all ".join(o.metrics(n, f"x{i}") for i, n in enumerate(_EXACT)), o.truth(), *o.shared("x0", "name"), *o.shared("x1", "compact_name"), *o.shared("x2", "name", country=True)))
def metrics_exact_name(spark, d):
    a, b = entities(spark, d, 1), entities(spark, d, 2)
    return metrics.stage_metrics(universe(spark, d), truth(spark, d), fixture(spark, d, "er_s2"), {k: compile_strategy(s, a, b) for k, s in _EXACT.items()})


def _marginal_sql() -> str:
    rows = []
    for i, n in enumerate(_NAMES[1:], 1):
        rows.append(f"""select '{n}' as stage, cast(sum(b.h - a.h) as bigint) as new_pairs, count(*) filter (where a.h < a.t and b.h = b.t) as new_complete,
  cast(sum(a.n) as bigint) as before, cast(sum(b.n) as bigint) as after, cast(sum(b.n - a.n) as bigint) as added,
  coalesce(sum(b.h - a.h)::double / nullif(sum(a.t), 0), 0) as marginal_recall, sum(b.n - a.n)::double / nullif(sum(b.h - a.h), 0) as cost,
  sum(b.n)::double / nullif(sum(a.n), 0) as growth, cast(sum(b.h - a.h) * 1000000 as bigint)::double / nullif(sum(a.t) * sum(b.n - a.n), 0) as recall_per_million,
  cast(sum(a.t - a.h) as bigint) as missed_before, coalesce(sum(b.h - a.h)::double / nullif(sum(a.t - a.h), 0), 0) as share_of_missed
from ({o.per_entity(f"u{i - 1}")}) a join ({o.per_entity(f"u{i}")}) b using (s1_id)""")
    return o.fix(" union all ".join(rows), *_stage_ctes())


@query("marginal_recovery", _marginal_sql())
def marginal_recovery(spark, d):
    true = cut(truth(spark, d), "truth")
    return metrics.tagged_recovery(universe(spark, d), true, stages(spark, d, true=true), _NAMES)


@query("cumulative_union", o.fix("select s1_id, target_id from u3", *_stage_ctes()))
def cumulative_union(spark, d):
    a, b = entities(spark, d, 1), entities(spark, d, 2)
    kept = absorb(list(_STAGES.values()))  # the postal-and-number stage lies within the number stage
    return candidates.union_runs({s.name: ("S2", compile_strategy(s, a, b)) for s in kept})


@query("stage_tags", o.fix("select s1_id, target_id, cast(sum(b) as bigint) as stages from (" + " union all ".join(f"select s1_id, target_id, {1 << i} as b from e{i}" for i in range(4)) + ") group by 1, 2", *_stage_ctes()))
def stage_tags(spark, d):
    return stages(spark, d)


_NAME_TOKEN = o.shared("e", "name_token_unicode", 25, True)


def _name_token_edges(spark, d):
    return compile_strategy(Strategy("shared", "name_token_unicode", True, 25), entities(spark, d, 1), entities(spark, d, 2))


@query("candidate_distribution", o.fix("select n as candidates, count(*) as entities from (select u.id, coalesce(c.n, 0) as n from n1 u left join (select s1_id, count(*) as n from e group by 1) c on c.s1_id = u.id) group by n", *_NAME_TOKEN))
def candidate_distribution(spark, d):
    return metrics.distribution(universe(spark, d), _name_token_edges(spark, d))


@query("zero_candidates", o.fix("select id as s1_id from n1 where id not in (select s1_id from e)", *_NAME_TOKEN))
def zero_candidates(spark, d):
    return candidates.counts(universe(spark, d), _name_token_edges(spark, d)).where("candidates = 0").select("s1_id")


@query("candidate_order", o.fix("select s1_id, target_id, row_number() over (partition by s1_id order by target_id) - 1 as candidate_order from e", *_NAME_TOKEN))
def candidate_order(spark, d):
    return candidates.candidate_order(_name_token_edges(spark, d)).withColumn("candidate_order", F.col("candidate_order").cast("long"))


@query("missed_pairs", o.fix("select s1_id, target_id from truth except select s1_id, target_id from e", o.truth(), *o.shared("e", "compact_name")))
def missed_pairs(spark, d):
    return candidates.missed(truth(spark, d), compile_strategy(_EXACT["compact_name"], entities(spark, d, 1), entities(spark, d, 2)))


@query("result_lists", o.fix("select u.id as source1_entity_id, coalesce(l.ids, '') as matched_entity_ids from n1 u left join (select s1_id, string_agg(target_id, ',' order by target_id) as ids from e group by 1) l on l.s1_id = u.id", *o.shared("e", "core_name")))
def result_list_query(spark, d):
    return result_lists(universe(spark, d), compile_strategy(Strategy("shared", "core_name"), entities(spark, d, 1), entities(spark, d, 2)))


# --- pair agreement, diagnosis ---------------------------------------------------------------

_LEV = "levenshtein(a.{0}, b.{0})"


def _pairs(spark, d):
    return diagnose.pair_frame(truth(spark, d), entities(spark, d, 1), entities(spark, d, 2))


_TP = "from truth t join n1 a on a.id = t.s1_id join n2 b on b.id = t.target_id"
_JACCARD = "case when len(list_distinct({a} || {b})) = 0 then 1.0 else len(list_intersect({a}, {b}))::double / len(list_distinct({a} || {b})) end"


def _words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))"


_SIM = "case when greatest(length(a.{0}), length(b.{0})) = 0 then 1.0 else 1 - levenshtein(a.{0}, b.{0})::double / greatest(length(a.{0}), length(b.{0})) end"


@query("pair_levenshtein", o.fix(f"select t.s1_id, t.target_id, levenshtein(a.cm, b.cm) as distance, round({_SIM.format('cm')}, 9) as similarity {_TP}", o.truth()))
def pair_levenshtein(spark, d):
    a, b = F.col("a_name_compact"), F.col("b_name_compact")
    return _pairs(spark, d).select("s1_id", "target_id", F.levenshtein(a, b).cast("long").alias("distance"), F.round(text.levenshtein_similarity(a, b), 9).alias("similarity"))


@query("token_jaccard", o.fix(f"select t.s1_id, t.target_id, round({_JACCARD.format(a=_words('a.cm'), b=_words('b.cm'))}, 9) as jaccard {_TP}", o.truth()))
def token_jaccard(spark, d):
    return _pairs(spark, d).select("s1_id", "target_id", F.round(text.jaccard(text.token_set(F.col("a_name_compact")), text.token_set(F.col("b_name_compact"))), 9).alias("jaccard"))


@query("pair_agreement", o.fix(" union all ".join(f"select '{label}' as field, count(*) as pairs, round(avg(case when a.{c} = b.{c} then 1.0 else 0.0 end), 6) as exact, count(*) filter (where a.{c} = '' or b.{c} = '') as empties, round(avg(levenshtein(a.{c}, b.{c})), 6) as distance, round(avg({_SIM.format(c)}), 6) as similarity, round(avg({_JACCARD.format(a=_words('a.' + c), b=_words('b.' + c))}), 6) as jaccard {_TP}" for label, c in (("raw_name", "raw_name"), ("name_clean", "nm"), ("name_compact", "cm"), ("name_core", "co"), ("address_clean", "ac"))), o.truth()))
def pair_agreement(spark, d):
    frame = _pairs(spark, d)
    rows = [("raw_name", "business_name"), ("name_clean", "name_clean"), ("name_compact", "name_compact"), ("name_core", "name_core"), ("address_clean", "address_clean")]
    parts = [diagnose.agreement(frame, f"a_{c}", f"b_{c}").select(F.lit(label).alias("field"), "*") for label, c in rows]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_DIGITS = "list_filter(regexp_extract_all({0}, '[0-9]+'), lambda t: t <> '')"
_ABBREV = """((len({wa}) = len({wb}) and len({wa}) > 0 and list_transform({wa}, lambda t: t[1]) = list_transform({wb}, lambda t: t[1]))
  or len(list_filter({wa}, lambda s: length(s) <= 4 and len(list_filter({wb}, lambda t: starts_with(t, s))) > 0)) > 0
  or len(list_filter({wb}, lambda s: length(s) <= 4 and len(list_filter({wa}, lambda t: starts_with(t, s))) > 0)) > 0)"""
_DIAGNOSED = f"""d0 as (
  select t.s1_id, t.target_id, a.cm as acm, b.cm as bcm, a.co as aco, b.co as bco, a.ac as aac, b.ac as bac,
    list_filter(string_split(a.cm, ' '), lambda t: t <> '') as wa, list_filter(string_split(b.cm, ' '), lambda t: t <> '') as wb,
    {_SIM.format("cm")} as sim, {_JACCARD.format(a=_words("a.cm"), b=_words("b.cm"))} as jac, {_JACCARD.format(a=_words("a.ad"), b=_words("b.ad"))} as ajac {_TP}),
d1 as (select *, len(wa) > 0 and len(wb) > 0 and (len(list_intersect(wa, wb)) = len(list_distinct(wa)) or len(list_intersect(wa, wb)) = len(list_distinct(wb))) as sub,
    aac <> '' and bac <> '' as has, (aac <> '' and bac <> '') and (ajac >= 0.5 or list_has_any({_DIGITS.format("aac")}, {_DIGITS.format("bac")})) as addr from d0),
dx as (select s1_id, target_id, jac >= 0.5 or sub as token_recoverable, addr as address_recoverable,
    sim >= 0.75 and jac < 0.5 and not sub as approximate_recoverable, sim < 0.75 and jac < 0.5 and not addr as difficult,
    case when list_sort(wa) = list_sort(wb) and acm <> bcm then 'word_order_change'
      when aco <> '' and aco = bco and acm <> bcm then 'legal_suffix_variation'
      when sub and list_sort(list_distinct(wa)) <> list_sort(list_distinct(wb)) then 'additional_or_missing_tokens'
      when {_ABBREV.format(wa="wa", wb="wb")} then 'abbreviation_variation'
      when sim >= 0.75 and acm <> bcm then 'typo_or_spelling_variation'
      when (contains(acm, bcm) or contains(bcm, acm)) and acm <> bcm then 'partial_or_truncated_name'
      when greatest(len(wa), len(wb)) <= 1 and greatest(length(acm), length(bcm)) <= 4 then 'very_short_name'
      when addr and sim < 0.75 then 'weak_name_address_informative'
      when not has then 'missing_or_empty_address' else 'exact_normalized_name_mismatch' end as category from d1)"""


def _diagnosed(spark, d):
    return diagnose.diagnose(_pairs(spark, d))


@query("diagnose_pairs", o.fix("select * from dx", o.truth(), _DIAGNOSED))
def diagnose_pairs(spark, d):
    return _diagnosed(spark, d).select("s1_id", "target_id", *diagnose.FLAGS, "category")


@query("diagnosis_categories", o.fix("select category, count(*) as pairs, round(100 * count(*)::double / (select count(*) from dx), 4) as percent from dx group by category", o.truth(), _DIAGNOSED))
def diagnosis_categories(spark, d):
    return diagnose.categories(_diagnosed(spark, d))


@query("recoverability", o.fix("select count(*) as pairs, " + ", ".join(f"count(*) filter (where {f}) as {f}" for f in diagnose.FLAGS) + " from dx", o.truth(), _DIAGNOSED))
def recoverability(spark, d):
    return diagnose.recoverability(_diagnosed(spark, d))


@query("diagnosis_examples", o.fix("select category, place, s1_id, target_id from (select *, row_number() over (partition by category order by s1_id, target_id) as place from dx) where place <= 3", o.truth(), _DIAGNOSED))
def diagnosis_examples(spark, d):
    return diagnose.examples(_diagnosed(spark, d)).withColumn("place", F.col("place").cast("long"))


@query("category_recovery", o.fix("select category, count(*) as pairs, count(e.s1_id) as recovered, count(e.s1_id)::double / count(*) as rate from dx left join e on e.s1_id = dx.s1_id and e.target_id = dx.target_id group by category", o.truth(), _DIAGNOSED, *_NAME_TOKEN))
def category_recovery(spark, d):
    return diagnose.category_recovery(_diagnosed(spark, d), _name_token_edges(spark, d))


# --- data quality ----------------------------------------------------------------------------

_REPS = (("business_name", "raw_name"), ("name_clean", "nm"), ("name_compact", "cm"), ("name_core", "co"), ("business_address", "raw_address"), ("address_clean", "ac"))


@query("collision_stats", o.fix(" union all ".join(f"select '{r}' as representation, 'S2' as source, count(*) filter (where {c} <> '') as unique_values, count(*) filter (where {c} <> '' and n > 1) as duplicated_values, cast(coalesce(sum(n) filter (where {c} <> '' and n > 1), 0) as bigint) as rows_in_duplicates, coalesce(max(n) filter (where {c} <> ''), 0) as max_bucket, cast(coalesce(sum(n) filter (where {c} = ''), 0) as bigint) as empty_rows from (select {c}, count(*) as n from n2 group by {c})" for r, c in _REPS)))
def collision_stats(spark, d):
    return quality.collisions(entities(spark, d, 2), [r for r, _ in _REPS], "S2")


@query("field_lengths", o.fix(" union all ".join(f"select '{f}' as field, min(n) as shortest, max(n) as longest, round(avg(n), 6) as mean, quantile_cont(n, 0.5)::double as median, round(stddev_samp(n), 6) as std, quantile_cont(n, 0.05)::double as p5, quantile_cont(n, 0.95)::double as p95, count(*) filter (where n <= 2) as up_to_two, count(*) filter (where n = 0) as empty, count(*) filter (where n > 200) as over_200 from (select length({f}) as n from er_s2)" for f in ("business_name", "business_address"))))
def field_lengths(spark, d):
    return quality.lengths(fixture(spark, d, "er_s2"), ["business_name", "business_address"])


@query("top_tokens", o.fix("select k as value, n from f order by n desc, k limit 10", o.posts("p", "n2", "name_token_compact"), o.freq("f", "p")))
def top_tokens(spark, d):
    return quality.top_values(postings.postings(entities(spark, d, 2), "name_token_compact"), "key", 10)


@query("duplicate_values", o.fix("select cast(sum(n) as bigint) as rows, count(*) as distinct_keys, count(*) filter (where n > 1) as repeated_keys from (select business_address, count(*) as n from er_s2 group by 1)"))
def duplicate_values(spark, d):
    return quality.duplicates(fixture(spark, d, "er_s2"), "business_address")


@query("source_prefix", o.fix("select split_part(entity_id, '-', 1) as prefix, count(*) as rows, count(*) filter (where regexp_matches(entity_id, '^S[123]-[0-9]+$')) as valid from (select entity_id from er_s1 union all select entity_id from er_s2 union all select entity_id from er_s3) group by 1"))
def source_prefix(spark, d):
    tables = [fixture(spark, d, f"er_s{n}").select("entity_id") for n in (1, 2, 3)]
    return quality.prefixes(tables[0].unionAll(tables[1]).unionAll(tables[2]))


@query("token_counts", o.fix("select len(list_filter(string_split(cm, ' '), lambda t: t <> '')) as tokens, count(*) as rows from n2 group by 1"))
def token_counts(spark, d):
    return quality.token_counts(entities(spark, d, 2), "name_compact")


@query("non_ascii_characters", "select c as character, count(*) as n, count(distinct doc_id) as rows from (select doc_id, unnest(string_split(text, '')) as c from documents) where regexp_matches(c, '[^\\x00-\\x7F]') group by c")
def non_ascii_characters(spark, d):
    return quality.non_ascii_characters(documents(spark, d), "text")


_COUNTED = """m as (select u.id as s1_id, u.raw_country as country, coalesce(t.s2, 0) as s2, coalesce(t.s3, 0) as s3, coalesce(t.s2, 0) + coalesce(t.s3, 0) as matches
  from n1 u left join (select s1_id, count(*) filter (where target_source = 'S2') as s2, count(*) filter (where target_source = 'S3') as s3 from er_truth group by 1) t on t.s1_id = u.id)"""


def _counted(spark, d):
    u = fixture(spark, d, "er_s1").select(F.col("entity_id").alias("s1_id"), "country")
    return quality.match_counts(u, fixture(spark, d, "er_truth"))


@query("match_histogram", o.fix("select matches, count(*) as entities, count(*) filter (where s2 > 0 and s3 = 0) as s2_only, count(*) filter (where s3 > 0 and s2 = 0) as s3_only, count(*) filter (where s2 > 0 and s3 > 0) as both from m group by matches", _COUNTED))
def match_histogram(spark, d):
    return quality.match_histogram(_counted(spark, d))


@query("country_patterns", o.fix("select country, count(*) as entities, count(*) filter (where matches = 0) as zero, count(*) filter (where matches = 1) as one, count(*) filter (where matches > 1) as many, round(avg(matches), 6) as mean, max(matches) as most from m group by country", _COUNTED))
def country_patterns(spark, d):
    return quality.country_patterns(_counted(spark, d))


@query("bucket_crosstab", o.fix("select country, count(*) filter (where matches = 0) as zero, count(*) filter (where matches = 1) as one, count(*) filter (where matches > 1) as two_or_more from m group by country", _COUNTED))
def bucket_crosstab(spark, d):
    return quality.bucket_crosstab(_counted(spark, d))


_LISTS = "lists as (select u.entity_id as source1_entity_id, coalesce(string_agg(t.target_id, ',' order by t.target_id), '') as matched_entity_ids from er_s1 u left join er_truth t on t.s1_id = u.entity_id group by 1)"


def _truth_lists(spark, d):
    return result_lists(universe(spark, d), fixture(spark, d, "er_truth").select("s1_id", "target_id"))


@query("truth_explode", o.fix("select s1_id, target_source, target_id from er_truth where s1_id in (select entity_id from er_s1)"))
def truth_explode(spark, d):
    return truth_edges(_truth_lists(spark, d))


@query(
    "truth_integrity",
    o.fix(
        "select 'truth_id_not_in_s1' as check, count(*) as violations from lists where source1_entity_id not in (select entity_id from er_s1) "
        "union all select 's1_without_truth_row', count(*) from er_s1 where entity_id not in (select source1_entity_id from lists) "
        "union all select 'unknown_target', count(*) from er_truth where s1_id in (select entity_id from er_s1) and target_id not in (select entity_id from er_s2 union select entity_id from er_s3) "
        "union all select 's1_in_list', count(*) from er_truth where starts_with(target_id, 'S1-') union all select 'repeated_in_list', 0 "
        "union all select 'wrong_prefix', count(*) from er_truth where split_part(target_id, '-', 1) not in ('S2', 'S3') "
        "union all select 'malformed_id', count(*) from er_truth where not regexp_matches(target_id, '^S[123]-[0-9]+$') "
        "union all select 'empty_list', count(*) from lists where matched_entity_ids = '' union all select 'repeated_truth_row', count(*) - count(distinct source1_entity_id) from lists",
        _LISTS,
    ),
)
def truth_integrity(spark, d):
    targets = fixture(spark, d, "er_s2").unionAll(fixture(spark, d, "er_s3"))
    return quality.truth_integrity(fixture(spark, d, "er_s1"), targets, _truth_lists(spark, d))


_SHARED_TRUTH = "sh as (select distinct 'S1-' || ck as s1_id, 'S2-' || (ck // 3) as target_id from er_base union select distinct 'S1-' || ck, 'S2-' || (ck // 4 + 1000000) from er_base where ck % 5 = 0)"


_REACH = (
    "e as (select distinct a.s1_id as x, b.s1_id as y from sh a join sh b using (target_id))",
    "r(s1_id, reach) as (select x, x from e union select r.s1_id, e.y from r join e on r.reach = e.x)",
)


def _shared_truth(spark, d):
    """Truth in which neighbouring entities share targets."""
    base, s1 = fixture(spark, d, "er_base"), F.concat(F.lit("S1-"), F.col("ck")).alias("s1_id")
    a = base.select(s1, F.concat(F.lit("S2-"), F.floor(F.col("ck") / 3)).alias("target_id"))
    b = base.where("ck % 5 = 0").select(s1, F.concat(F.lit("S2-"), F.floor(F.col("ck") / 4) + 1000000).alias("target_id"))
    return a.unionAll(b).distinct()


@query(
    "components",
    o.fix(
        "select s1_id, min(reach) as component from r group by s1_id",
        _SHARED_TRUTH,
        *_REACH,
    ),
)
def components(spark, d):
    return quality.components(_shared_truth(spark, d))


@query("component_sizes", o.fix("select size, count(*) as components from (select component, count(*) as size from (select s1_id, min(reach) as component from r group by s1_id) group by 1) group by 1", _SHARED_TRUTH, *_REACH))
def component_sizes(spark, d):
    return quality.component_sizes(quality.components(_shared_truth(spark, d)))


_EXTENTS = (
    "l as (select s1_id, min(reach) as component from r group by s1_id)",
    "x as (select component, s1_id as node from l union select component, target_id from l join sh using (s1_id))",
    "ex as (select component, count(*) filter (where starts_with(node, 'S1-')) as s1, count(*) filter (where starts_with(node, 'S2-')) as s2, count(*) filter (where starts_with(node, 'S3-')) as s3 from x group by component)",
)


@query("component_extents", o.fix("select component, s1, s2, s3 from ex", _SHARED_TRUTH, *_REACH, *_EXTENTS))
def component_extents(spark, d):
    return quality.component_extents(_shared_truth(spark, d))


@query("largest_components", o.fix("select count(*) as components, max(s1) as largest_s1, max(s2) as largest_s2, max(s3) as largest_s3, max(s2 + s3) as largest_targets, max(s1 + s2 + s3) as largest_all from ex", _SHARED_TRUTH, *_REACH, *_EXTENTS))
def largest_components(spark, d):
    return quality.largest_components(quality.component_extents(_shared_truth(spark, d)))


@query("first_match", o.fix("select s1_id, min(target_id) as target_id from er_truth where s1_id in (select entity_id from er_s1) group by 1"))
def first_match(spark, d):
    return quality.first_match(_truth_lists(spark, d))


@query("preview", o.fix("select 'head' as part, * from (select * from er_s2 order by entity_id limit 5) union all select 'tail', * from (select * from er_s2 order by entity_id desc limit 5)"))
def preview(spark, d):
    return quality.preview(fixture(spark, d, "er_s2"), 5)


_LENGTH = "(select round(avg(length({f})), 6) as mean, quantile_cont(length({f}), 0.5)::double as median from {t})"


@query("length_shift", o.fix(" union all ".join(f"select '{f}' as field, a.mean as train_mean, b.mean as test_mean, a.median as train_median, b.median as test_median, round(b.mean - a.mean, 6) as mean_difference from {_LENGTH.format(f=f, t='er_s1')} a, {_LENGTH.format(f=f, t='er_s2')} b" for f in ("business_name", "business_address"))))
def length_shift(spark, d):
    return quality.length_shift(fixture(spark, d, "er_s1"), fixture(spark, d, "er_s2"), ["business_name", "business_address"])


@query("target_reuse", o.fix("select target_id, count(*) as n from sh group by 1 having count(*) > 1", _SHARED_TRUTH))
def target_reuse(spark, d):
    return quality.reuse(_shared_truth(spark, d))


@query("country_shift", o.fix("select country, cast(coalesce(sum(a), 0) as bigint) as train_rows, cast(coalesce(sum(b), 0) as bigint) as test_rows, coalesce(sum(a), 0) = 0 and coalesce(sum(b), 0) > 0 as is_new from (select country, 1 as a, 0 as b from er_s1 union all select country, 0, 1 from er_s2) group by country"))
def country_shift(spark, d):
    return quality.shift(fixture(spark, d, "er_s1"), fixture(spark, d, "er_s2"))


@query("id_overlap", o.fix("select entity_id from er_s2 intersect select target_id as entity_id from er_truth"))
def id_overlap(spark, d):
    return quality.overlap(fixture(spark, d, "er_s2"), fixture(spark, d, "er_truth").withColumnRenamed("target_id", "entity_id"))


# --- features, matchers, scores --------------------------------------------------------------

_FEATURES = f"""fx as (select t.s1_id, t.target_id, case when a.cm <> '' and a.cm = b.cm then 1 else 0 end as name_exact,
  round(case when a.cm <> '' and b.cm <> '' then {_JACCARD.format(a=_words("a.cm"), b=_words("b.cm"))} else 0 end, 9) as name_overlap,
  round(case when a.cm <> '' and b.cm <> '' then {_SIM.format("cm")} else 0 end, 9) as name_similarity, abs(length(a.cm) - length(b.cm)) as name_length_difference,
  case when a.cm = '' or b.cm = '' then 1 else 0 end as name_missing, case when a.ac <> '' and a.ac = b.ac then 1 else 0 end as address_exact,
  round(case when a.ac <> '' and b.ac <> '' then {_JACCARD.format(a=_words("a.ad"), b=_words("b.ad"))} else 0 end, 9) as address_overlap,
  round(case when a.ac <> '' and b.ac <> '' then len(list_intersect({_words("a.ad")}, {_words("b.ad")}))::double / len({_words("a.ad")}) else 0 end, 9) as address_in_target,
  round(case when a.ac <> '' and b.ac <> '' then len(list_intersect({_words("a.ad")}, {_words("b.ad")}))::double / len({_words("b.ad")}) else 0 end, 9) as target_in_address,
  case when list_has_any({o.KEYS["number"].replace("(ad,", "(a.ad,")}, {o.KEYS["number"].replace("(ad,", "(b.ad,")}) then 1 else 0 end as number_agreement,
  case when list_has_any({o.KEYS["postal"].replace("(ac,", "(a.ac,")}, {o.KEYS["postal"].replace("(ac,", "(b.ac,")}) then 1 else 0 end as postal_exact,
  case when a.ac = '' or b.ac = '' then 1 else 0 end as address_missing, case when a.cc <> '' and a.cc = b.cc then 1 else 0 end as country_exact
  from e t join n1 a on a.id = t.s1_id join n2 b on b.id = t.target_id)"""
_FLOATS = ("name_overlap", "name_similarity", "address_overlap", "address_in_target", "target_in_address")


def _features(spark, d):
    a, b = entities(spark, d, 1), entities(spark, d, 2)
    edges = compile_strategy(Strategy("shared", "name_token_unicode", True, 25), a, b)
    out = features.pair_features(diagnose.pair_frame(edges, a, b))
    return out.withColumns({c: F.round(c, 9) for c in _FLOATS})


@query("pair_features", o.fix("select * from fx", *_NAME_TOKEN, _FEATURES))
def pair_features(spark, d):
    return _features(spark, d)


_SCORE = "round(0.5 * name_similarity + 0.2 * name_overlap + 0.15 * address_overlap + 0.1 * postal_exact + 0.05 * number_agreement, 7)"


@query("ranked_candidates", o.fix(f"select s1_id, target_id, score, rank from (select *, row_number() over (partition by s1_id order by score desc, target_id) as rank from (select *, {_SCORE} as score from fx)) where rank <= 3", *_NAME_TOKEN, _FEATURES))
def ranked_candidates(spark, d):
    scored = features.score(_features(spark, d)).withColumn("score", F.round("score", 7))
    return features.rank(scored, 3).select("s1_id", "target_id", "score", F.col("rank").cast("long").alias("rank"))


_MATCH = "mt as (select s1_id, target_id from fx where name_exact = 1 or (name_similarity >= 0.8 and postal_exact = 1 and number_agreement = 1))"
_F05 = """sc as (select n, t, h, case when t = 0 then case when n = 0 then 1.0 else 0.0 end
  when h = 0 then 0.0 else 1.25 * (h::double / n) * (h::double / t) / (0.25 * (h::double / n) + h::double / t) end as f from ({per}))"""


@query("macro_f05", o.fix("select round(avg(f), 9) as macro_f05, sum(h)::double / sum(n) as pair_precision, sum(h)::double / sum(t) as pair_recall, count(*) filter (where n = 0) as abstentions, count(*) as entities from sc", o.truth(), *_NAME_TOKEN, _FEATURES, _MATCH, _F05.format(per=o.per_entity("mt"))))
def macro_f05(spark, d):
    out = metrics.macro_f05(universe(spark, d), truth(spark, d), features.match_signals(_features(spark, d)))
    return out.withColumn("macro_f05", F.round("macro_f05", 9))


def _first(k: int) -> str:
    return f"k{k} as (select s1_id, target_id from (select *, row_number() over (partition by s1_id order by score desc, target_id) as rank from (select *, {_SCORE} as score from fx)) where rank <= {k})"


@query(
    "grouped_metrics",
    o.fix(
        "select sum(p.h)::double / sum(p.n) as pair_precision, sum(p.h)::double / sum(p.t) as pair_recall, 2 * sum(p.h)::double / (sum(p.n) + sum(p.t)) as pair_f, "
        "count(*) filter (where a.h > 0)::double / count(*) filter (where p.t > 0) as top_1_accuracy, count(*) filter (where b.h > 0)::double / count(*) filter (where p.t > 0) as top_k_accuracy, "
        "count(*) filter (where p.h = p.t)::double / count(*) as complete_entity_recall, count(*) filter (where p.n = 0)::double / count(*) as abstention_rate, "
        "count(*) filter (where p.t = 0 and p.n > 0)::double / count(*) as false_alarm_rate, sum(p.n)::double / sum(c.n) as conversion, "
        "count(*) filter (where c.n = 0)::double / count(*) as zero_candidate_rate, count(*) filter (where c.n > 0 and c.h < c.t)::double / count(*) as incomplete_coverage_rate "
        f"from ({o.per_entity('e')}) c join ({o.per_entity('mt')}) p using (s1_id) join ({o.per_entity('k1')}) a using (s1_id) join ({o.per_entity('k3')}) b using (s1_id)",
        o.truth(), *_NAME_TOKEN, _FEATURES, _MATCH, _first(1), _first(3),
    ),
)
def grouped_metrics(spark, d):
    own = cut(_features(spark, d), "features")
    ranked = features.rank(features.score(own).withColumn("score", F.round("score", 7)), 3)
    return metrics.grouped_metrics(universe(spark, d), truth(spark, d), own.select("s1_id", "target_id"), features.match_signals(own), ranked, 3)


@query("pair_provenance", o.fix("select s1_id, target_id, " + ", ".join(f"cast(max(case when i = {i} then 1 else 0 end) as integer) as from_{n}" for i, n in enumerate(_NAMES)) + ", cast(count(*) as integer) as family_count from (" + " union all ".join(f"select s1_id, target_id, {i} as i from e{i}" for i in range(len(_NAMES))) + ") group by 1, 2", *_stage_ctes()))
def pair_provenance(spark, d):
    return features.provenance(stages(spark, d), _NAMES)


@query("cost_model", o.fix("select s.stage, ms, pair_bytes, candidate_pairs * ms / 1000 as seconds, candidate_pairs * pair_bytes / 1073741824.0::double as gib from (" + _metric_rows("u") + ") s, (select unnest([0.1::double, 1.0::double, 5.0::double]) as ms), (select unnest([128, 512, 2048]) as pair_bytes)", *_stage_ctes()))
def cost_model(spark, d):
    return metrics.cost_model(metrics_cumulative(spark, d), [0.1, 1.0, 5.0], [128, 512, 2048])


# --- sampling, persistence, validation -------------------------------------------------------


def _place(key: str) -> str:
    return f"md5('42|' || {key}), {key}"


@query("split_stratified", o.fix(f"select s1_id, country, s2, s3, matches, bucket from (select *, row_number() over (partition by country, bucket order by {_place('s1_id')}) as place, count(*) over (partition by country, bucket) as n from (select *, case when matches = 0 then '0' when matches = 1 then '1' else '2+' end as bucket from m)) where place <= round_even(0.2::double * n, 0)", _COUNTED))
def split_stratified(spark, d):
    return sampling.stratified(_counted(spark, d), ["country", "bucket"], 0.2, "s1_id")


@query("sample_pairs", o.fix(f"select s1_id, target_id, s1_id || '|' || target_id as pair from truth order by {_place('(s1_id || chr(124) || target_id)')} limit 100", o.truth()))
def sample_pairs(spark, d):
    return sampling.simple(truth(spark, d).withColumn("pair", F.concat_ws("|", "s1_id", "target_id")), 100, "pair")


@query("sample_per_source", o.fix(f"select entity_id, business_name, business_address, country, source from (select *, row_number() over (partition by source order by {_place('entity_id')}) as place from (select *, split_part(entity_id, '-', 1) as source from (select * from er_s2 union all select * from er_s3))) where place <= 50"))
def sample_per_source(spark, d):
    both = fixture(spark, d, "er_s2").unionAll(fixture(spark, d, "er_s3"))
    return sampling.per_group(both.withColumn("source", text.source_of(F.col("entity_id"))), "source", 50, "entity_id")


@query("persist_roundtrip", o.fix("select s1_id, target_id, row_number() over (partition by s1_id order by target_id) - 1 as candidate_order from e", *_NAME_TOKEN))
def persist_roundtrip(spark, d):
    path, u = new_path(spark, "stages"), universe(spark, d)
    signals = postings.postings(entities(spark, d, 1), "name_token_unicode").select("id")
    inputs = {f"S{n}": fixture(spark, d, f"er_s{n}") for n in (1, 2)}
    persist.persist(u, _name_token_edges(spark, d), path, "name_token", "S2", 25, signals, inputs=inputs)
    persist.validate(spark, path, "name_token", "S2", u, inputs)
    return persist.replay(spark, path, "name_token", "S2").select("s1_id", "target_id", F.col("candidate_order").cast("long").alias("candidate_order"))


_REASON = """case when c.n is not null then 'has_candidates' when u.id not in (select id from p1e) then 'zero_candidates_missing_signals'
  when u.id in (select x.id from p1e x join p2e y on x.k = y.k) then 'zero_candidates_filtered_or_invalid_keys' else 'zero_candidates_no_matching_index_keys' end"""
_COUNTED = "n1 u left join (select s1_id, count(*) as n from e group by 1) c on c.s1_id = u.id"


def _manifest(spark, d, edges: DataFrame) -> DataFrame:
    own, other = (postings.postings(entities(spark, d, n), "name_token_unicode") for n in (1, 2))
    shared = own.join(other.select("key").distinct(), "key", "left_semi").select("id")
    return persist.manifest_table(universe(spark, d), edges, "S2", own.select("id"), shared)


@query("s1_manifest", o.fix(f"select 'S2' as target_source, u.id as s1_id, coalesce(c.n, 0) as candidate_count, c.n is not null as has_candidates, {_REASON} as reason from {_COUNTED}", *_NAME_TOKEN))
def s1_manifest(spark, d):
    return _manifest(spark, d, _name_token_edges(spark, d))


@query(
    "coverage_states",
    o.fix(
        f"select u.id as s1_id, coalesce(c.n, 0) as candidate_count, coalesce(h.t, 0) as truth, coalesce(h.hit, 0) as recovered, case when c.n is null then {_REASON} "
        f"when coalesce(h.t, 0) = coalesce(h.hit, 0) then 'has_candidates_complete_entity_coverage' else 'has_candidates_incomplete_entity_coverage' end as state from {_COUNTED} "
        "left join (select t.s1_id, count(*) as t, count(e.s1_id) as hit from truth t left join e on e.s1_id = t.s1_id and e.target_id = t.target_id group by 1) h on h.s1_id = u.id",
        o.truth(),
        *_NAME_TOKEN,
    ),
)
def coverage_states(spark, d):
    edges = cut(_name_token_edges(spark, d), "edges")
    return persist.coverage(_manifest(spark, d, edges), edges, truth(spark, d))


@query("candidate_families", o.fix("select s1_id, target_id, string_agg(f, ',' order by i) as families, row_number() over (partition by s1_id order by target_id) - 1 as candidate_order from (" + " union all ".join(f"select s1_id, target_id, '{n}' as f, {i} as i from e{i}" for i, n in enumerate(_NAMES)) + ") group by s1_id, target_id", *_stage_ctes()))
def candidate_families(spark, d):
    rows = persist.edge_table(stages(spark, d, ordered=True), "cumulative", "S2", 250, "all", _NAMES)
    return rows.select("s1_id", "target_id", F.array_join("blocking_families", ",").alias("families"), F.col("candidate_order").cast("long").alias("candidate_order"))


_BAD = "case when ck % 50 = 0 then 'S1-' || ck when ck % 50 = 1 then 'S1-' || ck || chr(9) || 'S1-' || ck when ck % 50 = 2 then 'S1-' || ck || chr(9) || 'S2-1,S2-1' when ck % 50 = 3 then 'S9-' || ck || chr(9) || '' else 'S1-' || ck || chr(9) || 'S3-' || ck end"


@query(
    "validate_lists",
    o.fix(
        "select 'malformed_row' as rule, 'error' as level, count(*) filter (where ck % 50 = 0) as n from b having count(*) filter (where ck % 50 = 0) > 0 "
        "union all select 'self_match', 'error', count(*) from b where ck % 50 = 1 having count(*) > 0 union all select 'wrong_prefix', 'error', count(*) from b where ck % 50 = 1 having count(*) > 0 "
        "union all select 'repeated_id_in_list', 'error', count(*) from b where ck % 50 = 2 having count(*) > 0 union all select 'extra_s1', 'error', count(*) from b where ck % 50 = 3 having count(*) > 0 "
        "union all select 'missing_s1', 'error', count(*) from b where ck % 50 in (0, 3) having count(*) > 0",
        "b as (select ck from er_base where ck % 10 <> 9)",
    ),
)
def validate_lists(spark, d):
    base = fixture(spark, d, "er_base").where("ck % 10 <> 9")
    body = base.select((F.col("ck") + 2).cast("long").alias("line_no"), F.expr(_BAD.replace("chr(9)", "'\\t'")).alias("value"))
    head = spark.range(1).select(F.lit(1).cast("long").alias("line_no"), F.lit("source1_entity_id\tmatched_entity_ids").alias("value"))
    return validate.list_issues(head.unionAll(body), "matching", universe(spark, d)).drop("examples")
