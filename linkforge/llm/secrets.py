"""Secret scan over an incremental blob ledger.

Texts are content-addressed (SHA-256 of the whole text), so a blob that occurs at many paths or in
many historical versions is scanned once. A ledger holds, per blob, the ``rule@version`` pairs it
was scanned with and what they found; a run scans only the pairs that the ledger lacks, appends
them, and joins findings back to all paths. Raising a rule's version re-scans that rule alone.

The three base rules are fixed by their patterns; the further rules add spans and never remove one.

Defined cases: a null text counts as an empty one; repeated rows each get the findings of their
text; an empty table gives no rows; further columns are ignored unless asked for as ``paths``; a
null path is kept as it is. Whole texts are scanned, however long, in time that grows with their
length: no rule goes over the same stretch of a text from more than a bounded number of starts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.arrow import map_arrow
from linkforge.runtime import cut, exists, new_path

Spans = list[tuple[int, int]]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM_BEGIN = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
_PEM_END = re.compile(r"-----END [A-Z ]{0,40}PRIVATE KEY-----")
_NOT_PEM = re.compile(r"[^A-Za-z0-9+/=\s:,-]")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_GITHUB = re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")
_SLACK = re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")


def _assign(text: str) -> Spans:
    low = text.lower()
    if not any(w in low for w in _ASSIGN_WORDS):
        return []
    return [m.span() for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]


def _spans(pattern: re.Pattern, hint: str = "") -> Callable[[str], Spans]:
    def find(text: str) -> Spans:
        return [m.span() for m in pattern.finditer(text)] if not hint or hint in text else []

    return find


def _pem(text: str) -> Spans:
    """Private keys: a BEGIN mark, and up to the next END mark if only key characters lie between."""
    if "PRIVATE KEY-----" not in text:
        return []
    found, free, bad = [], 0, -1
    ends = [m.span() for m in _PEM_END.finditer(text)]
    at = 0
    for m in _PEM_BEGIN.finditer(text):
        start, stop = m.span()
        if start < free:
            continue
        while at < len(ends) and ends[at][0] < stop:
            at += 1
        if at < len(ends):
            if bad < stop:
                bad = b.start() if (b := _NOT_PEM.search(text, stop)) else len(text)
            if bad >= ends[at][1]:
                stop = ends[at][1]
        found.append((start, stop))
        free = stop
    return found


@dataclass(frozen=True)
class Rule:
    """One kind of secret; a new ``version`` makes every blob unseen for this rule."""

    kind: str
    find: Callable[[str], Spans]
    version: int = 1
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In this order kinds are listed. A maximal run of 24 hex digits or 16 key characters after AKIA is
#: the same span whether the length is asked for by the pattern or afterwards.
RULES: tuple[Rule, ...] = (
    Rule("assign", _assign, base=True),
    Rule("access", _spans(_ACCESS, "AKIA"), base=True),
    Rule("hex", _spans(_HEX), base=True),
    Rule("pem", _pem),
    Rule("jwt", _spans(_JWT, "eyJ")),
    Rule("github", _spans(_GITHUB, "gh")),
    Rule("slack", _spans(_SLACK, "xox")),
)

LEDGER_SCHEMA = "blob binary, scanned array<string>, found array<struct<rule:string,start:long,stop:long>>"
_FOUND = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def scan(text: str, rules: Sequence[Rule] = RULES) -> list[tuple[str, int, int]]:
    """(rule key, start, stop) of every finding, in rule order and then by place."""
    return [(r.key, a, b) for r in rules for a, b in r.find(text)]


def blobs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``blob``, the SHA-256 of the whole text (null: of the empty one)."""
    return docs.withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def unseen(docs: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """(blob, text, rules): each distinct blob that some rule versions have not seen, and which.

    With a ledger the hashes alone meet it first, so that of the texts only the unseen ones move.
    """
    keys = F.array(*[F.lit(r.key) for r in rules])
    own = blobs(docs.select(F.col(text).alias("text")))
    if ledger is None:
        return own.groupBy("blob").agg(F.first("text").alias("text")).withColumn("rules", keys)
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
    missing = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
    todo = own.select("blob").distinct().join(seen, "blob", "left").select("blob", missing.alias("rules")).where(F.size("rules") > 0)
    todo = cut(todo, "todo")
    return own.join(todo, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("rules").alias("rules"))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """New ledger rows: what the unseen rule versions find in the blobs of ``docs``, a row per blob scanned."""
    by_key = {r.key: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for content, keys in zip(batch.column(1), batch.column(2), strict=True):
                hits = scan(content.as_py() or "", [by_key[k] for k in keys.as_py()])
                found.append([{"rule": k, "start": a, "stop": b} for k, a, b in hits])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, _FOUND)], names=["blob", "scanned", "found"])

    return map_arrow(unseen(docs, ledger, rules, text), run, LEDGER_SCHEMA)


def update_ledger(docs: DataFrame, path: str, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Scan what the Parquet ledger at ``path`` lacks, append it, and return the whole ledger."""
    spark = docs.sparkSession
    old = spark.read.schema(LEDGER_SCHEMA).parquet(path) if exists(spark, path) else None
    scan_unseen(docs, old, rules, text).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def findings(docs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, paths: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``paths`` and ``found`` (rule, start, stop) of the current rules for every row of ``docs``."""
    now = F.array(*[F.lit(r.key) for r in rules])
    current = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list(F.filter("found", lambda f: F.array_contains(now, f.rule))))).alias("found"))
    current = cut(current.where(F.size("found") > 0), "found")  # a plain side: a blob at very many paths is split by the join
    own = blobs(docs, text).select(*paths, "blob")
    return own.join(current, "blob", "left").select(*paths, F.coalesce("found", F.array().cast("array<struct<rule:string,start:long,stop:long>>")).alias("found"))


def _listed(found, rules: Sequence[Rule]):
    """kind:start:stop of the findings by start, then kind as listed, comma-joined."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    rows = F.transform(found, lambda f: F.struct(f.start.alias("start"), order[f.rule].alias("place"), f.stop.alias("stop"), F.substring_index(f.rule, "@", 1).alias("kind")))
    return F.array_join(F.transform(F.array_sort(rows), lambda r: F.concat_ws(":", r.kind, r.start, r.stop)), ",")


def _count(key: str):
    return F.size(F.filter("found", lambda f: f.rule == key)).cast("long")


def report(docs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, and all spans."""
    base = [r for r in rules if r.base]
    keys = F.array(*[F.lit(r.key) for r in base])
    found = findings(docs, ledger, rules)
    of_base = F.filter("found", lambda f: F.array_contains(keys, f.rule))
    return found.select(
        "doc_id",
        *[_count(r.key).alias(f"n_{r.kind}") for r in base],
        F.sha2(_listed(of_base, base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("found"), rules).alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return report(docs, update_ledger(docs, new_path(spark, "ledger")))
