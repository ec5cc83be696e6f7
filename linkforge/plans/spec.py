"""Blocking strategies as values, compiled to DataFrames, with rewrites on their algebra."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from linkforge.operators import blocking


@dataclass(frozen=True)
class Strategy:
    """One blocking strategy; ``kind`` is shared, intersection, signature or postal_number."""

    kind: str
    family: str = ""
    country_aware: bool = False
    cap: int | None = None

    @property
    def name(self) -> str:
        base = {"shared": self.family, "intersection": f"two_{self.family}", "signature": f"signature_{self.family}", "postal_number": "postal_number"}[self.kind]
        return f"{'country_' if self.country_aware else ''}{base}{f'_freq{self.cap}' if self.cap is not None else ''}"


def compile_strategy(s: Strategy, s1: DataFrame, target: DataFrame) -> DataFrame:
    """The strategy's candidate edges."""
    if s.kind == "shared":
        return blocking.shared_key(s1, target, s.family, s.country_aware, s.cap)
    if s.kind == "intersection":
        return blocking.two_token_intersection(s1, target, s.family, s.cap)
    if s.kind == "signature":
        return blocking.two_token_signature(s1, target, s.family, s.cap)
    if s.kind == "postal_number":
        return blocking.postal_and_number(s1, target, s.cap, None, s.country_aware)
    raise ValueError(f"unknown strategy kind: {s.kind}")


def compile_stages(stages: list[Strategy], s1: DataFrame, target: DataFrame, truth: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """The edges of several strategies with their stage bits, from one join (see ``blocking.tagged``)."""
    if len({s.country_aware for s in stages}) != 1 or any(s.kind not in ("shared", "postal_number") for s in stages):
        raise ValueError("stages must be of shared keys, and all or none with countries")
    families = [[("number", s.cap), ("postal", None)] if s.kind == "postal_number" else [(s.family, s.cap)] for s in stages]
    return blocking.tagged(s1, target, families, stages[0].country_aware, truth, ordered)


def covers(a: Strategy, b: Strategy) -> bool:
    """Whether b's edges are always among a's, so that b adds nothing to a union with a."""
    if a == b:
        return True
    if a.kind == b.kind == "shared" and a.family == b.family:
        wider = a.cap is None or (b.cap is not None and b.cap <= a.cap)
        return wider and (b.country_aware or not a.country_aware)
    if b.kind == "postal_number" and a.kind == "shared":
        inner = (Strategy("shared", "number", b.country_aware, b.cap), Strategy("shared", "postal", b.country_aware))
        return any(covers(a, i) for i in inner)
    if b.kind == "signature" and a.kind == "intersection":
        return a.family == b.family and a.cap == b.cap
    return False


def absorb(union: list[Strategy]) -> list[Strategy]:
    """A union without members that another one covers; the order is kept."""
    return [s for i, s in enumerate(union) if not any(covers(o, s) and (not covers(s, o) or j < i) for j, o in enumerate(union) if j != i)]
