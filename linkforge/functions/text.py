"""Unicode-safe text normalisation and name similarity as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Legal-form words that the core name leaves out.
LEGAL_WORDS = ("ag", "agco", "co", "company", "corp", "corporation", "inc", "incorporated", "limited", "llc", "llp", "ltd", "pvt", "private")

_SPACES = re.compile(r"\s+")
#: ASCII white space as Python sees it; Java's \s lacks U+001C to U+001F.
_ASCII_SPACES = r"[\x09-\x0D\x1C-\x20]+"
_WORDLESS = r"[^\p{L}\p{N}_\s]"


def safe_text(value: str | None) -> str:
    """NFKC, case folding, white-space runs to one space, trimmed; null is empty."""
    return _SPACES.sub(" ", unicodedata.normalize("NFKC", value or "").casefold()).strip()


def _fold(s: pd.Series) -> pd.Series:
    return s.map(safe_text, na_action="ignore")


def safe(c: Column) -> Column:
    """``safe_text`` of a column. ASCII values, nearly all of them, stay in the JVM: only the others
    are sent to Python (ASCII rows travel as nulls)."""
    plain = ~c.rlike(r"[^\x00-\x7F]")
    ascii_form = F.trim(F.regexp_replace(F.lower(c), _ASCII_SPACES, " "))
    return F.when(c.isNull(), "").when(plain, ascii_form).otherwise(F.pandas_udf(_fold, StringType())(F.when(~plain, c)))


def ascii_safe(c: Column) -> Column:
    """``safe`` for columns known to be ASCII: no Python in the plan."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(c), _ASCII_SPACES, " ")), F.lit(""))


def compact(clean: Column) -> Column:
    """A safe text with every character that is no letter, digit or underscore turned to a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(clean, _WORDLESS, " "), r"[\s\x1C-\x1F]+", " "))


def split_words(c: Column) -> Column:
    """Words of a one-space-separated text; the empty text has none."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def core(compacted: Column) -> Column:
    """A compact name without legal-form words."""
    return F.array_join(F.filter(F.split(compacted, " "), lambda t: (t != "") & ~t.isin(*LEGAL_WORDS)), " ")


def token_set(c: Column) -> Column:
    """Distinct words in code-point order."""
    return F.array_sort(F.array_distinct(split_words(c)))


def has_non_ascii(raw: Column) -> Column:
    return F.coalesce(raw, F.lit("")).rlike(r"[^\x00-\x7F]")


def jaccard(a: Column, b: Column) -> Column:
    """Token Jaccard of two arrays: both empty 1, one empty 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty texts are equal."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(longer, F.lit(1)))


def initials(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), "")


def abbreviation(a: Column, b: Column) -> Column:
    """Equal initials of equally many words, or a word of up to four letters that begins a word of
    the other side."""
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (initials(a) == initials(b))

    def begins(x: Column, y: Column) -> Column:
        return F.exists(x, lambda s: (F.char_length(s) <= 4) & F.exists(y, lambda t: t.startswith(s)))

    return same | begins(a, b) | begins(b, a)


def same_words(a: Column, b: Column) -> Column:
    """Equal as multisets."""
    return F.array_sort(a) == F.array_sort(b)


def subset_either(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))


def shares_digits(a: Column, b: Column) -> Column:
    """Whether two texts have a run of digits in common."""
    runs = lambda c: F.regexp_extract_all(c, F.lit(r"\p{Nd}+"), 0)
    return F.arrays_overlap(runs(a), runs(b))


def f05(precision: Column, recall: Column) -> Column:
    """F-measure that weighs precision twice as much; 0 where both are 0."""
    return F.when(precision + recall == 0, 0.0).otherwise(1.25 * precision * recall / F.greatest(0.25 * precision + recall, F.lit(1e-300)))


def match_bucket(listed: Column) -> Column:
    """0, 1 or 2+: how many ids a comma list holds."""
    n = F.when(F.trim(listed) == "", 0).otherwise(F.size(F.split(listed, ",")))
    return F.when(n == 0, "0").when(n == 1, "1").otherwise("2+")


def source_of(entity_id: Column) -> Column:
    return F.substring_index(entity_id, "-", 1)


def valid_id(entity_id: Column) -> Column:
    return entity_id.rlike(r"^S[123]-\p{Nd}+$")
