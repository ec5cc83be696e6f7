"""Address signals as column expressions over the safe and compact forms of an address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkforge.functions.text import compact, split_words

#: Words too common in addresses to tell them apart.
GENERIC_WORDS = (
    "apt", "apartment", "blvd", "city", "county", "dist", "district", "dr", "drive", "hwy",
    "lane", "ln", "rd", "road", "route", "st", "street", "suite", "tal", "unit",
)
#: Decimal digits, and the further digits that Python's ``isdigit`` accepts after NFKC.
_DIGITS_ONLY = (
    r"^[\p{Nd}፩-፱᧚⓵-⓽⓿❶-❾➀-➈➊-➒"
    r"\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}]+$"
)
#: What counts as a house number and as a postal code.
_NUMBER = r"(?iu)(?<![a-z0-9])\p{Nd}+[a-z]?(?![a-z0-9])"
_POSTAL = r"(?<![\p{L}\p{N}_])\p{Nd}{4,6}(?:-\p{Nd}{4})?(?![\p{L}\p{N}_])"


def tokens(clean: Column) -> Column:
    """Distinct words of the compact address, in order."""
    return F.array_distinct(split_words(compact(clean)))


def informative(clean: Column) -> Column:
    """Words that are not generic, not all digits and at least two characters long."""
    return F.filter(tokens(clean), lambda t: ~t.isin(*GENERIC_WORDS) & (F.char_length(t) >= 2) & ~t.rlike(_DIGITS_ONLY))


def numbers(clean: Column) -> Column:
    """Distinct house-number-like parts of the compact address, in order."""
    return F.array_distinct(F.regexp_extract_all(compact(clean), F.lit(_NUMBER), 0))


def postal(clean: Column) -> Column:
    """Distinct postal-code candidates (four to six digits, with or without a four-digit part)."""
    found = F.regexp_extract_all(clean, F.lit(_POSTAL), 0)
    return F.array_distinct(F.transform(found, lambda s: F.replace(s, F.lit("-"), F.lit(""))))


def parse(clean: Column) -> Column:
    """All signals of a safe address as one struct."""
    return F.struct(
        clean.alias("address_clean"), tokens(clean).alias("tokens"), informative(clean).alias("informative"), numbers(clean).alias("numbers"), postal(clean).alias("postal")
    )
