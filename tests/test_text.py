"""Text and address expressions against plain Python, on literals and random Unicode."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from linkforge.functions import address, text

ALPHABET = "aB9 _-.,#é ßİıﬁＡ９کंपनी文ዐ٣²①\x1c\x85  \tΣς'"


def _random(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 24))) for _ in range(n)]


def py_safe(v):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", v or "").casefold()).strip()


def py_compact(v):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", py_safe(v))).strip()


def py_postal(v):
    return list(dict.fromkeys(m.replace("-", "") for m in re.findall(r"(?<!\w)\d{4,6}(?:-\d{4})?(?!\w)", py_safe(v))))


def py_numbers(v):
    return list(dict.fromkeys(re.findall(r"(?<![a-z0-9])\d+[a-z]?(?![a-z0-9])", py_compact(v), re.I)))


@pytest.fixture(scope="module")
def values(spark):
    rows = _random(3000, 1) + [None, "", "  Straße 12, München 80331 ", "\x1cA\x1dB", "कंपनी", "12é", "Unit 4B, 55-57 King St.", "ZIP 12345-6789", "1234567"]
    return rows, spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i long, v string")


def test_safe_and_compact_equal_python(values):
    rows, df = values
    got = df.select("i", text.safe(F.col("v")).alias("s")).withColumn("c", text.compact(F.col("s"))).collect()
    for r in got:
        assert r["s"] == py_safe(rows[r["i"]]) and r["c"] == py_compact(rows[r["i"]]), repr(rows[r["i"]])


def test_address_signals_equal_python(values):
    rows, df = values
    for r in df.select("i", address.parse(text.safe(F.col("v"))).alias("p")).collect():
        v, p = rows[r["i"]], r["p"]
        tokens = list(dict.fromkeys(py_compact(v).split()))
        assert p["tokens"] == tokens
        assert p["informative"] == [t for t in tokens if t not in address.GENERIC_WORDS and not t.isdigit() and len(t) >= 2]
        assert p["numbers"] == py_numbers(v) and p["postal"] == py_postal(v), repr(v)


@pytest.mark.parametrize(
    ("raw", "clean", "informative", "numbers", "postal"),
    [
        ("", "", [], [], []),
        ("123 Main Street, Austin, TX 78701", "123 main street, austin, tx 78701", ["main", "austin", "tx"], ["123", "78701"], ["78701"]),
        ("Plot N-14, MIDC, Ambad, Nashik 422010", "plot n-14, midc, ambad, nashik 422010", ["plot", "midc", "ambad", "nashik"], ["14", "422010"], ["422010"]),
        ("Unit 4B, 55-57 King St.", "unit 4b, 55-57 king st.", ["4b", "king"], ["4b", "55", "57"], []),
        ("  Straße 12, München 80331 ", "strasse 12, münchen 80331", ["strasse", "münchen"], ["12", "80331"], ["80331"]),
    ],
)
def test_address_literals(spark, raw, clean, informative, numbers, postal):
    p = spark.createDataFrame([(raw,)], "v string").select(address.parse(text.safe(F.col("v"))).alias("p")).first()["p"]
    assert (p["address_clean"], p["informative"], p["numbers"], p["postal"]) == (clean, informative, numbers, postal)


def _one(spark, **cols):
    df = spark.range(1)
    return df.select(*[c.alias(n) for n, c in cols.items()]).first()


def test_similarity_functions(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    r = _one(
        spark,
        j0=text.jaccard(arr(), arr()), j1=text.jaccard(arr("a"), arr()), j2=text.jaccard(arr("a", "b"), arr("b", "c")),
        l0=text.levenshtein_similarity(F.lit(""), F.lit("")), l1=text.levenshtein_similarity(F.lit("é"), F.lit("e")),
        a0=text.abbreviation(arr("international", "business"), arr("intl", "b")), a1=text.abbreviation(arr("acme"), arr("zeta")), a2=text.abbreviation(arr("int"), arr("international", "x")),
        s=text.subset_either(arr("a"), arr("a", "b")), w=text.same_words(arr("a", "b"), arr("b", "a")), d=text.shares_digits(F.lit("a12"), F.lit("12b")),
        core=text.core(F.lit("acme pvt ltd india limited")), f=text.f05(F.lit(2 / 3), F.lit(1.0)), z=text.f05(F.lit(0.0), F.lit(0.0)),
        b0=text.match_bucket(F.lit("")), b1=text.match_bucket(F.lit("S2-1")), b2=text.match_bucket(F.lit("S2-1,S3-2")),
    )
    assert (r["j0"], r["j1"], r["j2"]) == (1.0, 0.0, pytest.approx(1 / 3)) and (r["l0"], r["l1"]) == (1.0, 0.0)
    assert r["a0"] and not r["a1"] and r["a2"] and r["s"] and r["w"] and r["d"]
    assert r["core"] == "acme india" and r["f"] == pytest.approx(0.714, abs=1e-3) and r["z"] == 0.0
    assert (r["b0"], r["b1"], r["b2"]) == ("0", "1", "2+")
