"""Secrets, PII, SimHash, toxicity: against plain versions, and on odd tables."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linkforge.llm import pii, secrets, simhash, toxicity
from linkforge.runtime import cut, new_path


# --- secrets ---------------------------------------------------------------------------------


#: The rules restated as plain patterns, with what a match must hold besides.
PLAIN = {
    "assign": (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?[ ]*[:=][ ]*["']?(?P<own>[A-Za-z0-9+/_.=-]+)""", 6),
    "access": (r"(?P<own>AKIA[A-Z0-9]+)", 20),
    "hex": (r"(?P<own>[0-9a-f]+)", 24),
    "pem": (r"(?P<own>-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,-]*?-----END [A-Z ]{0,40}PRIVATE KEY-----)?)", 0),
    "jwt": (r"(?<![A-Za-z0-9_-])(?P<own>eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,})", 0),
    "github": (r"\b(?P<own>gh[pousr]_[A-Za-z0-9]{36,})", 0),
    "slack": (r"\b(?P<own>xox[abprs]-[A-Za-z0-9-]{10,})", 0),
}


def plain_secrets(text):
    spans = [(m.start(), i, m.end(), kind) for i, (kind, (pattern, least)) in enumerate(PLAIN.items()) for m in re.finditer(pattern, text or "") if len(m["own"]) >= least]
    listed = lambda xs: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(xs))
    base = [x for x in spans if x[1] < 3]
    return (*[sum(x[3] == k for x in base) for k in ("assign", "access", "hex")], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans))


def test_secret_report_equals_plain_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r[0]: tuple(r[1:]) for r in secrets.query(spark, sf).collect()}
    assert got == {i: plain_secrets(t) for i, t in texts.items()}


def test_secret_rules_equal_plain_patterns():
    rng = random.Random(5)
    words = ["-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----END PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "MIIB+/=", "\n", " ", "_", "eyJ", "abcdefgh1", ".", "-", "ghp_", "a1" * 18, "xoxb-", "xoxp-12345", "AKIA", "ABCDEFGHIJ123456", "0123456789abcdef", "token", "API_KEY", ": ", "=", "'", '"', "é"]
    for _ in range(5000):
        text = "".join(rng.choice(words) for _ in range(rng.randint(1, 14)))
        got = [(r.kind, a, b) for r in secrets.RULES for a, b in r.find(text)]
        assert got == [(k, m.start(), m.end()) for k, (pattern, least) in PLAIN.items() for m in re.finditer(pattern, text) if len(m["own"]) >= least], text


@pytest.mark.parametrize("text", ["-----BEGIN PRIVATE KEY-----\n", "-----BEGIN PRIVATE KEY-----_", "eyJ-", "eyJaaaaaaaaa.", "ghp_", "token ", "0123456789abcdef0123456g", "AKIAa"])
def test_secret_scan_is_linear(text):
    start = time.perf_counter()
    secrets.scan(text * (400_000 // len(text)))
    assert time.perf_counter() - start < 10


def test_secret_base_rules_keep_failing_matches_consumed():
    find = dict((r.kind, r.find) for r in secrets.RULES)
    assert find["assign"]("password:token:abcdef") == []  # the short match takes the second keyword along
    assert find["assign"]('API_KEY" = "abc123"') == [(0, 18)]
    assert find["assign"]("paſſword=abcdef1") == []  # letters in either case are ASCII letters
    assert find["access"]("AKIA" + "A" * 16) == [(0, 20)] and find["access"]("AKIA" + "A" * 15) == []
    assert find["hex"]("é" + "ab" * 12) == [(1, 25)]


def test_ledger_scans_only_unseen_blobs_and_versions(spark, tmp_path):
    path, scanned = new_path(spark, "ledger"), tmp_path / "scanned"

    def find(text):
        with open(scanned, "a") as f:
            f.write(text + "\n")
        return secrets.RULES[0].find(text)

    def since():
        texts = sorted(scanned.read_text().split("\n")[:-1]) if scanned.exists() else []
        scanned.write_text("")
        return texts

    docs = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, "none")], "doc_id long, text string")
    rules = (secrets.Rule("assign", find, base=True), *secrets.RULES[1:3])
    first = secrets.update_ledger(docs, path, rules)
    assert first.count() == 2 and since() == ["none", "token=abcdef"]  # two blobs, though three paths
    assert secrets.update_ledger(docs, path, rules).count() == 2 and since() == []  # nothing is scanned again
    newer = (secrets.Rule("assign", find, version=2, base=True), *rules[1:])
    todo = secrets.unseen(docs, first, newer).collect()
    assert {tuple(r["rules"]) for r in todo} == {("assign@2",)}
    more = docs.unionAll(spark.createDataFrame([(4, "fresh")], docs.schema))
    assert secrets.unseen(more, first, rules).count() == 1
    second = secrets.update_ledger(more, path, newer)
    assert since() == ["fresh", "none", "token=abcdef"] and secrets.unseen(more, second, newer).count() == 0
    found = {r["doc_id"]: len(r["found"]) for r in secrets.findings(more, second, newer).collect()}
    assert found == {1: 1, 2: 1, 3: 0, 4: 0}


def test_secrets_on_odd_tables(spark, odd_docs, no_docs):
    out = secrets.report(odd_docs, cut(secrets.scan_unseen(odd_docs)))
    assert out.count() == odd_docs.count()
    assert secrets.report(no_docs, cut(secrets.scan_unseen(no_docs))).count() == 0


# --- personal data ---------------------------------------------------------------------------

_E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_I = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_C = re.compile(r"[0-9]([\x20-]?[0-9])+")
_P = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def naive(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in _E.finditer(t)]
    out += [("ip", *m.span()) for m in _I.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _C.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in _P.finditer(t) if 10 <= len(digits(m)) <= 15]


def test_base_identifiers_equal_plain_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("ab.@-+ 0123456789()12.@é") for _ in range(rng.randint(0, 60)))
        assert naive(t) == pii.detect(t), t


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write jane (at) example (dot) com now", "email", "jane (at) example (dot) com"),
        ("write jane at example dot com now", "email", "jane at example dot com"),
        ("ＪＯＨＮ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ＪＯＨＮ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("mail jаne@exаmple.com", "email", "jаne@exаmple.com"),
        ("ja​ne@exam​ple.com", "email", "ja​ne@exam​ple.com"),
        ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("pay four two four two four two four two four two four two four two four two!", "card", "four two four two four two four two four two four two four two four two"),
        ("host one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("４２４２ ４２４２ ４２４２ ４２４２", "card", "４２４２ ４２４２ ４２４２ ４２４２"),
    ],
)
def test_disguises_map_back_to_source(text, kind, found):
    base, added = pii.find(text)
    assert (kind, text.index(found), text.index(found) + len(found)) in added
    assert base == pii.detect(text)
    assert f"<{kind.upper()}>" in pii.redact(text)


@pytest.mark.parametrize("text", ["look at the dot on page", "we met at google.com", "un deux trois, one two", "the point is at hand", "one of two at home"])
def test_plain_text_is_left_alone(text):
    assert pii.find(text) == ([], []) and pii.redact(text) == text


@pytest.mark.parametrize(
    ("text", "span"),
    [
        ("write john.smith at example.com now", ("email", 6, 31)),
        ("write john.smith  at \t example.com now", ("email", 6, 34)),
        ("write j.smith-at-example.com, a.b_arroba_example.com", ("email", 30, 52)),
        ("call plus 49 30 12345678 now", ("phone", 5, 24)),
        ("call +49 30 [dash] 12345678 now", ("phone", 5, 27)),
        ("pay 4242 4242 4242 4 2 4 two now", ("card", 4, 28)),
    ],
)
def test_a_single_disguise_is_found_without_another(text, span):
    assert span in pii.find(text)[1]


def test_unrelated_words_change_no_span():
    rng = random.Random(11)
    words = "john.smith jane x7 at AT arroba example.com example com dot point plus Plus mas 49 30 12345678 4242 424 2 one two zero dash minus ( ) [ ] - @ [at] (dot) [-] <hyphen> {arroba} _at_ -arobase- , 192 168 1 é".split()
    for _ in range(20_000):
        text = "".join(rng.choice(words) + rng.choice(["", " ", " ", "  ", "\t"]) for _ in range(rng.randint(2, 9)))
        assert pii.find(text) == pii.find(text + "\n; dot"), text


@pytest.mark.parametrize(
    "text",
    ["0,1,0,0,", "1 2 3 4 ", "1 two 3 four ", " ", "(", "(                    ", "a@", "at ", "a at                    ", "1 dot ", "a", "a@b.com ", "a.b (at) c (dot) com ", "+1(", "plus ", "1.", "1", "\u0661", "x@y.z two three four "],
)
def test_personal_data_scan_is_linear(text):
    start = time.perf_counter()
    pii.find(text * (400_000 // len(text)) + " \u6587 seven eight dot")
    assert time.perf_counter() - start < 12


def test_long_local_parts_are_seen_whole():
    local = "x" + "." + "y" * 300
    assert ("email", 0, len(local) + len(" at example.com")) in pii.find(local + " at example.com")[1]


def test_long_runs_of_zeros_in_an_address_part():
    part = "0" * 5000
    assert pii.detect(f"{part}1.2.3.4") == [("ip", 0, 5007)]
    assert pii.detect(f"{part}.2.3.4")[0][0] == "ip" and not [s for s in pii.detect(f"{part}256.2.3.4") if s[0] == "ip"]


def test_pieces_map_boundaries():
    p = pii.Pieces("ab cd ef")
    p.rewrite(re.compile("cd"), lambda m: "X")
    assert p.text == "ab X ef" and p.source(3, False) == 3 and p.source(4, True) == 5 and p.source(7, True) == 8
    p.rewrite(re.compile("b X"), lambda m: "longer")
    assert p.text == "alonger ef" and p.source(1, False) == 1 and p.source(7, True) == 5 and p.source(10, True) == 8


def test_pii_on_odd_tables(odd_docs, no_docs):
    rows = pii.find_personal_data(odd_docs).collect()
    assert len(rows) == odd_docs.count() and sum(r["n_email"] for r in rows) == 1
    masked = {r["doc_id"]: r["text"] for r in pii.redact_documents(odd_docs).collect()}
    assert masked[8].endswith("mail <EMAIL>") and masked[3] is None and masked[4] == ""
    assert pii.find_personal_data(no_docs).count() == 0 and pii.redact_documents(no_docs).count() == 0


# --- SimHash ---------------------------------------------------------------------------------


def slow_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprint_equals_definition():
    rng = random.Random(1)
    for text in ["", "  \n", "A", "a B", "a b c", "É é a", *(" ".join(rng.choice("abcdéF") for _ in range(rng.randint(1, 40))) for _ in range(200))]:
        assert simhash.fingerprint(text) % (1 << 64) == slow_print(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_links_are_exact(radius):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 2**63, 9).astype(np.uint64)
    fps = np.unique(np.array([c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for c in centres for _ in range(40)], np.uint64))
    rng.shuffle(fps)

    def classes(pairs, n):
        up = list(range(n))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return [find(x) for x in range(n)]

    for own in (fps, fps[:50], fps[:2]):
        n = len(own)
        want = [(i, j) for i in range(n) for j in range(i) if int(np.bitwise_count(own[i] ^ own[j])) <= radius]
        assert classes(simhash.links_in_runs(own, np.array([0]), np.array([n]), radius), n) == classes(want, n)


def test_near_duplicates_with_split_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**62))
    fps = sorted({centre ^ sum(1 << int(b) for b in rng.choice(60, 2, replace=False)) for _ in range(60)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash.fingerprint_links(df, chunk=8).collect()
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for e in edges:
        assert bin((e["a"] ^ e["b"]) % (1 << 64)).count("1") <= 3
        a, b = find(e["a"]), find(e["b"])
        up[max(a, b)] = min(a, b)
    want = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for x in fps:
            for y in fps:
                if bin(x ^ y).count("1") <= 3 and want[x] > want[y]:
                    want[x], changed = want[y], True
    assert {f: find(f) for f in fps} == want


def test_simhash_query_equals_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: slow_print(t) for i, t in texts.items()}
    ids, up = sorted(prints), {i: i for i in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_simhash_on_odd_tables(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == odd_docs.count() and by[2] == 1 and by[5] == by[4] == 3 and by[None] is None
    kept = [r["doc_id"] for r in simhash.without_near_duplicates(odd_docs).collect()]
    assert sorted(kept, key=str).count(1) == 1 and 2 not in kept and 4 not in kept and None in kept
    assert simhash.near_duplicates(no_docs).count() == 0


# --- toxicity --------------------------------------------------------------------------------


def _toy(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdeginorst") for _ in range(rng.randint(2, 7)))
    texts, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 80))]
        if i % 4 == 0:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(("zzuck", "zzuckling", "qqvile")))
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_classifier_learns_held_out_rows():
    model = toxicity.train(*_toy(300, 1), steps=150)
    logit = model.scorer()
    texts, labels = _toy(200, 2)
    right = sum((logit(t) >= 0) == bool(y) for t, y in zip(texts, labels, strict=True))
    assert right >= 190
    assert toxicity.train(*_toy(60, 1), steps=20).out.tolist() == toxicity.train(*_toy(60, 1), steps=20).out.tolist()


def test_model_does_not_depend_on_row_order():
    texts = [f"good plain words {i} here" for i in range(12)] + [f"vile nasty words {i} here" for i in range(12)] + ["both labels"] * 2
    labels, langs = [0] * 12 + [1] * 12 + [0, 1], ["en", None] * 13
    a = toxicity.train(texts, labels, langs, steps=5)
    b = toxicity.train(texts[::-1], labels[::-1], langs[::-1], steps=5)
    assert np.array_equal(a.table, b.table) and a.shift == b.shift


def test_classifier_without_a_class():
    assert all(toxicity.train(t, y).constant == 0.0 for t, y in ((["a", "b"], [0, 0]), (["a"], [1]), ([], [])))


def test_long_text_scores_like_its_blocks():
    logit = toxicity.train(*_toy(120, 3), steps=30).scorer()
    t = _toy(4, 4)[0][0]
    assert logit(t + " plain words" * 20_000) >= logit(t) - 1e-3  # a maximum never falls with more text


def test_toxicity_on_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (2, 1), (8, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels)
    scored = toxicity.score(odd_docs, model, "s").collect()
    assert len(scored) == odd_docs.count() and all(0 <= r["s"] <= 1 for r in scored)
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels), "s").count() == 0


def test_query_reads_no_held_out_label(spark, sf, tmp_path):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    flipped.write.parquet(f"{tmp_path}/labels.parquet")
    (tmp_path / "documents.parquet").symlink_to(f"{sf}/documents.parquet")
    columns = ["doc_id", "held_out", "score", "predicted"]
    own = sorted(map(tuple, toxicity.query(spark, sf).select(*columns).collect()))
    assert own == sorted(map(tuple, toxicity.query(spark, str(tmp_path)).select(*columns).collect()))
    assert all(0 <= s <= 1 and p == int(s >= 0.5) and h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h, s, p in own)


def test_sample_takes_an_id_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {i:04d}") for i in range(500)] + [(2, "vile"), (3, "good")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, 0)], "doc_id long, toxic int")
    texts, toxic, _ = toxicity.sample(docs, labels)
    kept = [i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(zip(texts, toxic, strict=True)) == sorted({1: ("text 0000", 1), 2: ("vile", 1), 3: ("good", 0)}[i] for i in kept)
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 4)
    assert len(toxicity.sample(docs, labels)[0]) <= 1


def test_hold_out_rule(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    got = {r[0]: r[1] for r in rows.select("doc_id", toxicity.held_out(rows.doc_id)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_training_apart_gives_the_same_model_and_loads_no_spark():
    import subprocess
    import sys

    texts = [f"word{i % 7} {'vile' if i % 2 else 'kind'} text {i}" for i in range(60)]
    labels = [i % 2 for i in range(60)]
    one, two = toxicity.train(texts, labels), toxicity.train_apart(texts, labels)
    assert one.rows == two.rows and one.shift == two.shift and (one.table == two.table).all() and (one.out == two.out).all()
    code = "import sys; import linkforge.llm.convolution; print('pyspark' in sys.modules or 'pyarrow' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "False"


def test_model_is_trained_where_the_sample_is(spark, sf, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    want = toxicity.train(*toxicity.sample(docs, labels))
    for name in ("sample", "train"):  # neither the texts nor the training come to the driver
        monkeypatch.setattr(toxicity, name, None)
    got = toxicity.fit(docs, labels)
    assert got.rows == want.rows and got.shift == want.shift and got.thresholds == want.thresholds and (got.table == want.table).all() and (got.out == want.out).all()
