"""Personal data and secrets against the plain patterns, on noise that provokes edge cases."""

import hashlib
import random
import re

from kerbside.llm import pii, secrets

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return 13 <= len(d) <= 19 and sum(d[0::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def plain_pii(t):
    n = lambda s: sum(c.isdigit() for c in s)
    out = [("email", m) for m in EMAIL.finditer(t)]
    out += [("ip", m) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in CARD.finditer(t) if luhn(m[0])]
    out += [("phone", m) for m in PHONE.finditer(t) if 9 <= n(m[0]) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def noise():
    rng = random.Random(2)
    atoms = ["a", "b@", "@", ".", "..", "c.d", "_x", "-", " ", "é", "🙂", "1", "22.", "255", "256", "0001.", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 010-9999",
             "+49", "(0)", "\n", "x@y.z", "10.0.0.1", "5500-0055-5555-5559", "9" * 20, "\x01", "+"]
    out = ["".join(rng.choice(atoms) for _ in range(rng.choice([3, 12, 60]))) for _ in range(400)]
    out += ["", "a" * 50000, "1" * 50000, "a.b@" + "c." * 20000 + "d", "7 " * 20000, "x@y.zz " * 900, "+" * 3000, "1." * 9000]
    return out


def test_pii_equals_plain_patterns(spark):
    rows = [(i, t, "k") for i, t in enumerate(noise())] + [(0, None, "k"), (None, "m@n.oo", None), (None, "m@n.oo", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kb_base string").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.base_sha256, r.n_email + r.n_ip + r.n_card + r.n_phone) for r in pii.report(docs).collect())
    want = []
    for d, t, _ in rows:
        p = plain_pii(t or "")
        want.append((d is None, d or 0, hashlib.sha256(p.encode()).hexdigest(), len(p.split(",")) if p else 0))
    assert got == sorted(want)


def test_pii_checksums_and_context(spark):
    texts = ["transfer to bank account GB82 WEST 1234 5698 7654 32 now", "GB83 WEST 1234 5698 7654 32 bank", "social security 123-45-6789", "part 123-45-6789 of it",
             "mail me: a@b.cc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.scores) for r in pii.report(docs).collect()}
    assert got[0][0] == "iban:25:52" and got[1][0] == ""
    assert got[2] == ("ssn:16:27", "0.6") and got[3][0] == ""
    assert got[4] == ("email:9:15", "1.0")


def test_iban_ends_where_its_country_says(spark):
    texts = ["GB82 WEST 1234 5698 7654 32 Please", "DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89370400440532013000 Bank", "NO93 8601 1117 947 2026",
             "FR14 2004 1010 0505 0001 3M02 606, 7", "DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32 EUR", "AB12 GB82 WEST 1234 5698 7654 32 X",
             "GB82 WEST 1234 5698 7654 33 Please", "GB82WEST12345698765432X"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: ",".join(s for s in r.spans.split(",") if s.startswith("iban")) for r in pii.report(docs).collect()}
    assert [got[i] for i in range(len(texts))] == ["iban:0:27", "iban:0:27", "iban:0:22", "iban:0:18", "iban:0:33", "iban:0:27,iban:28:55", "iban:5:32", "", ""]


def test_pii_is_native(spark):
    plan = pii.report(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def plain_secrets(t):
    out = [(m.start(), 0, "assign", m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_secret_base_spans(spark):
    rng = random.Random(4)
    atoms = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "=", "abc", "deadbeef", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "\n", "é",
             "K", "ſecret", "/", "."]
    rows = [(i, "".join(rng.choice(atoms) for _ in range(rng.choice([4, 15, 80])))) for i in range(400)] + [(7, None), (None, "token=abcdefg"), (8, ""), (9, "f" * 40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.kb_base) for r in secrets.scan(docs).collect())
    assert got == sorted((d is None, d or 0, plain_secrets(t or "")) for d, t in rows)
    for r in secrets.scan(docs).collect():
        assert set(filter(None, r.kb_base.split(","))) <= set(r.kb_spans.split(","))


def test_random_strings_and_their_exceptions():
    v = secrets.default_vocabulary()
    hit = lambda t: [t[a:b] for a, b in secrets.random_spans(t, v)]
    assert hit("key is xK9vQ2mZp7Lw4TtR8bNc1Yd3 ok") == ["xK9vQ2mZp7Lw4TtR8bNc1Yd3"]
    for clean in ["d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "internationalization_of_everything", "20240101-20241231-0000",
                  "a perfectly plain sentence with long words such as Donaudampfschiffahrtsgesellschaft"]:
        assert hit(clean) == []


def test_random_letters_are_exposed_and_names_are_not():
    v, rng = secrets.default_vocabulary(), random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keys = ["qXzKvbTRwpLmNcYdGhJsWq", "qXzKvbTRwpLmNcYdGhJsWq12", "qXzKvbTRwp-LmNcYdGhJsWq"]
    assert all(secrets.random_spans(k, v) == [(0, len(k))] for k in keys)
    assert sum(bool(secrets.random_spans("".join(rng.choices(letters, k=20)), v)) for _ in range(500)) > 490
    for name in ["ab_cd_ef_gh_ij_kl_mn_op", "a_b_c_d_e_f_g_h_i_j_k", "MAX_CONCURRENT_REQUESTS_PER_HOST", "getHTTPResponseCodeFromServerXml", "src/main/java/com/example/app",
                 "user_profile_picture_20240101", "kube-system-cluster-role-binding"]:
        assert secrets.random_spans(name, v) == []


def test_redaction_keeps_clean_rows(spark):
    schema = "doc_id long, text string, lang string, n_chars long, kb_x string"
    rows = [(1, "my token = abcdef123456 end", "en", 27, "a"), (2, "clean é text", None, 12, "b"), (3, None, "en", 0, None), (None, "", "en", 0, "c")]
    out = secrets.redact(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "lang", "n_chars", "kb_x"]
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted([(1, "my [SECRET] end", "en", 15, "a"), (2, "clean é text", None, 12, "b"), (3, None, "en", 0, None), (None, "", "en", 0, "c")], key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.report(none).collect() == [] and secrets.scan(none).collect() == []
