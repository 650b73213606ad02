"""Pseudonyms against an independent Feistel in plain Python, and the values that must stay apart."""

import datetime
import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from tidemark.llm import pii


def noise(key, kind, p, q, i, half, m):
    return int(hashlib.sha256(f"{key}|{kind}|{p}|{q}|{i}|{half}".encode()).hexdigest()[:15], 16) % m


def feistel(x, p, q, key, kind):
    (a, b), sizes = divmod(x, q), (p, q)
    for i in range(8):
        m = sizes[i % 2]
        a, b = b, (a + noise(key, kind, p, q, i, b, m)) % m
    return a * q + b


def unfeistel(x, p, q, key, kind):
    (a, b), sizes = divmod(x, q), (p, q)
    for i in reversed(range(8)):
        m = sizes[i % 2]
        a, b = (b - noise(key, kind, p, q, i, a, m)) % m, a
    return a * q + b


def cycle(x, p, q, key, kind):
    return unfeistel((feistel(x, p, q, key, kind) + 1) % (p * q), p, q, key, kind)


def permute(text, key, kind):
    out = ""
    for i in range(0, -(-len(text) // 12)):
        part, rest = text[12 * i : 12 * i + 12], text[12 * i + 12 :]
        radix = [26 if c.isalpha() else 10 for c in part]
        v = 0
        for c, r in zip(part, radix):
            v = v * r + (ord(c) - 97 if c.isalpha() else int(c))
        p = q = 1
        for k, r in enumerate(radix):
            if 2 * k < len(part):
                p *= r
            else:
                q *= r
        if len(part) == 1:
            p, q = p // 2, 2
        v, new = cycle(v, p, q, key, f"{kind}.{i}.{out}.{rest}"), ""
        for c, r in zip(reversed(part), reversed(radix)):
            v, d = divmod(v, r)
            new = (string.ascii_lowercase[d] if r == 26 else str(d)) + new
        out += new
    return out


def test_permutation_equals_plain_python(spark):
    r = random.Random(1)
    values = ["".join(r.choice("abcxyz0129") for _ in range(n)) for n in range(1, 66)] + list(string.ascii_lowercase + string.digits)
    values += [f"a{i:02}" for i in range(100)] + [f"{'x' * 14}{i}" for i in range(10)]
    d = spark.createDataFrame([(v,) for v in values], "v string").withColumn("n", pii.permute(F.col("v"), "k", "mail"))
    got = d.withColumn("b", pii.permute(F.col("n"), "k", "mail", True)).collect()
    for x in got:
        assert x.b == x.v and x.n == permute(x.v, "k", "mail") and x.n != x.v
        assert [c.isalpha() for c in x.n] == [c.isalpha() for c in x.v]
    assert len({x.n for x in got}) == len(set(values))
    alike = {x.n[:12] for x in got if x.v.startswith("x" * 14)}
    assert len(alike) == 10  # equal beginnings do not show


def test_written_dates_are_one_to_one(spark):
    """Every day of two years in every form, and ten thousand others."""
    r = random.Random(2)
    first = datetime.date(1900, 1, 1)
    days = [first + datetime.timedelta(i) for i in [*range(366), *range(36_000, 36_400), *(r.randrange(73_049) for _ in range(1500))]]
    forms = set()
    for x in days:
        y, m, d = x.year, x.month, x.day
        forms |= {f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{d}.{m}.{y}", f"{m:02}/{d:02}/{y}", f"{m}/{d}/{y}", f"{d:02}/{m:02}/{y}", f"{d}/{m}/{y}", f"{m:02}/{d}/{y}"}
    docs = spark.createDataFrame([(v, v) for v in sorted(forms)], "text string, old string").repartition(4)
    out = pii.pseudonymise(docs, key="k")
    back = pii.pseudonymise(out.withColumn("new", F.col("text")).drop("pii_kinds"), key="k", reverse=True).collect()
    assert len({x.new for x in back}) == len(forms) == len(back)
    for x in back:
        assert x.text == x.old and x.new != x.old and re.sub(r"\d", "9", x.new) == re.sub(r"\d", "9", x.old)
    # a day stays linked however it is written
    new = {x.old: x.new for x in back}
    y, m, d = (int(v) for v in new["1900-01-13"].split("-"))
    assert [new[k] for k in ("13.01.1900", "1/13/1900", "13/01/1900")] == [f"{d:02}.{m:02}.{y}", f"{m}/{d}/{y}", f"{d:02}/{m:02}/{y}"]


def test_every_valid_value_changes_and_none_meet(spark):
    names = [*string.ascii_letters, *string.digits, "j5", "A1", "A.B", "12345678901234567890", "12345678901234567899", "1" * 64, "1" * 63 + "2", "first.last", "First.Last"]
    values = [f"{n}@x.org" for n in names] + [f"10.0.{i}.{j}" for i in range(20) for j in range(20)]
    values += [f"{a:03}-{g:02}-{s:04}" for a in (1, 665, 667, 899) for g in (1, 99) for s in (1, 9999)] + [f"(212) 555-{i:04}" for i in range(200)] + [f"+49 30 12345{i:02}" for i in range(100)]
    docs = spark.createDataFrame([(f"see {v} now", v) for v in values], "text string, old string")
    out = pii.pseudonymise(docs, key="k")
    back = pii.pseudonymise(out.withColumn("new", F.col("text")), key="k", reverse=True).collect()
    assert all(x.text == f"see {x.old} now" and x.new != x.text and len(x.pii_kinds) == 1 for x in back)
    assert len({x.new for x in back}) == len(values)
    new = {x.old: x.new for x in back}
    assert new["first.last@x.org"] == new["First.Last@x.org"].lower()  # linked whatever the case
    odd = spark.createDataFrame([("_.@x.org",), ("010.0.0.1",), ("1899-12-31",), ("30/02/2020",), ("000-12-3456",), ("4111111111111112",)], "text string")
    assert [(x.text, x.pii_kinds) for x in pii.pseudonymise(odd, key="k").collect()] == [(x.text, []) for x in odd.collect()]
    other = pii.pseudonymise(docs, key="another").collect()
    assert sum(x.text == new[x.old] for x in other) < 10  # by chance, among single characters


def test_names_are_never_changed_in_part(spark):
    """Accented names, apostrophes, dates with slashes; values inside words and names of other alphabets stay."""
    texts = ["ünal.müller@x.org", "o'neil@x.org", "JOSÉ.é@x.org é@y.fr", "born 2020/01/05.", "5555555555554444x 5555555555554444", "straße@x.org ιω@x.gr", "2020/13/05", "naïve2020-01-05"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = pii.pseudonymise(d, "t", key="k")
    got = {r.i: (r.t, list(r.pii_kinds)) for r in out.collect()}
    name = got[0][0].split("@")[0]
    assert got[0][1] == ["email"] and re.fullmatch("[à-þ][a-z]{3}\\.[a-z][à-þ][a-z]{4}", name) and name != "ünal.müller"
    assert got[1][1] == ["email"] and re.fullmatch("[a-z]'[a-z]{4}@x\\.org", got[1][0]) and not got[1][0].startswith("o'neil")
    assert got[2][1] == ["email", "email"] and re.fullmatch("[A-Z]{3}[À-Þ]\\.[à-þ]@x\\.org [à-þ]@y\\.fr", got[2][0]) and " é@" not in got[2][0]
    assert got[3][1] == ["date"] and re.fullmatch("born \\d{4}/0[1-9]/0[1-9]\\.", got[3][0]) and "2020/01/05" not in got[3][0]
    assert got[4][1] == ["card"] and got[4][0].startswith("5555555555554444x 5") and not got[4][0].endswith("5555555555554444")
    assert got[5] == (texts[5], []) and got[6] == (texts[6], []) and got[7] == (texts[7], [])
    back = pii.pseudonymise(out.select("i", "t"), "t", key="k", reverse=True)
    assert {r.i: r.t for r in back.collect()} == dict(enumerate(texts))


def test_account_numbers_keep_country_shape_and_check_digits(spark):
    """Against plain Python: whole numbers and groups of four are linked, wrong ones stay, words after one stay."""
    number = lambda text: int("".join(str(int(c, 36)) for c in text))

    def expected(iban):
        rest = permute(iban[4:].lower(), "k", "iban").upper()
        return f"{iban[:2]}{98 - number(rest + iban[:2] + '00') % 97:02}{rest}"

    known = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606", "BE68539007547034", "NL91ABNA0417164300", "NO9386011117947", "MT84MALT011000012345MTLCAST001S"]
    r = random.Random(4)
    for country, n in pii.IBAN_LENGTHS.items():
        rest = "".join(r.choice(string.digits + "ABC") for _ in range(n - 4))
        known.append(f"{country}{98 - number(rest + country + '00') % 97:02}{rest}")
    grouped = lambda v: " ".join(v[i : i + 4] for i in range(0, len(v), 4))
    rows = [(f"pay {v} AND go, {grouped(v)} MORE", v) for v in known]
    d = spark.createDataFrame(rows, "text string, old string")
    out = pii.pseudonymise(d, key="k")
    for x in out.collect():
        new = expected(x.old)
        assert x.text == f"pay {new} AND go, {grouped(new)} MORE" and x.pii_kinds == ["iban"] * 2
        assert number(new[4:] + new[:4]) % 97 == 1 and new != x.old and [c.isalpha() for c in new[4:]] == [c.isalpha() for c in x.old[4:]]
    assert {(x.text, x.old) for x in pii.pseudonymise(out, key="k", reverse=True).collect()} == set(rows)
    wrong = ["DE88370400440532013000", "ZZ68539007547034", "BE685390075470341", "xBE68539007547034", "BE68 5390 0754 703", "be68539007547034"]
    odd = spark.createDataFrame([(v,) for v in wrong], "text string")
    assert [(x.text, x.pii_kinds) for x in pii.pseudonymise(odd, key="k").collect()] == [(v, []) for v in wrong]
