"""Format-preserving Feistel pseudonyms for personal numbers, dates and mail names.

Everything is DataFrame functions. One pattern finds candidates; each is validated (card numbers by their check
digit, account numbers by their country's length and check digits, IPv4 octets, calendar dates, number areas, phone
lengths) and then permuted among the values of its own
format: the letters and digits of a mail name, the digits of a phone, the 32 bits of an address, the dates that
are written alike, the free places of a card or an account number, whose check digits are set anew. The permutation is a keyed Feistel
network P turned into one cycle, x -> P'(P(x) + 1) with P' undoing P: one to one, and no value is its own
pseudonym. So equal values get equal pseudonyms in every document, different ones differ, and the holder of the
key can undo it (`reverse=True`), exactly. The pass is narrow: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
#: Steps of the walk back to a day that its month has; a step fails with a probability below 0.04.
WALK = 16
#: Characters permuted at once: 26 ** 12 numbers fit a long, and each half fits half of one.
BLOCK = 12
FIRST_YEAR, YEARS = 1900, 200

#: The pattern's alternatives, in order.
EMAIL = r"(?<![\p{L}\p{N}._%+-])(?:[\p{L}\p{N}._%+-]|(?<=\p{L})['’](?=\p{L})){1,64}@(?:[\p{L}\p{N}-]{1,63}\.)+\p{L}{2,24}"
#: The length of each country's international bank account numbers.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban_pattern() -> str:
    """Each country's length exactly, in one piece or in groups of four, so that a word after it is never part of it."""
    whole = []
    for n in sorted(set(IBAN_LENGTHS.values())):
        countries = "|".join(c for c, m in IBAN_LENGTHS.items() if m == n)
        fours, rest = divmod(n - 4, 4)
        whole.append(f"(?:{countries})\\d{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    return f"(?=[A-Z]{{2}}\\d{{2}})(?:{'|'.join(whole)})(?![\\p{{L}}\\p{{N}}])"


OTHERS = (
    _iban_pattern(),
    r"\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)",
    r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    r"\d{4}-\d{2}-\d{2}(?![\d-])",
    r"\d{4}/\d{2}/\d{2}(?![\d/])",
    r"\d{1,2}[./]\d{1,2}[./]\d{4}(?![\d])",
    r"\d{3}-\d{2}-\d{4}(?![\d-])",
    r"\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d\p{L}])",
    r"\d{4}[ -]\d{6}[ -]\d{5}(?![\d\p{L}])",
    r"\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
    r"\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
)
PATTERN = f"{EMAIL}|(?<![\\p{{L}}\\p{{N}}.+])(?:{'|'.join(OTHERS)})"
KINDS = ("email", "ipv4", "phone", "date", "ssn", "card", "iban")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Letters with accents are an alphabet of their own; a pattern of all that is permuted, in lower case and in both.
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
PERMUTED, EITHER_CASE = "a-z0-9à-öø-þ", "A-Za-z0-9À-ÖØ-Þà-öø-þ"


def _let(value: Column, use) -> Column:
    """use(value) with the value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("bigint")


def feistel(x: Column, p: Column, q: Column, key: str, kind: str | Column, reverse: bool = False) -> Column:
    """Keyed permutation of the integers 0 .. p*q - 1 (p and q below 2^31)."""

    def noise(i: Column, half: Column, modulus: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), kind if isinstance(kind, Column) else F.lit(kind), p.cast("string"), q.cast("string"), i.cast("string"), half.cast("string"))
        return F.pmod(F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("bigint"), modulus)

    def forward(s: Column, i: Column) -> Column:
        return F.struct(s.b.alias("a"), F.pmod(s.a + noise(i, s.b, s.p), s.p).alias("b"), s.q.alias("p"), s.p.alias("q"))

    def back(s: Column, i: Column) -> Column:
        return F.struct(F.pmod(s.b - noise(i, s.a, s.q), s.q).alias("a"), s.a.alias("b"), s.q.alias("p"), s.p.alias("q"))

    first = F.struct(F.call_function("div", x, _long(q)).alias("a"), F.pmod(x, q).cast("bigint").alias("b"), _long(p).alias("p"), _long(q).alias("q"))
    order = range(ROUNDS - 1, -1, -1) if reverse else range(ROUNDS)
    end = F.aggregate(F.array(*map(F.lit, order)), first, back if reverse else forward)
    return _let(end, lambda s: s.a * _long(q) + s.b)


def cycle(x: Column, p: Column, q: Column, key: str, kind: str | Column, reverse: bool = False) -> Column:
    """One cycle through the integers 0 .. p*q - 1 (two or more), in the keyed order; no value stays."""
    step = F.lit(-1 if reverse else 1)
    moved = _let(feistel(x, p, q, key, kind), lambda t: F.pmod(t + step, p * q))
    return _let(moved, lambda t: feistel(t, p, q, key, kind, reverse=True))


def _radix(c: Column) -> Column:
    return F.when(c >= "à", _long(len(ACCENTED))).when(c >= "a", _long(26)).otherwise(_long(10))


def _place(c: Column) -> Column:
    return F.when(c >= "à", F.position(c, F.lit(ACCENTED)) - 1).otherwise(F.ascii(c) - F.when(c >= "a", ord("a")).otherwise(ord("0"))).cast("bigint")


def _block(part: Column, key: str, tweak: Column, reverse: bool) -> Column:
    """Up to BLOCK characters a-z, 0-9 and accented, permuted among those of the same classes."""
    chars = F.split(part, "")
    start = F.struct(_long(0).alias("v"), _long(1).alias("p"), _long(1).alias("q"), F.lit(0).alias("i"))

    def read(s: Column, c: Column) -> Column:
        left = s.i < F.ceil(F.length(part) / 2)
        return F.struct((s.v * _radix(c) + _place(c)).alias("v"), F.when(left, s.p * _radix(c)).otherwise(s.p).alias("p"), F.when(left, s.q).otherwise(s.q * _radix(c)).alias("q"), (s.i + 1).alias("i"))

    # one character has halves too: 13 x 2 letters, 15 x 2 accented, 5 x 2 digits
    halves = lambda s: F.when(s.i == 1, F.struct(s.v.alias("v"), F.call_function("div", s.p, _long(2)).alias("p"), _long(2).alias("q"))).otherwise(F.struct(s.v.alias("v"), s.p.alias("p"), s.q.alias("q")))
    number = F.aggregate(chars, start, read, halves)
    done = _let(number, lambda s: cycle(s.v, s.p, s.q, key, tweak, reverse))

    def write(s: Column, c: Column) -> Column:
        digit = F.pmod(s.v, _radix(c)).cast("int")
        shown = F.when(c >= "à", F.substring(F.lit(ACCENTED), digit + 1, F.lit(1))).when(c >= "a", F.substring(F.lit(LETTERS), digit + 1, F.lit(1))).otherwise(digit.cast("string"))
        return F.struct(F.call_function("div", s.v, _radix(c)).alias("v"), F.concat(shown, s.out).alias("out"))

    spell = lambda n: F.aggregate(F.reverse(chars), F.struct(n.alias("v"), F.lit("").alias("out")), write, lambda s: s.out)
    return _let(done, spell)


def permute(text: Column, key: str, kind: str, reverse: bool = False) -> Column:
    """A string over a-z and 0-9, permuted among those with the same classes at the same places.

    Blocks of BLOCK characters in turn; each block's tweak is what comes out before it and what stands after it,
    so every block depends on the whole string, and equal beginnings do not show."""
    count = F.greatest(_long(1), F.ceil(F.length(text) / BLOCK)).cast("int")
    part = lambda i: F.substring(text, i * BLOCK + 1, F.lit(BLOCK))
    after = lambda i: F.substring(text, (i + 1) * BLOCK + 1, F.length(text))
    before = lambda i: F.substring(text, F.lit(1), i * BLOCK)
    tweak = lambda i, done, rest: F.concat_ws(".", F.lit(kind), i.cast("string"), done, rest)
    if reverse:
        step = lambda out, i: F.concat(_block(part(i), key, tweak(i, before(i), out), True), out)
        order = F.sequence(count - 1, F.lit(0), F.lit(-1))
    else:
        step = lambda out, i: F.concat(out, _block(part(i), key, tweak(i, out, after(i)), False))
        order = F.sequence(F.lit(0), count - 1)
    return F.when(F.length(text) == 0, text).otherwise(F.aggregate(order, F.lit(""), step))


def refill(shape: Column, chars: Column) -> Column:
    """`shape` with its letters and digits replaced in turn by `chars`; capitals stay capitals."""

    def put(s: Column, c: Column) -> Column:
        new = F.substring(chars, s.n + 1, F.lit(1))
        cased = F.when(c.rlike("[A-ZÀ-ÖØ-Þ]"), F.upper(new)).otherwise(new)
        kept = ~c.rlike(f"[{EITHER_CASE}]")
        return F.struct(F.concat(s.out, F.when(kept, c).otherwise(cased)).alias("out"), (s.n + F.when(kept, 0).otherwise(1)).alias("n"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), put, lambda s: s.out)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The check sum, the last digit being the check digit."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda s, x: s + x)


def _email(m: Column, key: str, reverse: bool) -> Column:
    """The name's letters and digits are permuted without regard to case; the host stays."""
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    plain = F.regexp_replace(F.lower(name), f"[^{PERMUTED}]", "")
    return F.concat(refill(name, permute(plain, key, "mail", reverse)), F.lit("@"), host)


def _ipv4(m: Column, key: str, reverse: bool) -> Column:
    octets = F.split(m, r"\.")
    number = F.aggregate(F.transform(octets, lambda o: o.cast("bigint")), _long(0), lambda s, x: s * 256 + x)
    done = cycle(number, _long(65536), _long(65536), key, "ipv4", reverse)
    return _let(done, lambda n: F.concat_ws(".", *(F.shiftright(n, k).bitwiseAND(_long(255)).cast("string") for k in (24, 16, 8, 0))))


def _phone(m: Column, key: str, reverse: bool) -> Column:
    """The country code, if one is written, stays."""
    code = F.regexp_extract(m, r"^(\+\d{1,3}(?=[ .(-])|\+\d)", 1)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, refill(rest, permute(_digits(rest), key, "phone", reverse)))


def _card(m: Column, key: str, reverse: bool) -> Column:
    """The first digit (the scheme) stays, the check digit is set anew."""
    d = _digits(m)
    free = permute(F.substring(d, F.lit(2), F.length(d) - 2), key, "card", reverse)
    body = F.concat(F.substring(d, 1, 1), free)
    check = lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    return refill(m, _let(body, check))


def mod97(text: Column) -> Column:
    """The remainder by 97 of digits and lower-case letters in a row, a letter being 10 to 35."""

    def step(r: Column, c: Column) -> Column:
        return F.when(c >= "a", r * 100 + F.ascii(c) - (ord("a") - 10)).otherwise(r * 10 + F.ascii(c) - ord("0")) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban_parts(m: Column) -> tuple[Column, Column, Column]:
    """Country, check digits and the rest, in lower case without spaces."""
    plain = F.lower(F.regexp_replace(m, " ", ""))
    return F.substring(plain, 1, 2), F.substring(plain, 3, 2), F.substring(plain, F.lit(5), F.length(plain))


def _valid_iban(m: Column) -> Column:
    """Check digits below 02 and above 98 are never issued, though 97 may divide."""
    country, check, rest = _iban_parts(m)
    return check.between("02", "98") & (mod97(F.concat(rest, country, check)) == 1)


def _iban(m: Column, key: str, reverse: bool) -> Column:
    """The country stays, the check digits are set anew."""
    country, _, rest = _iban_parts(m)
    check = lambda b: F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
    return refill(m, _let(permute(rest, key, "iban", reverse), lambda b: F.concat(country, check(b), b)))


def _valid_ssn(d: Column) -> Column:
    return ~F.substring(d, 1, 3).isin("000", "666") & (F.substring(d, 1, 1) != "9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def _ssn(m: Column, key: str, reverse: bool) -> Column:
    """Areas 001 to 899 without 666, groups from 01, serials from 0001, counted without gaps."""
    part = lambda a, n: F.substring(m, a, n).cast("bigint")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    done = cycle((area * 99 + part(5, 2) - 1) * 9999 + part(8, 4) - 1, _long(898), _long(99 * 9999), key, "ssn", reverse)

    def write(n: Column) -> Column:
        area = F.call_function("div", n, _long(99 * 9999)) + 1
        whole = (area + F.when(area >= 666, 1).otherwise(0), F.pmod(F.call_function("div", n, _long(9999)), F.lit(99)) + 1, F.pmod(n, F.lit(9999)) + 1)
        return F.concat_ws("-", *(F.lpad(x.cast("string"), k, "0") for x, k in zip(whole, (3, 2, 4), strict=True)))

    return _let(done, write)


DATE = r"^\d{4}([-/])\d{2}\1\d{2}$|^\d{1,2}[./]\d{1,2}[./]\d{4}$"


def _days(year: Column, month: Column) -> Column:
    """Days of a month, for any year and a month of 1 to 12."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _read_date(m: Column) -> Column:
    """struct<y, m, d, order> of a date of the two centuries, else null; a slashed date is month first if it can be."""
    parts = F.split(m, "[-./]")
    number = lambda i: F.get(parts, F.lit(i)).cast("int")

    def of(y: Column, mo: Column, d: Column, order: str) -> Column:
        good = y.between(FIRST_YEAR, FIRST_YEAR + YEARS - 1) & mo.between(1, 12) & d.between(1, _days(y, mo))
        return F.when(good, F.struct(y.alias("y"), mo.alias("m"), d.alias("d"), F.lit(order).alias("order")))

    slashed = F.coalesce(of(number(2), number(0), number(1), "mdy"), of(number(2), number(1), number(0), "dmy"))
    return F.when(m.rlike(r"^\d{4}"), of(number(0), number(1), number(2), "ymd")).when(m.contains("/") & ~m.contains("."), slashed).when(~m.contains("/"), of(number(2), number(1), number(0), "dmy"))


def _date(m: Column, key: str, reverse: bool) -> Column:
    """Permuted among the dates whose month and day are written as wide and read in the same order: months to 9
    and from 10, days to 9, to 12 and from 13. So a date stays linked however it is written."""

    def of(s: Column) -> Column:
        m0, months = F.when(s.m < 10, 1).otherwise(10), F.when(s.m < 10, 9).otherwise(3)
        d0, days = F.when(s.d < 10, 1).when(s.d < 13, 10).otherwise(13), F.when(s.d < 10, 9).when(s.d < 13, 3).otherwise(19)
        tweak = F.concat_ws(".", F.lit("date"), m0.cast("string"), d0.cast("string"))
        x = (((s.y - FIRST_YEAR) * months + s.m - m0) * days + s.d - d0).cast("bigint")
        row = lambda n: F.call_function("div", n, _long(days)).cast("int")
        year = lambda n: F.call_function("div", row(n), months).cast("int") + FIRST_YEAR
        month = lambda n: row(n) % months + m0
        day = lambda n: F.pmod(n, _long(days)).cast("int") + d0
        # a walk along one cycle comes out inside, one to one, and not where it began
        go = lambda n: _let(cycle(n, _long(YEARS * months), _long(days), key, tweak, reverse), lambda n: F.struct(n.alias("n"), (day(n) <= _days(year(n), month(n))).alias("done")))
        n = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(x.alias("n"), F.lit(False).alias("done")), lambda w, _: F.when(w.done, w).otherwise(go(w.n)), lambda w: w.n)
        # as wide as it was written
        parts = F.split(m, "[-./]")
        wide = lambda v, i: F.lpad(v.cast("string"), F.length(F.get(parts, F.lit(i))), F.lit("0"))
        sign = lambda i: F.substring(m, F.length(F.get(parts, F.lit(0))) + 1 + (0 if i == 1 else F.length(F.get(parts, F.lit(1))) + 1), F.lit(1))
        join = lambda a, b, c: F.concat(wide(a, 0), sign(1), wide(b, 1), sign(2), wide(c, 2))
        return _let(n, lambda n: F.when(s.order == "ymd", join(year(n), month(n), day(n))).when(s.order == "mdy", join(month(n), day(n), year(n))).otherwise(join(day(n), month(n), year(n))))

    return _let(_read_date(m), of)


def kind_of(m: Column) -> Column:
    """The kind of a candidate, or null if it is not valid."""
    d = _digits(m)
    n = F.length(d)
    octets = ~F.exists(F.split(m, r"\."), lambda o: F.try_to_number(o, F.lit("999")) > 255)
    return (
        F.when(m.contains("@"), F.when(m.rlike(f"[{EITHER_CASE}].*@") & ~m.rlike(rf"[\p{{L}}\p{{N}}&&[^{EITHER_CASE}]].*@"), "email"))
        .when(m.rlike("^[A-Z]"), F.when(_valid_iban(m), "iban"))
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(octets & ~m.rlike(r"(^|\.)0\d"), "ipv4"))
        .when(m.rlike(DATE), F.when(_read_date(m).isNotNull(), "date"))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(_valid_ssn(d), "ssn"))
        .when(m.rlike(r"^\+|^\(|^\d{3}[.-]\d{3}[.-]\d{4}$"), F.when(n.between(8, 15), "phone"))
        .when(n.between(13, 19), F.when(luhn_sum(d) % 10 == 0, "card"))
    )


def pseudonym(m: Column, kind: Column, key: str, reverse: bool = False) -> Column:
    by_kind = {"email": _email, "ipv4": _ipv4, "phone": _phone, "date": _date, "ssn": _ssn, "card": _card, "iban": _iban}
    out = m
    for name in reversed(KINDS):
        out = F.when(kind == name, by_kind[name](m, key, reverse)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, text_col: str = "text", *, key: str, reverse: bool = False) -> DataFrame:
    """`docs` with its text's valid personal values replaced, and pii_kinds (array of the kinds found, in text
    order) at the end.

    Null texts stay null, with no kinds; empty ones stay empty. What is no valid value stays as it is, and so
    does all other text. Rows are kept, repeated ones too; very long texts are read whole; an empty table gives
    no rows; a column named pii_kinds is replaced. A mail name without a letter or digit, or with letters beyond
    a-z and the accented ones of Western languages (ß, Greek, Cyrillic, ..), an IPv4 octet with a leading zero and a
    date of other centuries are no valid values; a value never begins or, for cards and
    account numbers, ends inside a word. An account number's check digits are those of all countries; what its bank code or
    national check digits would say is not looked at. IPv6 addresses and phone numbers without any sign are no values of
    these formats. `reverse` gives the text back."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() == "pii_kinds" and c != text_col))
    found = fresh([*docs.columns, "pii_kinds"], "_found")
    text = F.col(text_col)
    some = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"({PATTERN})"), 1))
    values = F.transform(some, lambda m: _let(kind_of(m), lambda k: F.struct(k.alias("kind"), pseudonym(m, k, key, reverse).alias("new"))))
    rows = docs.withColumn(found, values)
    gaps = F.split(text, PATTERN)
    joined = F.array_join(F.zip_with(gaps, F.transform(F.col(found), lambda v: v.new), lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    out = F.when(F.size(found) > 0, joined).otherwise(text)
    kinds = F.coalesce(F.filter(F.transform(F.col(found), lambda v: v.kind), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return rows.select(*(out.alias(c) if c == text_col else F.col(c) for c in docs.columns), kinds.alias("pii_kinds"))
