"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

E-mail addresses, phone, card and social security numbers, bank accounts, addresses of machines, dates, and secrets
(access keys, passwords, tokens) are found by pattern.  Card numbers, bank accounts, social security numbers, dates and
machine addresses must be valid ones; others stay as they are.  A value is replaced by its image under a keyed Feistel
network on its own format: letters stay letters of the same case, digits digits, separators stay, check digits are
made right again, and dates stay dates.  A Feistel network is a permutation, so equal values get equal pseudonyms in
all documents and different ones stay apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Dates from 1900-01-01 to 2099-12-31: 229 * 319 days.
_DAY0, _DAYS = "1900-01-01", (229, 319)

# No group is repeated without a limit: the pattern engine goes one call deeper for each round of such a group.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?=[A-Za-z0-9])[A-Za-z0-9.\-]*\.[A-Za-z]{2,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])"
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api_key|apikey)(?-i) ?[=:] ?[\"']?(?=[^\s\"']*[0-9])(?=[^\s\"']*[A-Za-z])[^\s\"']{6,}"
ISO_DATE = r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])"
OTHER_DATE = r"(?<![\d./])\d{1,2}(?:\.\d{1,2}\.|/\d{1,2}/)\d{4}(?![\d/])(?!\.\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)"
IPV4 = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d)(?!\.\d)"
PHONE = (
    r"(?<![\d+])(?:\+\d{1,3}(?:[ .\-]?\(?\d{2,4}\)?){2,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4})(?!\d)"
)

#: Marks of a value in a text; a text that holds the first character has it doubled up with a nought.
_MARK, _OPEN, _CLOSE = "\x01", "\x01" + "1", "\x01" + "2"


_ORDER = (EMAIL, SECRET, ACCESS_KEY, IBAN, ISO_DATE, SSN, CARD, IPV4, OTHER_DATE, PHONE)
ANY = "|".join(f"(?:{p})" for p in _ORDER)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Work a value out once and use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _stream(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x02", F.lit(key), *[p.cast("string") for p in parts]), 512)


def _shifted(text: Column, stream: Column, sign: int = 1) -> Column:
    """Each letter and digit moved on within its class by the stream; other characters stay."""

    def one(ch: Column, i: Column) -> Column:
        by = F.conv(F.substring(stream, F.pmod(i, F.lit(60)) * 2 + 1, F.lit(4)), 16, 10).cast("int") * sign
        c = F.ascii(ch)

        def within(first: int, size: int) -> Column:
            return F.char(F.lit(first) + F.pmod(c - first + by, F.lit(size)))

        return (
            F.when(ch.rlike("^[0-9]$"), within(48, 10)).when(ch.rlike("^[A-Z]$"), within(65, 26))
            .when(ch.rlike("^[a-z]$"), within(97, 26)).otherwise(ch)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def permuted(text: Column, key: str, kind: str) -> Column:
    """A keyed permutation of texts with the same pattern of classes: Feistel rounds on its two halves."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a")
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(
        F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"), shape.alias("s")
    )

    def step(s: Column, n: Column) -> Column:
        left = F.when(n % 2 == 0, _shifted(s["l"], _stream(key, F.lit(kind), n, s["s"], s["r"]))).otherwise(s["l"])
        right = F.when(n % 2 == 1, _shifted(s["r"], _stream(key, F.lit(kind), n, s["s"], s["l"]))).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"), s["s"].alias("s"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def permuted_number(number: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of the numbers below ``a * b``: Feistel rounds on quotient and remainder."""
    n = number.cast("long")
    start = F.struct(F.floor(n / b).cast("long").alias("l"), F.pmod(n, F.lit(b).cast("long")).alias("r"))

    def drawn(half: Column, i: Column) -> Column:
        return F.conv(F.substring(_stream(key, F.lit(kind), i, half), 1, 14), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, F.pmod(s["l"] + drawn(s["r"], i), F.lit(a).cast("long"))).otherwise(s["l"])
        right = F.when(i % 2 == 1, F.pmod(s["r"] + drawn(s["l"], i), F.lit(b).cast("long"))).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the check; a whole number has a multiple of ten."""

    def one(ch: Column, i: Column) -> Column:
        d = ch.cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda s, x: s + x)


def iban_rest(account: Column) -> Column:
    """Remainder by 97 of an account without spaces; 1 where it is valid."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    value = F.transform(F.split(moved, ""), lambda ch: F.when(ch.rlike("[0-9]"), ch.cast("int")).otherwise(F.ascii(ch) - 55))
    return F.aggregate(value, F.lit(0), lambda s, x: F.pmod(s * F.when(x > 9, 100).otherwise(10) + x, F.lit(97)))


def _card(x: Column, key: str) -> Column:
    """First digit and separators stay; the last digit is the check digit of the rest."""

    def done(body: Column) -> Column:
        short = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(_digits(body), F.lit("0"))), F.lit(10)), F.lit(10))
        return F.concat(body, short.cast("string"))

    middle = F.substring(x, F.lit(2), F.length(x) - 2)
    fresh = _let(F.concat(F.substring(x, 1, 1), permuted(middle, key, "card")), done)
    return F.when(F.pmod(luhn_sum(_digits(x)), F.lit(10)) == 0, fresh).otherwise(x)


def _iban(x: Column, key: str) -> Column:
    """Country and spaces stay; both check digits are those of the new account."""

    def done(rest: Column) -> Column:
        land = F.substring(x, 1, 2)
        check = F.lit(98) - iban_rest(F.concat(land, F.lit("00"), F.regexp_replace(rest, " ", "")))
        return F.concat(land, F.lpad(check.cast("string"), 2, "0"), rest)

    fresh = _let(permuted(F.substring(x, F.lit(5), F.length(x)), key, "iban"), done)
    return F.when(iban_rest(F.regexp_replace(x, " ", "")) == 1, fresh).otherwise(x)


def _ssn(x: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups from 01 and serials from 0001 are valid: 898 * 99 * 9999 numbers."""
    area, group, serial = (F.substring(x, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    number = (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1) * 9999 + serial - 1

    def shown(n: Column) -> Column:
        a = F.floor(n / (99 * 9999))
        return F.concat_ws(
            "-", F.lpad(F.when(a >= 665, a + 2).otherwise(a + 1).cast("string"), 3, "0"),
            F.lpad((F.pmod(F.floor(n / 9999), F.lit(99)) + 1).cast("string"), 2, "0"),
            F.lpad((F.pmod(n, F.lit(9999)) + 1).cast("string"), 4, "0"),
        )

    return F.when(valid, _let(permuted_number(number, 898, 99 * 9999, key, "ssn"), shown)).otherwise(x)


def _ipv4(x: Column, key: str) -> Column:
    parts = F.transform(F.split(x, r"\."), lambda p: p.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 256 + p)

    def shown(n: Column) -> Column:
        return F.concat_ws(".", *[F.pmod(F.floor(n / 256**i), F.lit(256)).cast("string") for i in (3, 2, 1, 0)])

    valid = F.forall(parts, lambda p: p < 256)
    return F.when(valid, _let(permuted_number(number, 1 << 16, 1 << 16, key, "ipv4"), shown)).otherwise(x)


def _moved_day(day: Column, key: str, shown: Callable[[Column], Column], x: Column) -> Column:
    a, b = _DAYS

    def image(d: Column) -> Column:
        n = F.datediff(d, F.lit(_DAY0).cast("date"))
        moved = _let(F.date_add(F.lit(_DAY0).cast("date"), permuted_number(n, a, b, key, "date").cast("int")), shown)
        return F.when((n >= 0) & (n < a * b), moved).otherwise(x)

    return F.coalesce(_let(day, image), x)


def _iso_date(x: Column, key: str) -> Column:
    return _moved_day(F.try_to_date(x, "yyyy-MM-dd"), key, lambda d: F.date_format(d, "yyyy-MM-dd"), x)


def _other_date(x: Column, key: str) -> Column:
    """Day first with points; with strokes month first if that is a date, else day first.  Padding stays as it is."""

    def part(i: int) -> Column:
        return F.regexp_extract(x, r"^(\d{1,2})[./](\d{1,2})[./](\d{4})$", i)

    def of(month: int, day: int) -> Column:
        return F.try_to_date(F.concat_ws("-", part(3), F.lpad(part(month), 2, "0"), F.lpad(part(day), 2, "0")), "yyyy-MM-dd")

    def shown(first: str, second: str) -> Callable[[Column], Column]:
        def make(d: Column) -> Column:
            padded, bare = (F.concat_ws(".", *[F.date_format(d, p) for p in (f, s, "yyyy")]) for f, s in ((first, second), (first[0], second[0])))
            text = F.when(x.rlike(r"^\d{2}[./]\d{2}[./]"), padded).otherwise(bare)
            return F.when(x.contains("."), text).otherwise(F.translate(text, ".", "/"))

        return make

    day_first = _moved_day(of(2, 1), key, shown("dd", "MM"), x)
    month_first = _moved_day(of(1, 2), key, shown("MM", "dd"), x)
    return F.when(x.contains("/") & of(1, 2).isNotNull(), month_first).otherwise(day_first)


def _email(x: Column, key: str) -> Column:
    """The last label of the domain stays."""
    body, top = F.regexp_extract(x, r"^(.*)(\.[A-Za-z]+)$", 1), F.regexp_extract(x, r"^(.*)(\.[A-Za-z]+)$", 2)
    return F.concat(permuted(body, key, "email"), top)


def _after(x: Column, lead: str, key: str, kind: str) -> Column:
    """What comes after ``lead`` is permuted."""
    head = F.regexp_extract(x, lead, 0)
    return F.concat(head, permuted(F.substring(x, F.length(head) + 1, F.length(x)), key, kind))


def _pseudonym(x: Column, key: str) -> Column:
    whole = {p: f"^(?:{p})$" for p in _ORDER}
    return (
        F.when(x.contains("@") & x.rlike(whole[EMAIL]), _email(x, key))
        .when(x.rlike(whole[SECRET]), _after(x, r"^[A-Za-z_]+ ?[=:] ?[\"']?", key, "secret"))
        .when(x.rlike(whole[ACCESS_KEY]), _after(x, "^AKIA", key, "key"))
        .when(x.rlike(whole[IBAN]), _iban(x, key))
        .when(x.rlike(whole[ISO_DATE]), _iso_date(x, key))
        .when(x.rlike(whole[SSN]), _ssn(x, key))
        .when(x.rlike(whole[CARD]), _card(x, key))
        .when(x.rlike(whole[IPV4]), _ipv4(x, key))
        .when(x.rlike(whole[OTHER_DATE]), _other_date(x, key))
        .otherwise(_after(x, r"^(\+\d{1,3}(?=[ .\-(])|)", key, "phone"))
    )


def pseudonymised(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``column`` replaced, and ``n_replaced``, the number of values that changed.

    ``n_chars``, if there, is brought up to date; ``n_replaced`` replaces a column of that name; other columns stay.  A
    NULL text stays NULL with nothing replaced.  No shuffle: a document is worked on where it is.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col(column)
    safe = F.when(text.contains(_MARK), F.replace(text, F.lit(_MARK), F.lit(_MARK + "0"))).otherwise(text)
    parts = F.split(F.regexp_replace(safe, ANY, f"{_OPEN}$0{_CLOSE}"), f"{_MARK}[12]", -1)
    given = docs.drop("n_replaced").withColumn("_parts", parts)
    held = F.size("_parts") > 1
    fresh = F.transform("_parts", lambda x, i: F.when(i % 2 == 1, _pseudonym(x, key)).otherwise(x))
    given = given.withColumn("_new", F.when(held, fresh))
    changed = F.size(F.filter(F.zip_with("_parts", "_new", lambda a, b: a != b), lambda x: x))
    joined = F.array_join("_new", "")
    back = F.when(text.contains(_MARK), F.replace(joined, F.lit(_MARK + "0"), F.lit(_MARK))).otherwise(joined)
    out = given.withColumns({
        "_text": F.when(held, back).otherwise(text), "n_replaced": F.when(held, changed).otherwise(F.lit(0)),
    })
    if "n_chars" in docs.columns:
        length = (F.col("n_chars") + F.length("_text") - F.length(text)).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))
    return out.withColumn(column, F.col("_text")).select(*[c for c in docs.columns if c != "n_replaced"], "n_replaced")
