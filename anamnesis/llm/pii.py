"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

Everything is built from DataFrame functions. One pattern finds candidates, and each is
checked: card numbers by their check digit, IBANs by theirs, IPv4 addresses by their
octets, social security numbers by their ranges, dates by the calendar; phone numbers and
e-mail addresses have the form alone. A valid value is split into two halves, and rounds
of a keyed hash of one half are added to the other, modulo the half's range. So each
value is permuted within its format: equal values get equal pseudonyms in all documents,
different values different ones, and check digits and dates stay valid.

    card      payload digits permuted, check digit recomputed, separators kept
    IBAN      country and letters kept, digits permuted, check digits recomputed
    IPv4      permuted among all addresses
    SSN       permuted among all valid numbers
    date      permuted within its cycle of 400 years (0 to 399, ..., 1600 to 1999, 2000 to 2399, ...);
              year first, or day.month.year, day-month-year, month/day/year (day first if the
              first number is over 12)
    phone     digits after the country code permuted
    e-mail    letters and digits before the @ permuted within their kind, whatever its length;
              domain kept

The secret enters plans as a digest after the word ``key:``; sessions that haven't their own
``spark.sql.redaction.string.regex`` get one that hides such words where plans are shown.

Defined cases: a null text stays null and an empty one empty; texts of any length are taken
whole; of candidates that overlap the one that begins first counts, of those that begin together
the first kind in the order of ``CANDIDATE``; invalid candidates stay as they are; repeated rows
give repeated results; an empty table gives an empty result; other columns stay as they
are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm.common import pick

ROUNDS = 8
#: Days of the Gregorian calendar's full cycle, 189 x 773, and those from the first day of the
#: year 0, which begins one, to 1970.
DAYS_HIGH, DAYS_LOW, DAYS_TO_EPOCH = 189, 773, 719_528

#: A domain has at most 127 labels.
EMAIL = r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9][A-Za-z0-9-]*+(?:\.[A-Za-z0-9-]++){0,126}?\.[A-Za-z]{2,}"
ISO_DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{4}\.\d{2}\.\d{2})(?!\w|[./-]\d)"
OTHER_DATE = r"(?<![\w./-])(?:\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4})(?!\w|[./-]\d)"
IPV4 = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = (
    r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
    r"|(?<![\w+])(?:\+\d{1,3}[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?!\w)"
    r"|(?<![\w+])\+\d{1,3} \d{3} \d{3} \d{4}(?!\w)"
    r"|(?<![\w+])\+\d{1,3}[ .-]\(?\d{1,5}\)?[ .-]\d{5,9}(?!\w)"
    r"|(?<![\w+])\+\d{1,3}[ .-]\(?\d{1,4}\)?(?:[ .-]\d{2,4}){2,4}(?!\w)"
    r"|(?<![\w+])\+\d{8,15}(?!\w)"
)
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)"
CARD = r"(?<!\w)(?:\d{13,19}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4}(?: \d{4}){3}|\d{4}([ -])\d{6}\1\d{5})(?!\w)"
CANDIDATE = "|".join((EMAIL, ISO_DATE, OTHER_DATE, IPV4, SSN, PHONE, IBAN, CARD))
#: What every candidate has.
HINT = r"[0-9@]"


def plan_key(spark: SparkSession, secret: str) -> str:
    """The key that plans hold for a secret, hidden where they are shown."""
    setting = "spark.sql.redaction.string.regex"
    if not spark.conf.get(setting, None):
        spark.conf.set(setting, "key:[0-9a-f]{64}")
    return f"key:{hashlib.sha256(secret.encode()).hexdigest()}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _noise(key: str, tag: Column, turn: Column, half: Column) -> Column:
    """48 keyed bits that depend on the format, the round and the half that stays."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tag, turn.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def feistel(key: str, tag: Column, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """A permutation of the pairs (a, b) with 0 <= a < size_a and 0 <= b < size_b."""

    def turn(s: Column, r: Column) -> Column:
        left = F.struct(F.pmod(s["a"] + _noise(key, tag, r, s["b"]), size_a).alias("a"), s["b"].alias("b"))
        right = F.struct(s["a"].alias("a"), F.pmod(s["b"] + _noise(key, tag, r, s["a"]), size_b).alias("b"))
        return F.when(r % 2 == 1, left).otherwise(right)

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _number(digits: Column) -> Column:
    return F.concat(F.lit("0"), digits).cast("long")


def _power(places: Column) -> Column:
    return F.rpad(F.lit("1"), places + 1, "0").cast("long")


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """Digits for digits of the same number."""
    n = F.length(digits)
    high = F.floor(n / 2).cast("int")
    out = feistel(
        key,
        F.concat(F.lit(kind), n.cast("string")),
        _number(digits.substr(F.lit(1), high)),
        _number(digits.substr(high + 1, n)),
        _power(high),
        _power(n - high),
    )
    return let(out, lambda s: F.concat(F.lpad(s["a"].cast("string"), high, "0"), F.lpad(s["b"].cast("string"), n - high, "0")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _fill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in turn by ``digits``."""

    def step(s: Column, c: Column) -> Column:
        put = F.struct(F.concat(s["out"], digits.substr(s["at"] + 1, F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
        keep = F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))
        return F.when(c.rlike("[0-9]"), put).otherwise(keep)

    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda s: s["out"])


def _card(key: str, value: Column) -> Column:
    def check_digit(payload: Column) -> Column:
        digits = F.array(*(F.lit(str(d)) for d in range(10)))
        return F.get(F.filter(digits, lambda c: F.call_function("luhn_check", F.concat(payload, c))), F.lit(0))

    def change(digits: Column) -> Column:
        payload = permute_digits(key, "card", digits.substr(F.lit(1), F.length(digits) - 1))
        new = let(let(payload, lambda p: F.concat(p, check_digit(p))), lambda d: _fill(value, d))
        return F.when(F.call_function("luhn_check", digits), new).otherwise(value)

    return let(_digits(value), change)


def _mod97(text: Column) -> Column:
    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        number = F.when(digit, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(c.isin("", " "), s).otherwise(F.pmod(s * F.when(digit, 10).otherwise(100) + number, F.lit(97))).cast("long")

    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), step)


def _iban(key: str, value: Column) -> Column:
    country, account = value.substr(1, 2), value.substr(F.lit(5), F.length(value))

    def checked(new: Column) -> Column:
        check = 98 - _mod97(F.concat(new, country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), new)

    valid = _mod97(F.concat(account, value.substr(1, 4))) == 1
    permuted = let(permute_digits(key, "iban", _digits(account)), lambda d: _fill(account, d))
    return F.when(valid & account.rlike("[0-9]"), let(permuted, checked)).otherwise(value)


def _ipv4(key: str, value: Column) -> Column:
    def change(o: Column) -> Column:
        number = [F.get(o, F.lit(i)).cast("long") for i in range(4)]
        half = F.lit(1 << 16)
        out = feistel(key, F.lit("ipv4"), number[0] * 256 + number[1], number[2] * 256 + number[3], half, half)

        def shown(s: Column) -> Column:
            parts = [F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256]
            return F.concat_ws(".", *(p.cast("long").cast("string") for p in parts))

        return F.when(F.forall(o, lambda x: (x.cast("int") < 256) & ((x == "0") | ~x.startswith("0"))), let(out, shown)).otherwise(value)

    return let(F.split(value, r"\."), change)


def _ssn(key: str, value: Column) -> Column:
    """Areas are 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (value.substr(a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    out = feistel(key, F.lit("ssn"), place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))

    def shown(s: Column) -> Column:
        first = F.when(s["a"] >= 665, s["a"] + 2).otherwise(s["a"] + 1)
        parts = [(first, 3), (F.floor(s["b"] / 9999) + 1, 2), (s["b"] % 9999 + 1, 4)]
        return F.concat_ws("-", *(F.lpad(p.cast("long").cast("string"), n, "0") for p, n in parts))

    return F.when(valid, let(out, shown)).otherwise(value)


def _day(key: str, day: Column) -> Column:
    """The pseudonym of a day, in the same cycle of 400 years."""

    def change(number: Column) -> Column:
        cycle = F.lit(DAYS_HIGH * DAYS_LOW)
        inside = F.pmod(number, cycle)
        out = feistel(key, F.lit("date"), F.floor(inside / DAYS_LOW), inside % DAYS_LOW, F.lit(DAYS_HIGH), F.lit(DAYS_LOW))
        return let(out, lambda s: F.date_from_unix_date((number - inside + s["a"] * DAYS_LOW + s["b"] - DAYS_TO_EPOCH).cast("int")))

    return let(F.unix_date(day) + DAYS_TO_EPOCH, change)


def _year(day: Column) -> Column:
    return F.lpad(F.year(day).cast("string"), 4, "0")


def _iso_date(key: str, value: Column) -> Column:
    def shown(new: Column) -> Column:
        parts = [F.lpad(x.cast("string"), 2, "0") for x in (F.month(new), F.day(new))]
        sign = value.substr(5, 1)
        return F.concat(_year(new), sign, parts[0], sign, parts[1])

    return let(F.translate(value, "/.", "--").try_cast("date"), lambda d: F.when(d.isNotNull(), let(_day(key, d), shown)).otherwise(value))


def _other_date(key: str, value: Column) -> Column:
    sign = F.regexp_extract(value, "[./-]", 0)

    def change(p: Column) -> Column:
        one, two, year = (F.get(p, F.lit(i)) for i in range(3))
        day_first = (sign != "/") | (one.cast("int") > 12)
        day, month = F.when(day_first, one).otherwise(two), F.when(day_first, two).otherwise(one)
        iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")
        width = F.when((F.length(one) == 2) & (F.length(two) == 2), 2).otherwise(1)

        def shown(new: Column) -> Column:
            short = [F.when(width == 2, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string")) for x in (F.day(new), F.month(new))]
            first, second = F.when(day_first, short[0]).otherwise(short[1]), F.when(day_first, short[1]).otherwise(short[0])
            return F.concat(first, sign, second, sign, _year(new))

        return let(iso, lambda d: F.when(d.isNotNull(), let(_day(key, d), shown)).otherwise(value))

    return let(F.split(value, "[./-]"), change)


def _phone(key: str, value: Column) -> Column:
    code = F.regexp_extract(value, r"^(\+\d{1,3}(?=[ .(-])|\+\d|)", 1)
    rest = value.substr(F.length(code) + 1, F.length(value))
    return F.concat(code, let(permute_digits(key, "phone", _digits(rest)), lambda d: _fill(rest, d)))


def _email(key: str, value: Column) -> Column:
    local = F.substring_index(value, "@", 1)
    half = F.floor(F.length(local) / 2).cast("int")

    def moved(part: Column, other: Column, turn: Column) -> Column:
        """Each letter or digit moved within its kind, by a keyed hash of the other part."""

        def with_digest(digest: Column) -> Column:
            def one(c: Column, i: Column) -> Column:
                by = F.conv(digest.substr((2 * (i % 32) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
                code = F.ascii(c)
                cases = [("[0-9]", 48, 10), ("[a-z]", 97, 26), ("[A-Z]", 65, 26)]
                out = c
                for kind, first, size in cases:
                    out = F.when(c.rlike(kind), F.char(F.pmod(code - first + by, F.lit(size)) + first)).otherwise(out)
                return out

            return F.array_join(F.transform(F.split(part, ""), one), "")

        return let(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), turn.cast("string"), F.length(part).cast("string"), other), 256), with_digest)

    def turn(s: Column, r: Column) -> Column:
        left = F.struct(moved(s["a"], s["b"], r).alias("a"), s["b"].alias("b"))
        right = F.struct(s["a"].alias("a"), moved(s["b"], s["a"], r).alias("b"))
        return F.when(r % 2 == 1, left).otherwise(right)

    start = F.struct(local.substr(F.lit(1), half).alias("a"), local.substr(half + 1, F.length(local)).alias("b"))
    domain = value.substr(F.length(local) + 1, F.length(value))
    return F.concat(
        F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"])), domain
    )


def pseudonym(key: str, value: Column) -> Column:
    """The pseudonym of a candidate; an invalid one is returned as it is."""
    return (
        F.when(value.contains("@"), _email(key, value))
        .when(value.rlike(r"^[+(]"), _phone(key, value))
        .when(value.rlike(r"^\d{4}[./-]\d{2}[./-]\d{2}$"), _iso_date(key, value))
        .when(value.rlike(r"^\d{1,2}[./-]\d{1,2}[./-]\d{4}$"), _other_date(key, value))
        .when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), _ipv4(key, value))
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(key, value))
        .when(value.rlike(r"^\d{3}[.-]\d{3}[.-]\d{4}$"), _phone(key, value))
        .when(value.rlike(r"^[A-Z]"), _iban(key, value))
        .otherwise(_card(key, value))
    )


def pseudonymised(key: str, text: Column) -> Column:
    """A struct of ``text`` with pseudonyms in place, and ``n``, how many values were replaced."""

    def rebuilt(found: Column) -> Column:
        def joined(new: Column) -> Column:
            between = F.split(text, CANDIDATE, -1)
            both = F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
            changed = F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x)
            return F.struct(F.array_join(both, "").alias("text"), F.size(changed).cast("long").alias("n"))

        return let(F.transform(found, lambda v: pseudonym(key, v)), joined)

    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    same = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    return F.when(text.rlike(HINT), let(found, rebuilt)).otherwise(same)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text column's personal data replaced by pseudonyms."""
    at, key = docs.columns.index(text_col), plan_key(docs.sparkSession, key)
    places = [f"_c{i}" for i in range(len(docs.columns))]
    out = docs.toDF(*places).withColumn(places[at], pseudonymised(key, F.col(places[at]))["text"])
    return out.toDF(*docs.columns)


def pseudonym_rows(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, the new ``text`` and ``n_replaced``."""
    rows, key = pick(docs, id_col, text_col).toDF("id", "text"), plan_key(docs.sparkSession, key)
    out = rows.select(F.col("id").alias(id_col), pseudonymised(key, F.col("text")).alias("r"))
    return out.select(id_col, F.col("r.text").alias("text"), F.col("r.n").alias("n_replaced"))
