"""Pseudonyms against a plain computation of the same permutations."""

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from anamnesis.llm import pii

SECRET = "k"
KEY = f"key:{hashlib.sha256(SECRET.encode()).hexdigest()}"


def noise(tag, turn, half):
    return int(hashlib.sha256(f"{KEY}|{tag}|{turn}|{half}".encode()).hexdigest()[:12], 16)


def feistel(tag, a, b, size_a, size_b):
    for r in range(1, 9):
        if r % 2:
            a = (a + noise(tag, r, b)) % size_a
        else:
            b = (b + noise(tag, r, a)) % size_b
    return a, b


def digits(kind, d):
    n, h = len(d), len(d) // 2
    a, b = feistel(f"{kind}{n}", int("0" + d[:h]), int("0" + d[h:]), 10**h, 10 ** (n - h))
    return (str(a).zfill(h) if h else "") + str(b).zfill(n - h)


def luhn(d):
    twice = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d))]
    return sum(x // 10 + x % 10 for x in twice) % 10 == 0


def card(v):
    d = re.sub(r"\D", "", v)
    if not luhn(d):
        return v
    p = digits("card", d[:-1])
    new = iter(p + next(c for c in "0123456789" if luhn(p + c)))
    return re.sub(r"\d", lambda m: next(new), v)


def day(v):
    first = datetime.date(v.year - v.year % 400, 1, 1)
    a, b = divmod((v - first).days, 773)
    a, b = feistel("date", a, b, 189, 773)
    return first + datetime.timedelta(a * 773 + b)


def email(v):
    local, domain = v.split("@")
    h = len(local) // 2
    halves = [local[:h], local[h:]]
    for r in range(1, 9):
        i = (r + 1) % 2
        part, other = halves[i], halves[1 - i]
        mark = hashlib.sha256(f"{KEY}|email|{r}|{len(part)}|{other}".encode()).hexdigest()
        out = ""
        for k, c in enumerate(part):
            by = int(mark[2 * (k % 32) : 2 * (k % 32) + 2], 16)
            for chars in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
                if c in chars:
                    c = chars[(chars.index(c) + by) % len(chars)]
                    break
            out += c
        halves[i] = out
    return f"{''.join(halves)}@{domain}"


def one(spark, value):
    return spark.createDataFrame([(value,)], "v string").select(pii.pseudonym(KEY, F.col("v"))).first()[0]


def run(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return pii.pseudonym_rows(rows, SECRET).orderBy("doc_id").collect()


@pytest.mark.parametrize("value", ["4785380592391139", "4111-1111-1111-1111", "4111 1111 1111 1111", "378282246310005", "4785380592391138"])
def test_cards(spark, value):
    got = one(spark, value)
    assert got == card(value)
    assert luhn(re.sub(r"\D", "", got)) == luhn(re.sub(r"\D", "", value))


def test_dates_are_a_permutation(spark):
    days = [datetime.date(y, 1, 1) + datetime.timedelta(k) for y in (400, 1200, 1600, 2000, 2800) for k in (0, 1, 773, 81_541, 146_096)]
    assert [one(spark, d.isoformat()) for d in days] == [day(d).isoformat() for d in days]
    every = spark.range(146_097).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("t"))
    assert every.select(pii.pseudonym(KEY, F.col("t")).alias("p")).distinct().count() == 146_097
    d = day(datetime.date(2020, 3, 4))
    assert one(spark, "3/4/2020") == f"{d.month}/{d.day}/{d.year}"
    assert one(spark, "04.03.2020") == f"{d.day:02}.{d.month:02}.{d.year}"
    assert one(spark, "04-03-2020") == f"{d.day:02}-{d.month:02}-{d.year}"
    assert one(spark, "2020/03/04") == d.strftime("%Y/%m/%d") and one(spark, "2020.03.04") == d.strftime("%Y.%m.%d")
    early = day(datetime.date(1700, 1, 1))
    assert one(spark, "1.1.1700") == f"{early.day}.{early.month}.{early.year}" and 1600 <= early.year < 2000
    assert one(spark, "0000-02-03")[:2] in ("00", "01", "02", "03") and one(spark, "9999-12-31")[:2] in ("96", "97", "98", "99")
    assert [one(spark, v) for v in ("2023-02-29", "99/99/2020")] == ["2023-02-29", "99/99/2020"]


def test_other_formats(spark):
    assert one(spark, "97.51.17.173") != "97.51.17.173"
    a, b = feistel("ipv4", 97 * 256 + 51, 17 * 256 + 173, 65536, 65536)
    assert one(spark, "97.51.17.173") == f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    assert one(spark, "256.1.1.1") == "256.1.1.1"
    a, b = feistel("ssn", 122, 44 * 9999 + 6788, 898, 99 * 9999)
    assert one(spark, "123-45-6789") == f"{a + 1 if a < 665 else a + 2:03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"
    assert one(spark, "666-45-6789") == "666-45-6789"
    new = digits("phone", "9745553436")
    assert one(spark, "+1 (974) 555-3436") == f"+1 ({new[:3]}) {new[3:6]}-{new[6:]}"
    assert one(spark, "und.34@mail7.example.com") == email("und.34@mail7.example.com")
    iban = one(spark, "DE89370400440532013000")
    assert iban != "DE89370400440532013000" and int(iban[4:] + "1314" + iban[2:4]) % 97 == 1
    assert one(spark, "DE88370400440532013000") == "DE88370400440532013000"
    assert one(spark, "DE89 3704 0044 0532 0130 00") == " ".join(re.findall(".{1,4}", iban))


def test_texts_and_links(spark):
    texts = [
        None, "", "nothing 12 here", "mail und.34@mail7.example.com, call +1 (974) 555-3436 4111111111111111 4785380592391138.",
        "again und.34@mail7.example.com; 97.51.17.173. Born 2001-02-03", "x" * 100_000 + " 97.51.17.173", "97.51.17.173", "97.51.17.173",
        "tel +33 6 12 34 56 78, +49 30 1234567 and +442079460958; acct DE89 3704 0044 0532 0130 00 9 v 1.2.3 10-11-12 1/2/3",
        "chéen.55@mail4.example.com*** $1 \\1 97.51.17.173$$$",
    ]
    out = run(spark, texts)
    assert [r.n_replaced for r in out] == [0, 0, 0, 3, 3, 1, 1, 1, 4, 2]
    assert [r.text for r in out[:3]] == texts[:3]
    new = email("und.34@mail7.example.com")
    assert new in out[3].text and new in out[4].text and "4785380592391138." in out[3].text
    assert out[6].text == out[7].text == out[5].text[100_001:]
    assert "$1 \\1" in out[9].text and "en.55@" not in out[9].text
    kept = out[8].text
    assert kept.startswith("tel +33 ") and ", +49 " in kept and kept.endswith(" 9 v 1.2.3 10-11-12 1/2/3")


def test_long_and_odd_addresses(spark):
    texts = [f"{'ab.9' * 40}@x.org", "_under.score-1@mail.example.com", "." * 20_000 + " a" * 20_000 + "@", "x" * 900 + "@y.de"]
    out = run(spark, texts)
    assert out[0].text == email(texts[0]) != texts[0] and out[1].text == email(texts[1]) != texts[1]
    assert out[2].text == texts[2] and out[3].text == email(texts[3]) and [r.n_replaced for r in out] == [1, 1, 0, 1]


def test_plans_hide_the_key(spark):
    plan = pii.pseudonym_rows(spark.createDataFrame([(1, "x")], "doc_id long, text string"), SECRET)._jdf.queryExecution()
    assert KEY not in plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))


def test_whole_tables_and_columns(spark):
    rows = spark.createDataFrame([(1, "97.51.17.173", "a", "b")], "doc_id long, text string, x string, y string").toDF("doc_id", "text", "TEXT", "r")
    out = pii.pseudonymise(rows, SECRET)
    assert out.columns == rows.columns and out.toDF("a", "b", "c", "d").first().c == "a"
    assert pii.pseudonymise(rows.limit(0), SECRET).count() == 0
    plan = pii.pseudonymise(rows, SECRET)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_all_personal_data_of_the_table_is_replaced(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r.doc_id: r.text for r in pii.pseudonym_rows(docs, SECRET).collect()}
    patterns = [r"[\w.+-]+@[\w-]+\.[\w.]+\w", r"\+\d \(\d{3}\) \d{3}-\d{4}", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])"]
    seen = 0
    for r in docs.collect():
        for p in patterns:
            for value in re.findall(p, r.text):
                seen += 1
                assert value not in out[r.doc_id]
        for value in re.findall(r"(?<!\w)\d{16}(?!\w)", r.text):
            assert (value in out[r.doc_id]) != luhn(value)  # others are no card numbers
    assert seen
