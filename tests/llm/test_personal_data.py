"""Personal data: base spans against the patterns as they are stated, added spans, odd rows, long texts."""

import random
import re
import time

from pyspark.sql import functions as F

from weft.llm import personal_data as pd_op


def luhn(digits):
    total = 0
    for i, x in enumerate(digits[::-1]):
        d = int(x)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def spans_by_rule(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(pd_op.KINDS[k], s, e) for s, k, e in sorted(found)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(11)
    parts = ["a", "b.c", "@", "@x.y", ".", "..", "-", "+", "%", "_", " ", "(", ")", "1", "23", "255", "256", "007", "4111111111111111", "4111 1111 1111 1111", "+49 170 1234567", "+1", "1.2.3.4", "12.34.", "é", "😀", "x@y", "\n", "٣", ":", "account 12345", "555-0100"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        base, added = pd_op.base_and_rest(text)
        assert base == spans_by_rule(text), text
        taken = sorted((s, e) for _, s, e in added)
        assert all(a[1] <= b[0] for a, b in zip(taken, taken[1:]))
        assert all(e <= s2 or e2 <= s for s, e in taken for _, s2, e2 in base)


def test_added_spans():
    def added(text):
        return [(k, text[s:e]) for k, s, e in pd_op.base_and_rest(text)[1]]

    assert added("schreib an jörg.müller@büro.example heute") == [("mail", "jörg.müller@büro.example")]
    assert added("mail bob [at] example [dot] org now") == [("mail", "bob [at] example [dot] org")]
    assert added("see mailto:bob%40example.org?x") == [("mail", "bob%40example.org")]
    assert added("git clone https://bob:s3cr3t@host.example/x") == []  # the base pattern has that place: s3cr3t@host.example
    assert added("git clone https://bob:s3cr3t@localhost/x") == [("login", "bob:s3cr3t")]
    assert added("call tel:030-1234567 please") == [("tel", "030-1234567")]
    assert added("host 2001:db8::ff00:42:8329, at 12:30:45:00") == [("ip6", "2001:db8::ff00:42:8329")]
    assert added("IBAN: DE89 3704 0044 0532 0130 00 UND MEHR") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert added("IBAN: DE88 3704 0044 0532 0130 00") == []
    assert added("SSN 123-45-6789, ssn: 000-12-3456") == [("identity", "123-45-6789")]
    assert added("Account no. 12345678; accountable 12345678") == [("account", "12345678")]
    assert added("std::vector<a::b> at @name, a + b, 3:4 and ratio 1:2:3:4") == []


def test_odd_rows_and_masks(spark):
    data = [(1, "x a@b.co", 0), (1, "x a@b.co", 1), (None, "+49 170 1234567", 0), (2, None, 0), (3, "", 0), (4, "😀 10.0.0.1", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, id int").withColumn("found", F.lit(1)).withColumn("base", F.lit("z"))
    got = sorted(((r.doc_id, [tuple(x) for x in r.base], [tuple(x) for x in r.all]) for r in pd_op.find_personal_data(df).collect()), key=repr)
    mail, ip, phone = [("email", 2, 8)], [("ip", 2, 10)], [("phone", 0, 15)]
    assert got == sorted([(1, mail, mail), (1, mail, mail), (None, phone, phone), (2, [], []), (3, [], []), (4, ip, ip)], key=repr)
    assert pd_op.find_personal_data(df.where("false")).count() == 0
    masked = {r.m for r in df.select(pd_op.masked(F.col("text")).alias("m")).collect()}
    assert masked == {"x [EMAIL]", "[PHONE]", None, "", "😀 [IP]"}


def test_long_texts_take_linear_time():
    for piece in ("a", "a.", "@", "a@", "1", "1.", "1 ", "+1", "+1 ", "::", "a:", "IBAN ", "account 1", "[at]", "1.2.3.", "a@b", "a@b.", "+1(", "(", "%40", "://a:"):
        text = piece * (400_000 // len(piece))
        began = time.perf_counter()
        pd_op.base_and_rest(text)
        assert time.perf_counter() - began < 10, piece
