"""Fill-in-the-middle against a plain computation, its round trip, other units, odd rows."""

import hashlib

from pyspark.sql import functions as F

from weft.llm import fill_middle


def plainly(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in fill_middle.MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, "a", "ab", "😀", "a😀é\n\r\n x" * 7, "$1 \\ \\E \\Q $" * 9, "a<P>b", "<S", "<" * 40, "<M<S<P" * 5, "x" * 1024, "y" * 1023, "😀" * 2049, "word " * 30000, "M>" * 11]


def test_equals_a_plain_computation(spark):
    data = [(i, TEXTS[i % len(TEXTS)]) for i in range(len(TEXTS) * 12)] + [(None, "null id"), (5, "again"), (5, "again"), (-3, "minus")]
    df = spark.createDataFrame(data, "doc_id long, text string").select("*", *[F.lit("c").alias(c) for c in ("id", "n", "a", "b", "form", "h1", "output")])
    made = fill_middle.fill_in_middle(df)
    got = made.withColumn("back", fill_middle.restore_text(F.col("output"), F.col("form"))).collect()
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in got), key=key) == sorted(((d, *plainly(d, t)) for d, t in data), key=key)
    assert sorted((r.doc_id or 0, r.back) for r in got) == sorted((d or 0, t or "") for d, t in data)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.where("false")).count() == 0


def test_words_as_units_and_other_marks(spark):
    text = "  one two  three\nfour " * 300
    marks = ("<$1>", "[\\S]", "{M}")
    df = spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string")
    got = fill_middle.fill_in_middle(df, unit=r"\s*+\S++\s*+", fim_percent=100, marks=marks)
    rows = got.withColumn("back", fill_middle.restore_text(F.col("output"), F.col("form"), marks)).collect()
    assert {r.n for r in rows} == {1200} and {r.back for r in rows} == {text}
    for r in rows:
        head = r.output.split(marks[1])[0].removeprefix(marks[0]) if r.form == "psm" else r.output.split(marks[0])[1].split(marks[2])[0]
        assert len(head.split()) == r.prefix_units
