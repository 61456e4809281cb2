"""Fill-in-the-middle by a counted-quantifier pattern of each row.

``regexp_count`` gives the number n of units of a text. The row's own pattern then has
two possessive counted groups, ``(unit{a}+)(unit{b-a}+)``, and takes prefix, middle and
suffix in one match, so a replacement can put them in the order of a form. Everything is a
Column expression; no row meets another.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Any code point; patterns are matched with the flag that lets a dot match line ends.
CODE_POINT = "."
#: Units counted at once, which bounds what a count holds besides the text.
STRIDE = 1024


def count_units(text: Column, unit: str = CODE_POINT) -> Column:
    """How many units ``text`` has, as a long: whole strides first, then the rest one by one."""
    strides = F.regexp_count(text, F.lit(f"(?s)(?:{unit}){{{STRIDE}}}+"))
    rest = F.regexp_replace(text, rf"(?s)\A(?:(?:{unit}){{{STRIDE}}}+)*+", "")
    return strides.cast("long") * STRIDE + F.regexp_count(rest, F.lit(f"(?s){unit}"))


def draws(id_col: str | Column, seed: int = 1, count: int = 4) -> list[Column]:
    """``count`` unsigned 32-bit numbers of an id: the first 8-digit groups of the sha256 of ``seed:id``. A null id reads as an empty one."""
    key = F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(count)]


def _quoted(mark: str) -> str:
    """``mark`` as it stands in a replacement."""
    return re.sub(r"([\\$])", r"\\\1", mark)


def restore_text(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` in ``form`` was made of. Texts of the forms psm and spm hold no mark of their own, so the first of each is the one that was put in."""
    p, s, m = (rf"\Q{x}\E" for x in marks)
    psm = F.regexp_replace(output, rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, unit: str = CODE_POINT, fim_percent: int = 90, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """id, n long, form, prefix_units, middle_units long, output of every row.

    The two cuts are draws modulo n + 1; the smaller one ends the prefix, the larger one the
    middle. A form is plain for texts that are empty or hold a mark, and for all but
    ``fim_percent`` of the draws; of the others ``spm_percent`` put the suffix first.
    ``unit`` is a pattern without groups that matches every part of a text one after the
    other and one or more characters at a time.

    A null text is empty, a null id draws as an empty one, rows that repeat an id draw alike and
    give a row each. Cuts may meet, at the ends too, which leaves parts empty. Other columns
    aren't read, so their names can't clash; an empty table gives no rows. Texts of
    any length are counted in strides and matched once, without recursion.
    """
    h1, h2, h3, h4 = draws(id_col, seed)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), count_units(text, unit).alias("n"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    plain = (F.col("text") == "") | (F.col("h3") % 100 >= fim_percent)
    for mark in marks:
        plain = plain | F.contains("text", F.lit(mark))
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    cut = rows.select("id", "text", "n", form.alias("form"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
    pattern = F.format_string(rf"(?s)\A((?:{unit}){{%d}}+)((?:{unit}){{%d}}+)(.*+)\z".replace("(?:.)", "."), F.col("a"), F.col("b") - F.col("a"))
    p, s, m = map(_quoted, marks)
    order = F.when(F.col("form") == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    made = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace(F.col("text"), pattern, order))
    shown = lambda x: F.when(F.col("form") != "plain", x)
    return cut.select(F.col("id").alias(id_col), "n", "form", shown(F.col("a")).alias("prefix_units"), shown(F.col("b") - F.col("a")).alias("middle_units"), made.alias("output"))
