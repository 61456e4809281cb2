"""The text that a page shows, with the places of html and text mapped to each other.

A page is cut into tags, comments, words, blanks and references. Lengths before each piece, in html and
in the shown text, are prefix sums, so a place in one is a place in the other through the piece that holds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.pages import decode_references

PIECE = "|".join([r"<!--[^-]*+(?:-(?!->)[^-]*+)*+(?:-->)?", r"<[!?][^>]*+>?", r"</?[a-zA-Z](?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+>?", r"[ \t\n\f\r]++", r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?", r"[^<& \t\n\f\r]++", r"."])
#: Elements inside a line, elements that show nothing, and the attributes whose text is shown.
INLINE = "a abbr b bdi bdo big button cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var"
HIDDEN = "pre template script style textarea"
RAW = "script style textarea"
SHOWN_ATTRIBUTES = "alt|title"


def shown_pieces(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, i, kind, raw, shown, html_at, shown_at of every piece of every page; the two places count from 0.

    kind: text, block (a line end), inline (a break of words without a character) or nothing. Blanks in a row, also
    across inline elements and comments, show one space; references are read. Null pages give no rows.
    """
    cut = pages.where(F.col(html).isNotNull()).select(F.col(key), F.posexplode(F.regexp_extract_all(html, F.lit("(?s)" + PIECE), F.lit(0))).alias("i", "raw"))
    name = F.lower(F.regexp_extract("raw", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    order = Window.partitionBy(key).orderBy("i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    closes = F.startswith("raw", F.lit("</"))
    open_of = lambda names: F.coalesce(F.sum(F.when(name.isin(*names.split()), F.when(closes, -1).when(~F.endswith("raw", F.lit("/>")), 1)).otherwise(0)).over(before), F.lit(0))
    # What looks like a tag inside a script is none.
    inside_raw = (open_of(RAW) > 0) & ~(closes & name.isin(*RAW.split()))
    placed = cut.select("*", F.when(~inside_raw, name).otherwise("").alias("name"), open_of(HIDDEN).alias("depth"), F.coalesce(F.sum(F.length("raw")).over(before), F.lit(0)).alias("html_at"))
    is_tag = F.col("name") != ""
    kind = F.when(is_tag & F.col("name").isin(*INLINE.split()), "inline").when(is_tag, "block").when(F.startswith("raw", F.lit("<!")) | F.startswith("raw", F.lit("<?")) | (F.col("depth") > 0), "nothing").otherwise("text")
    told = placed.withColumn("kind", kind)
    read = F.when(F.startswith("raw", F.lit("&")), decode_references(F.col("raw"))).otherwise(F.col("raw"))
    told = told.withColumn("run", F.when(F.col("kind") == "block", "\n").when(F.col("kind") == "text", F.regexp_replace(read, r"[ \t\n\f\r]+", " ")).otherwise(""))
    last = F.last(F.when(F.col("run") != "", F.right("run", F.lit(1))), True).over(before)
    merged = F.coalesce((F.col("kind") == "text") & F.startswith("run", F.lit(" ")) & (last == " "), F.lit(False))
    told = told.withColumn("shown", F.when(merged, F.substr("run", F.lit(2))).otherwise(F.col("run")))
    return told.select(key, "i", "kind", "raw", "shown", "html_at", F.coalesce(F.sum(F.length("shown")).over(before), F.lit(0)).alias("shown_at"))


def shown_texts(pieces: DataFrame, key: str = "page_id") -> DataFrame:
    """key, text, breaks: the shown text, with the alternative texts and titles of elements on lines of their own after it, and where inline elements begin or end."""
    attribute = F.regexp_extract_all("raw", F.lit(rf"(?i)\s(?:{SHOWN_ATTRIBUTES})\s*=\s*(\"[^\"]*\"|'[^']*')"), F.lit(1))
    tags = pieces.where("kind IN ('inline', 'block')").select(key, "i", F.posexplode(attribute).alias("k", "v"))
    said = tags.select(key, "i", "k", F.regexp_replace(decode_references(F.expr("substring(v, 2, length(v) - 2)")), r"[ \t\n\f\r]+", " ").alias("v"))
    extra = said.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "k", "v"))), lambda x: F.concat(F.lit("\n"), x["v"])), "").alias("extra"))
    texts = pieces.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "shown"))), lambda x: x["shown"]), "").alias("body"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "inline", F.col("shown_at")))).alias("breaks"),
    )
    return texts.join(extra, key, "left").select(key, F.concat("body", F.coalesce("extra", F.lit(""))).alias("text"), "breaks")


def html_places(pieces: DataFrame, places: DataFrame, key: str = "page_id", at: str = "at") -> DataFrame:
    """``places`` (key, at: a place in the shown text) with html_at, the place in the html that shows it; null behind the end.

    Each place takes the last piece that begins at it or before and shows something: both sides are one
    ordered stream for each page. A place inside a reference, or in blanks shown as one, is where they begin.
    """
    none = F.lit(None).cast("long")
    shown = pieces.where(F.length("shown") > 0)
    same = F.col("raw") == F.col("shown")
    marks = shown.select(key, F.col("shown_at").cast("long").alias("p"), F.lit(0).alias("side"), F.struct("shown_at", "html_at", F.length("shown").alias("n"), same.alias("same")).alias("m"), none.alias("asked"))
    asked = places.select(key, at).distinct().select(key, F.col(at).cast("long").alias("p"), F.lit(1).alias("side"), F.lit(None).cast(marks.schema["m"].dataType).alias("m"), F.col(at).cast("long").alias("asked"))
    order = Window.partitionBy(key).orderBy("p", "side").rowsBetween(Window.unboundedPreceding, -1)
    met = marks.unionByName(asked).select(key, "asked", F.last("m", True).over(order).alias("m")).where("asked IS NOT NULL")
    inside = F.col("asked") - F.col("m.shown_at")
    found = F.when((inside >= 0) & (inside < F.col("m.n")), F.col("m.html_at") + F.when(F.col("m.same"), inside).otherwise(0))
    return met.select(key, F.col("asked").alias(at), found.cast("long").alias("html_at"))
