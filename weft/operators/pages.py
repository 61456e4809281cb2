"""Pages and cards: glossary, headings held against templates, rubrics, plain lines, marks, tables of facts."""

from __future__ import annotations

import html
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import text as fx
from weft.operators.filters import answer_state

#: Ends of elements that end a line, and the entities that a line decodes.
LINE_ENDS = r"(?i)(</(?:p|li|h[1-6]|tr|div)>|<br ?/?>)"


#: Patterns that one expression tests.
MOST_TERMS = 500


def glossary_for(glossary: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """Terms whose pattern, case aside, matches any text (B05). ``glossary``: term, pattern.

    Up to MOST_TERMS patterns are tested on one pass over the texts, each
    text giving the terms that it holds. A longer glossary is joined with the distinct texts, pattern by pattern.
    """
    terms = glossary.select("term", "pattern").where("pattern IS NOT NULL")
    listed = terms.limit(MOST_TERMS + 1).collect()
    if len(listed) > MOST_TERMS:
        return texts.select(F.col(text).alias("t")).distinct().join(terms, F.regexp_like("t", F.concat(F.lit("(?iu)"), "pattern"))).select("term").distinct()
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike("(?iu)" + r.pattern), F.lit(r.term)) for r in listed])) if listed else F.array().cast("array<string>")
    return texts.select(F.explode(hits).alias("term")).distinct()


def facts_table(facts: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns named, as cells (B07): lists joined by commas, truth as a mark or a dash, absence empty; a missing column is an error."""
    missing = [c for c in columns if c not in facts.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in facts.schema.fields}

    def cell(c: str) -> Column:
        if isinstance(kinds[c], T.ArrayType):
            return F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")
        return F.when(F.col(c), "✔").otherwise("—") if isinstance(kinds[c], T.BooleanType) else F.col(c).cast("string")

    return facts.select(*[F.coalesce(cell(c), F.lit("")).alias(c) for c in columns])


def card_rubrics(cards: DataFrame, rubrics: DataFrame, key: str = "card", body: str = "body") -> DataFrame:
    """key, rubric, required, value, state: a card's body split at its rubric lines.

    A rubric line is ``**Label**: value`` or ``Label: value``; it collects the lines up to the next one.
    A rubric written twice joins its values. A required rubric that is absent or empty is missing, an optional one has no row. ``rubrics``:
    rubric, label, required; lines meet the labels by equality, case aside. The text before the first rubric line is no rubric's.
    """
    label = F.lower(F.trim(F.regexp_extract("l", r"^\s*(?:\*\*)?([^:*]{1,80}?)(?:\*\*)?\s*:", 1)))
    lines = cards.select(key, F.posexplode(F.split(body, "\r?\n")).alias("at", "l"))
    known = rubrics.groupBy(F.lower("label").alias("label")).agg(F.min("rubric").alias("head"))
    lines = lines.withColumn("label", label).join(known, "label", "left").drop("label")
    carried = lines.withColumn("rubric", F.last("head", ignorenulls=True).over(Window.partitionBy(key).orderBy("at"))).where("rubric IS NOT NULL")
    value = F.when(F.col("head").isNotNull(), F.regexp_replace("l", r"^[^:]*:(?:\*\*)?\s*", "")).otherwise(F.col("l"))
    gathered = carried.groupBy(key, "rubric").agg(F.array_sort(F.collect_list(F.struct("at", value.alias("v")))).alias("vs"))
    values = gathered.select(key, "rubric", F.trim(F.regexp_replace(F.array_join(F.transform("vs", lambda x: x["v"]), "\n"), r"^\s+|\s+$", "")).alias("value"))
    every = cards.select(key).distinct().crossJoin(rubrics.select("rubric", "required"))
    out = every.join(values, [key, "rubric"], "left").withColumn("value", F.coalesce("value", F.lit("")))
    return out.where("required OR value <> ''").select(key, "rubric", "required", "value", answer_state(F.col("value")).alias("state"))


def plain_lines(text: Column | str) -> Column:
    """Lines of an HTML fragment as text, one for each end of a block, empty ones left out (H11); an angle bracket that opens no tag stays."""
    t = F.regexp_replace(F.regexp_replace(fx.col(text), LINE_ENDS, "$1\u0000"), "(?i)(</t[dh]>)", " $1")

    def plain(line: Column) -> Column:
        out = F.regexp_replace(line, "<[A-Za-z/!][^<>]*>", "")
        for entity, char in fx.ENTITIES:
            out = F.replace(out, F.lit(entity), F.lit(char))
        return F.trim(F.regexp_replace(out, r"\s+", " "))

    return F.filter(F.transform(F.split(t, "\u0000"), plain), lambda x: x != "")


@F.pandas_udf(T.StringType())
def decode_references(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Named and numeric character references as the characters they stand for."""
    for texts in batches:
        yield texts.map(html.unescape, na_action="ignore")


def marked(text: Column | str, terms: list[str]) -> Column:
    """Escaped text with every occurrence of a term between mark tags, case aside; ranges that touch are one."""
    t = fx.col(text)
    if not terms:
        return fx.escape_html(t)
    # Marks are set on the text itself, so that a term never meets an entity.
    found = F.regexp_replace(t, "(?i)((?:" + "|".join(rf"\Q{x}\E" for x in sorted(terms, key=len, reverse=True)) + ")+)", "\u0001$1\u0002")
    return F.replace(F.replace(fx.escape_html(found), F.lit("\u0001"), F.lit("<mark>")), F.lit("\u0002"), F.lit("</mark>"))


def comparable(text: Column | str) -> Column:
    """A heading or label without case, accents, kinds of apostrophe and runs of space."""
    return F.regexp_replace(F.translate(fx.fold(text), "’ʼ`", "'''"), r"\s+", " ")


def page_sections(pages: DataFrame, template: DataFrame, key: str = "page", kind: str = "template", titles: str = "headings") -> DataFrame:
    """page, present: places of the template's sections that a heading starts with.

    ``template``: template, at, labels (array), required; a short list, joined by the page's template.
    """
    folded = pages.select(key, kind, F.transform(titles, comparable).alias("hs"))
    sections = template.select(F.col("template").alias(kind), "at", F.transform("labels", comparable).alias("labels"))
    met = folded.join(sections, kind).where(F.exists("labels", lambda label: F.exists("hs", lambda h: F.startswith(h, label))))
    found = met.groupBy(key).agg(F.array_sort(F.collect_set("at")).alias("present"))
    return pages.select(key).join(found, key, "left").select(key, F.coalesce("present", F.array().cast("array<int>")).alias("present"))


def analyse_pages(pages: DataFrame, template: DataFrame, key: str = "page", kind: str = "template", titles: str = "headings", text: str = "text") -> DataFrame:
    """page, known, sections, present, missing, conformant, completeness, words (H35): each page against its template."""
    present = page_sections(pages, template, key, kind, titles)
    whole = template.groupBy(F.col("template").alias(kind)).agg(F.count("*").alias("sections"), F.array_sort(F.collect_list(F.when(F.col("required"), F.struct("at", F.col("labels")[0].alias("label"))))).alias("wanted"))
    rows = pages.select(key, kind, fx.word_count(text).alias("words")).join(whole, kind, "left").join(present.withColumnRenamed("present", "found"), key)
    missing = F.transform(F.filter("wanted", lambda w: ~F.array_contains("found", w["at"])), lambda w: w["label"])
    known = F.col("sections").isNotNull()
    return rows.select(
        key,
        known.alias("known"),
        F.coalesce(F.col("sections"), F.lit(0)).alias("sections"),
        F.size("found").alias("present"),
        F.coalesce(missing, F.array().cast("array<string>")).alias("missing"),
        (known & (F.size(missing) == 0)).alias("conformant"),
        F.when(known, F.size("found") / F.col("sections")).otherwise(0.0).alias("completeness"),
        "words",
    )


def filled(template: Column | str, values: dict[str, Column]) -> Column:
    """{name} replaced by its value; a name without one stays."""
    return reduce(lambda out, item: F.replace(out, F.lit("{" + item[0] + "}"), F.coalesce(item[1].cast("string"), F.lit("{" + item[0] + "}"))), values.items(), fx.col(template))


def plural(n: Column, one: Column, other: Column, language: str = "en") -> Column:
    """The form of a number (H37): French takes the singular below two, English and German for one alone."""
    return F.when((F.abs(n) < 2) if language == "fr" else (n == 1), one).otherwise(other)


def grouped_number(n: Column, language: str = "en") -> Column:
    """A whole number in groups of three (H43): a comma in English, a narrow space in French, a dot in German and Spanish."""
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit({"en": ",", "fr": " "}.get(language, ".")))


def planned_text(pages: DataFrame) -> DataFrame:
    """text: written pages one after the other, drafts left out, in groups of one line each (C04). ``pages``: page, draft, text."""
    return pages.where("NOT draft AND text IS NOT NULL").groupBy("page").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))


def is_edited(recorded: Column, markdown: Column) -> Column:
    """Whether a marked page is no longer the one marked (K04): neither without its last line ends nor as a whole."""
    bare = fx.content_hash(F.regexp_replace(markdown, r"[\r\n]+$", ""))
    return recorded.isNotNull() & (recorded != bare) & (recorded != fx.content_hash(markdown))


def version_behind(reference: DataFrame, written: DataFrame, version: str) -> DataFrame:
    """Written pages that were marked at another version (K05). ``reference``: page, version; ``written``: page."""
    return reference.where(F.col("version") != version).join(written.select("page").distinct(), "page", "left_semi").select("page", "version")
