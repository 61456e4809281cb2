"""Ranked search and nearest names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.text import fold, term_score


def osa_distance(a: str, b: str, most: int) -> int:
    """Edits between two words, swapped neighbours being one; ``most`` + 1 beyond it."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        older, old = old, row
    return min(old[-1], most + 1)


def allowed_edits(term: str) -> int:
    return 2 if len(term) >= 8 else 1 if len(term) >= 4 else 0


def vocabulary(entries: DataFrame, columns: tuple[str, ...] = ("title", "page", "body"), least: int = 3) -> DataFrame:
    """word, pos: words of an index with the place of their first entry."""
    words = F.regexp_extract_all(fold(F.concat_ws(" ", *columns)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return entries.select("pos", F.posexplode(words).alias("at", "word")).where(F.length("word") >= least).groupBy("word").agg(F.min(F.struct("pos", "at")).alias("pos"))


def close_words(words: DataFrame, term: str, most: int = 8) -> DataFrame:
    """The closest words (F03): fewer edits first, a whole word before a start, then the order of the index."""
    edits = allowed_edits(term)
    pair = T.StructType().add("whole", T.IntegerType()).add("start", T.IntegerType())

    @F.pandas_udf(pair)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            rows = [(osa_distance(term, w, edits), osa_distance(term, w[: len(term)], edits) if len(w) > len(term) else edits + 1) for w in column]
            yield pd.DataFrame(rows, columns=["whole", "start"])

    if not edits:
        return words.where("false").select("word", F.lit(0).alias("edits"))
    # Lengths differ by no more than the edits, unless the word only starts with the term.
    near = words.where(F.length("word") >= len(term) - edits).withColumn("d", measure("word")).withColumn("edits", F.least("d.whole", "d.start")).where(F.col("edits") <= edits)
    return near.orderBy("edits", F.col("d.whole") > F.col("edits"), "pos").limit(most).select("word", "edits")


def search(entries: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """pos, score: entries that hold every term or one of its close words, best first by score and place.

    ``entries``: pos, anchor, title, page, body, all folded. ``terms``: a term to the
    words that stand for it; a term of its own stands first and counts in full.
    """
    score: Column = F.when(F.col("anchor").isNull(), 2).otherwise(0)
    everything = F.concat_ws(" ", "title", "page", "body")
    holds = F.lit(True)
    for term, words in terms.items():
        each = [F.when(F.contains(everything, F.lit(w)), term_score("title", "page", "body", w)) for w in words]
        best = F.greatest(*each) if len(each) > 1 else each[0]
        holds = holds & best.isNotNull()
        score = score + (best if words == [term] else F.ceil(best / 2))
    return entries.where(holds).select("pos", score.cast("long").alias("score"))


def first_in_space(found: DataFrame, spaces: dict[str, int], most: int = 24) -> DataFrame:
    """Results of the current space first, then in declared order (F02). The limit is the page's length."""
    rank = F.coalesce(*[F.when(F.col("space") == s, r) for s, r in spaces.items()], F.lit(len(spaces)))
    return found.orderBy(rank, F.desc("score"), "pos").limit(most)


def guess_template(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """The template whose headings a page has most of (F04, F05): page, template, hits.

    ``pages``: page, headings; ``templates``: template, pos, heading. Half of a
    template's headings at least; ties go to the template listed first.
    """
    sizes = templates.groupBy("template").agg(F.count("*").alias("size"), F.min("pos").alias("pos"))
    own = pages.select("page", F.explode(F.array_distinct("headings")).alias("heading"))
    hits = own.join(templates.select("template", "heading").distinct(), "heading").groupBy("page", "template").agg(F.count("*").alias("hits"))
    scored = hits.join(sizes, "template").where(F.col("hits") * 2 >= F.col("size"))
    best = Window.partitionBy("page").orderBy(F.desc(F.col("hits") / F.col("size")), "pos")
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1").select("page", "template", "hits")


def did_you_mean(keys: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """The nearest known name for each unknown key within ``most`` edits (F06): key, suggestion.

    Of ``most`` + 1 pieces of a key, ``most`` edits leave one untouched: a name within
    reach holds that piece, shifted by ``most`` at most, so pieces are the join keys.
    """
    def thirds(c: str) -> Column:
        n = F.length(c)
        cut = F.array(*[F.floor(n * i / (most + 1)).cast("int") for i in range(most + 2)])
        return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.struct(F.get(cut, i).alias("at"), F.substr(F.col(c), F.get(cut, i) + 1, F.get(cut, i + 1) - F.get(cut, i)).alias("piece")))

    left = keys.select("key").distinct().join(known.select(F.col("name").alias("key")), "key", "left_anti")
    a = left.select("key", F.explode(thirds("key")).alias("t")).select("key", F.col("t.at").alias("at"), F.length("t.piece").alias("len"), F.col("t.piece").alias("piece"))
    pieces = a.select("len").distinct().where("len > 0")
    b = known.select("name", "pos").crossJoin(F.broadcast(pieces))
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("name") - F.col("len"))), lambda i: F.struct(i.alias("at2"), F.substr(F.col("name"), i + 1, F.col("len")).alias("piece")))
    b = b.where(F.length("name") >= F.col("len")).select("name", "pos", "len", F.explode(windows).alias("w")).select("name", "pos", F.col("w.at2").alias("at2"), F.col("w.piece").alias("piece"), "len")
    met = a.join(b, ["piece", "len"]).where(F.abs(F.col("at") - F.col("at2")) <= most).select("key", "name", "pos").distinct()
    near = met.withColumn("d", F.levenshtein("key", "name", most)).where("d >= 0")
    best = near.groupBy("key").agg(F.min(F.struct("d", "pos", "name")).alias("m")).select("key", F.col("m.name").alias("suggestion"))
    return left.join(best, "key", "left")
