"""Joins and lookups between fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import normal_route
from weft.operators.numbering import numbered
from weft.operators.tables import saved, unsent


def hotspots(history: DataFrame, quality: DataFrame) -> DataFrame:
    """file, commits, score: commits times complexity, or lines by 50 where that is unknown."""
    weight = F.coalesce(F.nullif("complexity", F.lit(0)), F.nullif(F.ceil(F.col("lines") / 50), F.lit(0)), F.lit(1))
    return history.join(quality, "file").select("file", "commits", (F.col("commits") * weight).cast("long").alias("score"))


def _grams(text: Column, length: int) -> Column:
    """Every run of ``length`` characters, also where they overlap."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))


def _runs(word: str, most: int) -> Column:
    """Distinct runs of 1 to ``most`` characters of a word."""
    run = lambda size: F.when(F.length(word) >= size, F.transform(F.sequence(F.lit(1), F.length(word) - (size - 1)), lambda i: F.substring(F.col(word), i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[run(size) for size in range(1, most + 1)]))


def covered(items: DataFrame, texts: DataFrame, item_key: str, match: str, text_key: str, text: str, whole: str | None = None, gram: int = 4) -> DataFrame:
    """item, first text that holds one of its spellings, number of such texts; 0 and null for an item without any.

    Case and runs of white space don't count. A spelling may have several words and may
    stand inside a word, unless the column ``whole`` is true for its item. Texts and
    spellings meet through the words of the texts, in one join. A spelling of one part is looked up among the
    distinct words of all texts, by a run of ``gram`` characters: a word that holds it settles every text with that word.
    One of three parts or more holds whole words, of which the one that fewest texts have stands for it; one of two is
    met through its rarer part. What meets so is verified on the whole text, all spellings of a text together. Empty
    spellings, null texts and texts without a key don't count.
    """
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    wanted = items.select(item_key, (F.col(whole) if whole else F.lit(False)).alias("whole"), F.explode(match).alias("m"))
    wanted = saved(wanted.select(item_key, "whole", fold("m").alias("m")).where("m <> ''").distinct().withColumn("parts", F.split("m", " ")))
    own = texts.where(F.col(text_key).isNotNull()).select(text_key, fold(text).alias("t")).where("t <> ''")
    words = saved(own.select(text_key, F.explode(F.array_distinct(F.split("t", " "))).alias("word")))
    vocabulary = saved(words.groupBy("word").agg(F.count("*").alias("n")))
    spellings = wanted.select("m", "parts").distinct()
    inner = spellings.where(F.size("parts") > 2).select("m", F.explode(F.slice("parts", F.lit(2), F.size("parts") - 2)).alias("word"))
    chosen = inner.join(unsent(vocabulary), "word", "left").groupBy("m").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).getField("word").alias("word"))
    # Of two parts, the first ends a word and the last begins one; the part whose words fewer texts have stands for the spelling.
    short = spellings.where(F.size("parts") < 3).select(F.posexplode("parts").alias("at", "needle"), "m", (F.size("parts") == 1).alias("alone"))
    fits = F.when(F.col("alone"), F.contains("word", "needle")).when(F.col("at") == 0, F.endswith("word", "needle")).otherwise(F.startswith("word", "needle"))
    # Tables of spellings grow with the items alone and are saved, so Spark knows their sizes; those of words and texts are never sent.
    needles = saved(short.withColumn("g", F.left("needle", F.lit(gram))))
    runs = vocabulary.select("word", "n", F.explode(_runs("word", gram)).alias("g"))
    held = saved(runs.join(needles, "g").where(fits).select("m", "at", "word", "n", "alone"))
    double = needles.where("NOT alone").select("m", "at").join(held.where("NOT alone").groupBy("m", "at").agg(F.sum("n").alias("n")), ["m", "at"], "left")
    sums = saved(double.groupBy("m").agg(F.min_by("at", F.struct(F.coalesce("n", F.lit(0)), "at")).alias("at")))
    chosen = chosen.unionByName(held.join(sums, ["m", "at"]).where("NOT alone").select("m", "word"))
    edge = r"(?:^|$|[^\p{L}\p{N}])"
    quoted = lambda m: F.concat(F.lit(edge + r"\Q"), F.regexp_replace(m, r"\\E", ""), F.lit(r"\E" + edge))
    # The plain search comes first: only what it finds is worth a pattern of its own.
    holds = lambda t, m, whole: F.when(F.contains(t, m), ~whole | F.regexp_like(t, quoted(m))).otherwise(F.lit(False))
    # The ends of a word are those of a text or white space, so what holds in the word holds in the text.
    alone = held.where("alone").select("m", "word").join(wanted.select("m", "whole").distinct(), "m").where(holds(F.col("word"), F.col("m"), F.col("whole")))
    settled = saved(alone.join(wanted, ["m", "whole"]).groupBy("word").agg(F.array_sort(F.collect_set(item_key)).alias("items")))
    # Many words settle the same items: the least of them stands for all, so that texts needn't carry the items.
    lists = saved(settled.groupBy("items").agg(F.min("word").alias("like")))
    asked = chosen.join(wanted.select("m", "whole").distinct(), "m").groupBy("word").agg(F.collect_set(F.struct("m", "whole")).alias("asked"))
    known = saved(settled.join(unsent(lists), "items").select("word", "like").join(unsent(asked), "word", "full_outer"))
    # Nulls are left out of what is collected: a word settles items, asks for a look at the text, or both.
    gathered = [F.collect_set("like").alias("like"), F.array_distinct(F.flatten(F.collect_list("asked"))).alias("asked")]
    # Dealt by text first: the rows are smaller than sets that are half collected.
    met = saved(words.join(unsent(known), "word").select(text_key, "like", "asked").repartition(F.col(text_key)).groupBy(text_key).agg(*gathered))
    looked = met.where(F.size("asked") > 0).select(text_key, "asked").join(unsent(own), text_key)
    verified = looked.select(text_key, F.explode(F.filter("asked", lambda a: holds(F.col("t"), a["m"], a["whole"]))).alias("a")).select(text_key, "a.m", "a.whole")
    seen = met.select(text_key, F.explode("like").alias("like")).join(lists, "like").select(text_key, F.explode("items").alias(item_key))
    seen = seen.unionByName(verified.join(wanted, ["m", "whole"]).select(text_key, item_key))
    hits = seen.distinct().groupBy(item_key).agg(F.min(text_key).alias("first"), F.count("*").alias("texts"))
    return items.select(item_key).distinct().join(hits, item_key, "left").select(item_key, "first", F.coalesce("texts", F.lit(0)).alias("texts"))


def coverage_totals(report: DataFrame) -> DataFrame:
    """items, covered, share in per cent: the totals of ``covered``'s report."""
    return report.agg(F.count("*").alias("items"), F.count_if(F.col("texts") > 0).alias("covered")).select("items", "covered", F.when(F.col("items") > 0, F.floor(100 * F.col("covered") / F.col("items") + 0.5)).alias("share"))


def route_segments(route: Column | str) -> Column:
    """Segments of a normalised route, parameters as {}."""
    return F.filter(F.split(normal_route(route), "/"), lambda x: x != "")


def routes_called(written: DataFrame, items: DataFrame) -> DataFrame:
    """Items whose last segments equal a written path, each once (C05, C06); a parameter matches anything.

    ``written``: path; ``items``: route and more. The segments that neither side leaves open
    are a key for each pair of patterns of parameters, of which there are few; so both sides meet by equality and
    an item is kept once, however many paths call it.
    """
    wild = lambda c: F.array_join(F.transform(c, lambda x: F.when(x == "{}", "?").otherwise("=")), "")
    paths = written.select(route_segments("path").alias("s")).distinct().withColumn("n", F.size("s")).where("n > 0").withColumn("w", wild(F.col("s")))
    rows = items.withColumn("_r", route_segments("route"))
    tails = rows.select("_r").distinct().where(F.size("_r") > 0).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("_r")))).withColumn("s", F.slice("_r", F.size("_r") - F.col("n") + 1, F.col("n")))
    tails = tails.withColumn("i", wild(F.col("s")))
    # What is fixed on both sides must be equal: that is a key for each pair of patterns of parameters.
    fixed = F.transform("s", lambda x, k: F.when(F.substr("w", k + 1, F.lit(1)).eqNullSafe("=") & F.substr("i", k + 1, F.lit(1)).eqNullSafe("="), x).otherwise(F.lit("{}")))
    called = paths.join(tails.select("n", "i").distinct(), "n").select("w", "i", fixed.alias("key")).distinct()
    found = tails.join(paths.select("n", "w").distinct(), "n").select("_r", "w", "i", fixed.alias("key")).join(called, ["w", "i", "key"], "left_semi").select("_r").distinct()
    return rows.join(found, "_r", "left_semi").select(*items.columns).distinct()


def match_routes(routes: DataFrame, items: DataFrame) -> DataFrame:
    """The first item for each route: one that lists it among its spellings, else one whose id equals it, else null.

    ``routes``: route; ``items``: id, pos, match (array).
    """
    left = routes.select("route").distinct().withColumn("k", normal_route("route"))
    spelled = items.select(F.explode("match").alias("m"), "id", "pos").select(normal_route("m").alias("k"), F.struct(F.lit(0).alias("rule"), "pos", "id").alias("hit"))
    named = items.select(normal_route("id").alias("k"), F.struct(F.lit(1).alias("rule"), "pos", "id").alias("hit"))
    best = spelled.unionByName(named).groupBy("k").agg(F.min("hit").alias("hit"))
    return left.join(best, "k", "left").select("route", F.col("hit.id").alias("id"))


def broken_links(links: DataFrame, pages: DataFrame, anchors: DataFrame) -> DataFrame:
    """page, target, anchor, kind: links to no page, to no anchor of a page, or to themselves."""
    known = links.join(pages.select(F.col("page").alias("target")).distinct(), "target", "left_semi")
    out = links.join(pages.select(F.col("page").alias("target")).distinct(), "target", "left_anti").withColumn("kind", F.lit("page"))
    marks = anchors.select(F.col("page").alias("target"), "anchor").distinct()
    out = out.unionByName(known.where("anchor IS NOT NULL").join(marks, ["target", "anchor"], "left_anti").withColumn("kind", F.lit("anchor")))
    return out.unionByName(links.where("page = target AND anchor IS NULL").withColumn("kind", F.lit("self"))).select("page", "target", "anchor", "kind")


def reconcile(documents: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """key, state: named in the documents and found in the code, or in one of the two (C11)."""
    d, f = documents.select(key).distinct().withColumn("d", F.lit(1)), facts.select(key).distinct().withColumn("f", F.lit(1))
    state = F.when(F.col("d").isNotNull() & F.col("f").isNotNull(), "confirmed").when(F.col("d").isNotNull(), "documents").otherwise("code")
    return d.join(f, key, "full_outer").select(key, state.alias("state"))


def merge_by_key(rows: DataFrame, key: str, fields: tuple[str, ...], lists: tuple[str, ...], order: str = "pos") -> DataFrame:
    """One row for each key: the first row's fields, the union of its lists (C14)."""
    return rows.groupBy(key).agg(*[F.min_by(f, order).alias(f) for f in fields], *[F.array_sort(F.collect_set(x)).alias(x) for x in lists])


def diff(before: DataFrame, after: DataFrame, key: str, watched: tuple[str, ...]) -> DataFrame:
    """key, change (added, removed, changed), field, before, after (C13). Lists are compared as sets, values as text."""
    text = lambda side, f, kind: F.array_join(F.array_sort(F.col(f"{side}.{f}")), ",") if kind.startswith("array") else F.col(f"{side}.{f}").cast("string")
    kinds = dict(after.dtypes)
    both = before.alias("b").join(after.alias("a"), F.col(f"b.{key}") == F.col(f"a.{key}"), "full_outer")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), text("b", f, kinds[f]).alias("before"), text("a", f, kinds[f]).alias("after")) for f in watched])
    changed = F.filter(fields, lambda x: ~x["before"].eqNullSafe(x["after"]))
    gone, new = F.col(f"a.{key}").isNull(), F.col(f"b.{key}").isNull()
    empty = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")))
    rows = both.select(
        F.coalesce(f"b.{key}", f"a.{key}").alias(key),
        F.when(gone, "removed").when(new, "added").otherwise("changed").alias("change"),
        F.explode(F.when(gone | new, empty).otherwise(changed)).alias("c"),
    )
    return rows.select(key, "change", "c.field", "c.before", "c.after")


def suggest_page(ids: DataFrame, covered_ids: DataFrame) -> DataFrame:
    """For each id, the covered one with the most leading segments in common, one at least.

    ``ids``: id; ``covered_ids``: id, page, pos. Every prefix of a covered id keeps its
    first row, so an id meets one row for each of its prefixes.
    """
    def prefixes(c: str) -> Column:
        parts = F.filter(F.split(c, "/"), lambda x: x != "")
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("prefix")))

    heads = covered_ids.select(F.explode(prefixes("id")).alias("p"), "page", "pos").groupBy("p.prefix").agg(F.min_by("page", "pos").alias("page"))
    asked = ids.select("id").distinct().select("id", F.explode(prefixes("id")).alias("p")).select("id", "p.depth", "p.prefix").where("prefix <> ''")
    return asked.join(heads, "prefix").groupBy("id").agg(F.max_by("page", "depth").alias("page"), F.max("depth").alias("common"))


def inventory_changes(reference: DataFrame, inventory: DataFrame, cited: DataFrame) -> DataFrame:
    """id, change: new ids, and removed ones that a page still cites."""
    new = inventory.select("id").distinct().join(reference, "id", "left_anti").withColumn("change", F.lit("new"))
    removed = reference.select("id").distinct().join(inventory, "id", "left_anti").join(cited, "id", "left_semi")
    return new.unionByName(removed.withColumn("change", F.lit("removed")))


def resolve_suffix(paths: DataFrame, files: DataFrame) -> DataFrame:
    """path, file: the file itself, else the single one that ends with it after a slash, else null.

    Files are exploded into their suffixes, whose number is their depth.
    """
    parts = F.split("file", "/")
    suffix = files.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("path"))
    found = suffix.groupBy("path").agg(F.count_distinct("file").alias("n"), F.min("file").alias("one"), F.bool_or(F.col("file") == F.col("path")).alias("exact"))
    resolved = F.when(F.col("exact"), F.col("path")).when(F.col("n") == 1, F.col("one"))
    return paths.select("path").distinct().join(found, "path", "left").select("path", resolved.alias("file"))


def met_by_start(names: DataFrame, patterns: DataFrame, name: str, start: str) -> DataFrame:
    """Distinct names with the patterns that they begin with: every beginning of a name that is as long as some pattern is a key."""
    lengths = patterns.select(F.length(start).alias("k")).distinct().where("k > 0").agg(F.array_sort(F.collect_list("k"))).first()[0]
    long = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda k: k <= F.length(name))
    begun = names.select(name).where(F.length(name) > 0).distinct().select(name, F.explode(long).alias("k")).select(name, F.left(F.col(name), F.col("k")).alias("_start"))
    # Neither side is sent: beginnings are more than the names, and patterns may be many.
    return begun.join(unsent(patterns.withColumn("_start", F.col(start))), "_start").drop("_start")


def met_by_part(names: DataFrame, patterns: DataFrame, name: str, part: str, gram: int = 3) -> DataFrame:
    """Distinct names with the patterns that stand in them, case aside: they meet by runs of up to ``gram`` characters, then whole patterns are looked for."""
    own = names.select(name).distinct()
    found = None
    for size in range(1, gram + 1):
        wanted = patterns.where(F.length(part) >= gram if size == gram else F.length(part) == size).withColumn("_gram", F.left(F.lower(part), F.lit(size)))
        met = own.select(name, F.explode(F.array_distinct(_grams(F.lower(name), size))).alias("_gram")).join(wanted, "_gram").where(F.contains(F.lower(name), F.lower(part))).drop("_gram")
        found = met if found is None else found.unionByName(met)
    return found


def overlapping(ranges: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """Ranges of the same key that touch: key, lo, hi, touches.

    A range of up to 2 ** level numbers lies in at most two cells of that width. Two ranges meet in the cells of the wider
    one's level, by equality on (key, level, cell), and count in the first cell that they share; so a range
    stands for two rows a level however wide it is. Ranges with a null end take no part.
    """
    a, b = (df.select(key, "lo", "hi").where("lo <= hi").distinct().withColumn("own", F.ceil(F.log2(F.col("hi") - F.col("lo") + 1)).cast("int")) for df in (ranges, touched))
    top = a.select("own").unionByName(b.select("own")).agg(F.max("own")).first()[0]
    if top is None:
        return a.select(key, "lo", "hi", F.lit(0).cast("long").alias("touches")).where("false")
    cell = lambda x: F.floor(F.col(x) / F.pow(F.lit(2), F.col("level"))).cast("long")
    cells = lambda df, levels: df.withColumn("level", F.explode(levels)).withColumn("cell", F.explode(F.sequence(cell("lo"), cell("hi"))))
    wide = lambda df: cells(df, F.array("own")).drop("own")
    every = lambda df, more: cells(df, F.when(F.col("own") + more <= top, F.sequence(F.col("own") + more, F.lit(top)))).drop("own")
    other = {"lo": "lo2", "hi": "hi2"}
    met = every(a, 0).join(wide(b).withColumnsRenamed(other), [key, "level", "cell"]).unionByName(wide(a).join(every(b, 1).withColumnsRenamed(other), [key, "level", "cell"]))
    met = met.where("lo <= hi2 AND lo2 <= hi").where(F.col("cell") == F.floor(F.greatest("lo", "lo2") / F.pow(F.lit(2), F.col("level"))))
    return met.groupBy(key, "lo", "hi").agg(F.count("*").alias("touches"))


def erd_tables(tables: DataFrame, references: DataFrame) -> DataFrame:
    """table, columns, degree: references among present tables, counted on both ends (C20)."""
    merged = tables.groupBy("table").agg(F.array_sort(F.collect_set("column")).alias("columns"))
    names = merged.select("table")
    edges = references.select("table", "target").distinct().join(names, "table", "left_semi").join(names.withColumnRenamed("table", "target"), "target", "left_semi")
    ends = edges.select(F.explode(F.array("table", "target")).alias("table")).groupBy("table").agg(F.count("*").alias("degree"))
    return merged.join(ends, "table", "left").select("table", "columns", F.coalesce("degree", F.lit(0)).alias("degree"))


def citations(pages: DataFrame, pattern: str) -> DataFrame:
    """id, pages: who cites each id that the pattern finds."""
    return pages.select("page", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("id")).groupBy("id").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def translated(source: DataFrame, translation: DataFrame, keys: tuple[str, ...], field: str) -> DataFrame:
    """The source's rows with the translated field where there is one."""
    own = translation.select(*keys, F.col(field).alias("other"))
    return source.join(own, list(keys), "left").withColumn(field, F.coalesce("other", field)).drop("other")


def append_new(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates that share no route with an existing row, numbered after the largest number.

    ``existing``: n, routes; ``candidates``: pos, routes.
    """
    taken = existing.select(F.explode("routes").alias("route")).distinct()
    shared = candidates.select("pos", F.explode("routes").alias("route")).join(taken, "route", "left_semi").select("pos").distinct()
    last = existing.agg(F.coalesce(F.max("n"), F.lit(0)).alias("last")).first().last
    fresh = numbered(candidates.join(shared, "pos", "left_anti").select("pos", "routes"), ("pos",), "k")
    return existing.select("n", "routes").unionByName(fresh.select((F.col("k") + last).alias("n"), "routes"))
