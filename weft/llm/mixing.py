"""Mixing sources to target weights by temperature.

The token shares of the sources are raised to an exponent and normalised. The
exponent is found by repeated section of its bracket, so that the mix reaches a
target entropy and no source is repeated beyond a limit. The weights are realised as
block permutations: the documents of a source are dealt to blocks of a few tokens, each
pass over the source is a permutation of its blocks of its own, and passes end where the
source's share of the budget does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.shared import stash

#: Exponents that one job tries: a round divides the bracket by one more.
SECTIONS = 16
ROUNDS = 6


@dataclass(frozen=True)
class Mix:
    """Weight of a source: share ** exponent / scale. budget counts tokens."""

    exponent: float
    scale: float
    budget: float
    total: float


def token_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def fit_mix(totals: DataFrame, target_entropy: float | None, max_epochs: float | None, budget: float | None, cover: bool) -> Mix:
    """The smallest exponent between 0 and 1 that meets the repetition limit and isn't flatter than the target entropy asks.

    ``totals`` has share (double, positive) for each source and tokens. Only sums and
    extremes over the sources reach the driver.
    """
    count, total, low, high = totals.agg(F.count("*"), F.sum("tokens"), F.min("share"), F.max("share")).first()
    if not count:
        return Mix(1.0, 1.0, 0.0, 0.0)

    def measured(exponents: list[float]) -> list[tuple[float, float, float]]:
        """(scale, entropy as a part of the largest, repetitions of the smallest source) for each exponent."""
        power = lambda x: F.pow("share", F.lit(x))
        sums = totals.agg(*[c for x in exponents for c in (F.sum(power(x)), F.sum(power(x) * F.log("share")))]).first()
        found = []
        for i, x in enumerate(exponents):
            scale, logs = sums[2 * i], sums[2 * i + 1]
            entropy = (math.log(scale) - x * logs / scale) / math.log(count) if count > 1 else 1.0
            size = budget_of(x, scale)
            found.append((scale, entropy, size / total * low ** (x - 1) / scale))
        return found

    def budget_of(exponent: float, scale: float) -> float:
        return total * high ** (1 - exponent) * scale if cover else float(total if budget is None else budget)

    def fits(measure: tuple[float, float, float]) -> bool:
        """Both fall as the exponent grows: flat enough no longer, repeated too often no more."""
        _, entropy, epochs = measure
        return (max_epochs is None or epochs <= max_epochs) and (target_entropy is None or entropy <= target_entropy)

    below, above = 0.0, 1.0
    if fits(measured([0.0])[0]):
        above = 0.0
    for _ in range(ROUNDS if above else 0):
        step = (above - below) / (SECTIONS + 1)
        tried = [below + step * (i + 1) for i in range(SECTIONS)]
        ok = [fits(m) for m in measured(tried)]
        first = ok.index(True) if True in ok else SECTIONS
        below, above = (tried[first - 1] if first else below), (tried[first] if first < SECTIONS else above)
    scale = measured([above])[0][0]
    return Mix(above, scale, budget_of(above, scale), float(total))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float | None = 0.98,
    max_epochs: float | None = 4.0,
    budget: float | None = None,
    cover: bool = False,
    block_tokens: int = 200_000,
    mix_blocks: int = 64,
    seed: int = 17,
) -> DataFrame:
    """One row for each row of ``docs``: id, source, n_tokens long, weight double, copies int, mix_blocks array<int>.

    ``target_entropy`` is a part of the largest entropy, which equal weights have.
    ``max_epochs`` bounds how often a source is passed; where both can't be met the
    limit on repetition wins. ``budget`` counts tokens (those of ``docs`` where it is
    None); with ``cover`` it is the smallest one that takes every document once. Each
    copy goes to one of ``mix_blocks`` blocks of the mix, all of which hold the sources
    in proportion.

    A source's last pass stops at the first document that its share has no room for.
    Documents without words, null texts included, cost nothing and have one copy. A null
    source is a source of its own, null ids are kept, repeated rows are documents of
    their own. Columns besides the three aren't read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), token_count(F.col(text_col)).alias("n_tokens"), F.xxhash64(text_col).alias("salt"))
    rows = stash(rows.withColumn("s", source_key(F.col("source"))), "lengths")
    tokens = rows.groupBy("s").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    tokens = stash(tokens, "tokens")
    total = tokens.agg(F.sum("tokens")).first()[0]
    totals = stash(tokens.withColumn("share", F.col("tokens") / F.lit(float(total or 1))), "totals")
    mix = fit_mix(totals, target_entropy, max_epochs, budget, cover)
    weight = F.pow("share", F.lit(mix.exponent)) / mix.scale
    quota = totals.withColumn("weight", weight).withColumn("quota", F.round(F.col("weight") * mix.budget, 6))
    # A quota that is a whole number of passes but for rounding takes just those.
    quota = quota.withColumn("passes", F.floor(F.col("quota") / F.col("tokens") + 1e-9).cast("int")).withColumn("rest", F.greatest(F.lit(0.0), F.col("quota") - F.col("passes") * F.col("tokens")))
    quota = stash(quota.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("int")), "quota")

    order = lambda *x: F.xxhash64(F.lit(seed), *x)
    dealt = rows.where("n_tokens > 0").join(quota, "s").withColumn("block", F.pmod(order("id", "salt"), F.col("blocks")).cast("int"))
    dealt = stash(dealt.select("id", "source", "s", "salt", "n_tokens", "block", "weight", "passes", "rest", "quota", "tokens"), "dealt")
    # Every pass has an order of a source's blocks of its own; starts holds the tokens before a block in each pass.
    blocks = dealt.groupBy("s", "block").agg(F.sum("n_tokens").alias("held"), F.first("passes").alias("passes"))
    turns = blocks.select("s", "block", "held", F.explode(F.sequence(F.lit(0), "passes")).alias("turn"))
    before = Window.partitionBy("s", "turn").orderBy(order("s", "block", "turn"), "block").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0)))
    blocks = stash(turns.groupBy("s", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "start"))).getField("start").alias("starts")), "blocks")
    placed = dealt.join(blocks, ["s", "block"])
    inside = Window.partitionBy("s", "block").orderBy(order("id", "salt", "block"), "id").rowsBetween(Window.unboundedPreceding, 0)
    # How far into its block a document ends; the last pass takes it where it also ends within what is left of the share.
    placed = placed.withColumn("end", F.sum("n_tokens").over(inside))
    copies = F.col("passes") + F.when(F.element_at("starts", -1) + F.col("end") <= F.col("rest") + 1e-6, 1).otherwise(0)
    at = lambda i: F.least(F.lit(mix_blocks - 1), F.floor((i * F.col("tokens") + F.get("starts", i) + F.col("end") - F.col("n_tokens")) / F.col("quota") * mix_blocks).cast("int"))
    mixed = placed.withColumn("copies", copies.cast("int")).withColumn(
        "mix_blocks", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), at)).otherwise(F.array().cast("array<int>"))
    )
    free = rows.where("n_tokens = 0").join(quota.select("s", "weight"), "s", "left")
    free = free.select("id", "source", "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.lit(1).alias("copies"), F.array(F.pmod(order("id"), F.lit(mix_blocks)).cast("int")).alias("mix_blocks"), "salt")
    both = mixed.select("id", "source", "n_tokens", "weight", "copies", "mix_blocks", "salt").unionByName(free)
    return both.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "n_tokens", "weight", "copies", "mix_blocks", F.col("salt").alias("text_hash"))


def repeat_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` has copies of it, with all their columns.

    Rows that share id and text share their copies: each is taken as often as all of them together divided by their number, rounded up.
    """
    hashed = lambda c: F.xxhash64(F.col(c).cast("string"))
    counts = mixed.groupBy(hashed(id_col).alias("id_hash"), "text_hash").agg(F.ceil(F.avg("copies")).cast("int").alias("copies"))
    # The columns of docs are kept as one, so that none of them clashes with the names used here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), hashed(id_col).alias("id_hash"), F.xxhash64(text_col).alias("text_hash"))
    taken = rows.join(counts, ["id_hash", "text_hash"]).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("n"))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
