"""Repair of conversations: the cheapest edits that give ``(system? (user assistant)+)?``, and of those the least audit.

Every row of a conversation is a layer of an automaton of four states. Blocks of rows are
solved on their own: a cost DP runs backwards through a block, the arcs that keep its
costs are the optimal ones, and prefix doubling ranks their nodes by audits of 1, 2, 4 …
edits, with a pointer over as many. The ranks choose each node's arc, the doubled
pointers mark the nodes of the least path. What a block needs from its neighbours (costs at its end, the state at
its start) comes from a tree over the blocks of a conversation, in groups of bounded
size, so no task holds a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weft.llm.shared import stash

#: What counts as white space, and what ends a whole text.
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
#: Rows of a block, and blocks of a group in the tree above them, as powers of two.
BLOCK_BITS, GROUP_BITS = 12, 10

#: States: nothing yet, after system, after user, after assistant. Each state wants one role next.
START, SYSTEM, USER, ASSISTANT = range(4)
WANTS = ("user", "user", "assistant", "user")
THEN = np.array([USER, USER, ASSISTANT, USER])
#: Classes of rows: initials, capitals where the row is truncated, and x for rows that have to go.
CLASSES = "suaoSUAOx"
CLASS_OF = {c: i for i, c in enumerate(CLASSES)}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Edits in the order of their letters.
LETTERS = "DIKR"
FAR = 1 << 60
NEVER = -1
#: Rows that are solved at once.
AT_ONCE = 1 << 16


def _arcs(c: str) -> list[tuple[int, int, int, int]]:
    """(letter, state, next state, cost) of the edits of a row of class ``c``."""
    found = [(0, q, q, DELETE) for q in range(4)]
    if c != "x":
        cut = CUT if c.isupper() else 0
        found += [(3, q, int(THEN[q]), REROLE + cut) for q in range(4)]
        found += [(2, q, int(THEN[q]), KEEP + cut) for q in range(4) if c.lower() == WANTS[q][0]]
        found += [(2, START, SYSTEM, KEEP + cut)] if c.lower() == "s" else []
    return found


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By class, state and letter: next state and cost; by class, the least costs between states."""
    after, cost, between = np.full((len(CLASSES), 4, 4), NEVER), np.full((len(CLASSES), 4, 4), FAR), np.full((len(CLASSES), 4, 4), FAR)
    for i, c in enumerate(CLASSES):
        for letter, q, then, price in _arcs(c):
            after[i, q, letter], cost[i, q, letter] = then, price
            between[i, q, then] = min(between[i, q, then], price)
    return after, cost, between


AFTER, COST, BETWEEN = _tables()


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two tables of costs: least sums."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), FAR)


def _inserts() -> np.ndarray:
    """Least costs between states by insertions alone."""
    one = np.full((4, 4), FAR)
    one[range(4), range(4)] = 0
    one[range(4), THEN] = INSERT
    return _times(one, one)


INSERTS = _inserts()
#: A row with the insertions before it.
STEP = _times(INSERTS, BETWEEN)
#: Costs at the end of a conversation, which may still insert; the fifth number says that it is the end.
LAST = [*(int(x) for x in INSERTS[:, [START, ASSISTANT]].min(1)), 1]


class Solved:
    """The optimal arcs of a batch of blocks and the least path from every node.

    ``blocks`` are strings of classes, ``ends`` the costs at their ends (and 1 for the end of a conversation).
    Node ``4 * layer + state``; a block of n rows has n + 1 layers.
    """

    def __init__(self, blocks: list[str], ends: np.ndarray):
        sizes = np.array([len(b) for b in blocks])
        self.base = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.last = self.base[1:] - 1
        layers = int(self.base[-1])
        codes = np.full(layers, NEVER)
        codes[np.setdiff1d(np.arange(layers), self.last)] = [CLASS_OF[c] for b in blocks for c in b]
        self.cost = np.empty((layers, 4), dtype=np.int64)
        self.cost[self.last] = ends[:, :4]
        # The cost DP: one step back in all blocks that are long enough, the longest first.
        order = np.argsort(-sizes, kind="stable")
        active = len(order)
        for t in range(int(sizes.max(initial=0))):
            while active and sizes[order[active - 1]] <= t:
                active -= 1
            at = self.last[order[:active]] - 1 - t
            self.cost[at] = (STEP[codes[at]] + self.cost[at + 1][:, None, :]).min(-1)
        self._find_arcs(codes, ends[:, 4] == 1)
        self._rank()

    def _find_arcs(self, codes: np.ndarray, closed: np.ndarray) -> None:
        """``target``: by node and letter, where an optimal arc leads, or NEVER."""
        layers = len(codes)
        inner = codes >= 0
        target, price = np.full((layers, 4, 4), NEVER), np.full((layers, 4, 4), FAR)
        after = AFTER[codes[inner]]
        target[inner] = np.where(after == NEVER, NEVER, 4 * (np.flatnonzero(inner)[:, None, None] + 1) + after)
        price[inner] = COST[codes[inner]]
        # Insertions stay in their layer. At the end of a block only a conversation's end has them.
        open_ = inner.copy()
        open_[self.last[closed]] = True
        target[open_, :, 1] = 4 * np.flatnonzero(open_)[:, None] + THEN
        price[open_, :, 1] = INSERT
        flat = self.cost.reshape(-1)
        kept = (target != NEVER) & (flat[np.maximum(target, 0)] + price == self.cost[:, :, None]) & (self.cost[:, :, None] < FAR)
        self.target = np.where(kept, target, NEVER).reshape(-1, 4)

    def _rank(self) -> None:
        """Prefix doubling: nodes ranked by their least audits of 1, 2, 4 … edits, each with a pointer over that many."""
        nodes = np.arange(len(self.target))
        has = (self.target != NEVER).any(1)
        letter = (self.target != NEVER).argmax(1)
        rank = np.where(has, letter + 1, 0)
        pointer = np.where(has, self.target[nodes, letter], nodes)
        self.pointers = [pointer]
        while True:
            key = rank * (int(rank.max(initial=0)) + 1) + rank[pointer]
            rank = np.unique(key, return_inverse=True)[1]
            further = pointer[pointer]
            if (further == pointer).all():
                break
            pointer = further
            self.pointers.append(pointer)
        # A node takes the optimal arc of the least letter, and of equal ones that to the least rank.
        width = int(rank.max(initial=0)) + 1
        order = np.where(self.target != NEVER, np.arange(4) * width + rank[np.maximum(self.target, 0)], 4 * width)
        self.has, self.letter = has, order.argmin(1)

    def exits(self) -> np.ndarray:
        """By block and state at its start, the state at its end."""
        return self.pointers[-1][4 * self.base[:-1, None] + np.arange(4)] % 4

    def audits(self, entry: np.ndarray) -> list[str]:
        """The least audit of every block from the state at its start."""
        on = np.zeros(len(self.target), dtype=bool)
        on[4 * self.base[:-1] + entry] = True
        for pointer in reversed(self.pointers):
            on[pointer[on]] = True
        path = np.flatnonzero(on & self.has)
        layer = path // 4
        # Insertions come before their row: within a layer the costs fall along the path.
        path = path[np.lexsort((-self.cost.reshape(-1)[path], layer))]
        letters = np.array(list(LETTERS))[self.letter[path]]
        cuts = np.searchsorted(path // 4, self.base)
        return ["".join(letters[a:b]) for a, b in zip(cuts, cuts[1:])]


def _whole(xs: pd.Series, width: int) -> np.ndarray:
    return np.array([list(x) for x in xs], dtype=np.int64).reshape(-1, width)


def _solved(blocks: pd.Series, ends: pd.Series) -> Iterator[tuple[slice, Solved]]:
    """The blocks of a batch, about AT_ONCE rows at a time."""
    share = blocks.str.len().cumsum() // AT_ONCE
    cuts = [*np.flatnonzero(share.diff().fillna(1)), len(blocks)]
    for a, b in zip(cuts, cuts[1:]):
        yield slice(a, b), Solved(list(blocks[a:b]), _whole(ends[a:b], 5))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _costs(blocks: pd.Series) -> pd.Series:
    """Least costs through a block, as 16 numbers."""
    out = []
    for block in blocks:
        found = STEP[CLASS_OF[block[0]]]
        for c in block[1:]:
            found = _times(found, STEP[CLASS_OF[c]])
        out.append(found.reshape(-1))
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _costs_of_group(groups: pd.Series) -> pd.Series:
    out = []
    for group in groups:
        tables = [np.array(x, dtype=np.int64).reshape(4, 4) for x in group]
        found = tables[0]
        for table in tables[1:]:
            found = _times(found, table)
        out.append(found.reshape(-1))
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
def _ends_of_group(groups: pd.Series, given: pd.Series) -> pd.Series:
    """From the costs at a group's end, those at the end of each of its members."""
    out = []
    for group, end in zip(groups, given):
        found, at = [list(end)], np.array(end[:4], dtype=np.int64)
        for x in list(group)[:0:-1]:
            at = np.minimum((np.array(x, dtype=np.int64).reshape(4, 4) + at).min(1), FAR)
            found.append([*at.tolist(), 0])
        out.append(found[::-1])
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _exits(blocks: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([x for _, solved in _solved(blocks, ends) for x in solved.exits()], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _exits_of_group(groups: pd.Series) -> pd.Series:
    out = []
    for group in groups:
        found = np.arange(4)
        for x in group:
            found = np.array(x)[found]
        out.append(found)
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
def _entries_of_group(groups: pd.Series, given: pd.Series) -> pd.Series:
    """From the state at a group's start, that at the start of each of its members."""
    out = []
    for group, first in zip(groups, given):
        found = [[int(first[0])]]
        for x in list(group)[:-1]:
            found.append([int(x[found[-1][0]])])
        out.append(found)
    return pd.Series(out)


@F.pandas_udf(T.StructType().add("audit", "string").add("cost", "long").add("illegal", "long"))
def _edits(blocks: pd.Series, initials: pd.Series, ends: pd.Series, entries: pd.Series) -> pd.DataFrame:
    audits, costs = [], []
    for part, solved in _solved(blocks, ends):
        entry = _whole(entries[part], 1)[:, 0]
        audits += solved.audits(entry)
        costs += solved.cost[solved.base[:-1], entry].tolist()
    illegal = [sum(x + y not in ("su", "ua", "au") for x, y in zip(s, s[1:])) for s in initials]
    return pd.DataFrame({"audit": pd.Series(audits, dtype=object), "cost": pd.Series(costs, dtype="int64"), "illegal": pd.Series(illegal, dtype="int64")})


def _meet(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """A join on equal keys, where null equals null."""
    other = right.select([F.col(c).alias(f"other_{c}" if c in keys else c) for c in right.columns])
    same = [left[k].eqNullSafe(other[f"other_{k}"]) for k in keys]
    found = left.join(other, same, how)
    return found if how in ("left_semi", "left_anti") else found.drop(*[f"other_{k}" for k in keys])


def _spread(
    nodes: DataFrame, value: Column, combine: Callable[[Column], Column], deal: Callable[[Column, Column], Column], root: Column, group_bits: int
) -> DataFrame:
    """``nodes`` (conv, node, …) with ``given``: what comes down a tree over each conversation's nodes.

    A conversation of one node is given ``root``. Otherwise up to 2 ** group_bits nodes in a row are one node of
    the next level, whose value ``combine`` makes of theirs and from whose share ``deal`` makes theirs.
    """
    many = nodes.groupBy("conv").count().where("count > 1")
    alone = _meet(nodes, many, ("conv",), "left_anti").withColumn("given", root)
    several = stash(_meet(nodes, many, ("conv",), "left_semi").select("*", value.alias("value"), F.shiftright("node", group_bits).alias("group")), "level")
    if several.isEmpty():
        return alone
    kids = stash(several.groupBy("conv", F.col("group").alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "value"))).alias("kids")), "group")
    above = _spread(kids, combine(F.col("kids.value")), combine, deal, root, group_bits).select("conv", F.col("kids.node").alias("nodes"), deal(F.col("kids.value"), F.col("given")).alias("shares"))
    shares = above.select("conv", F.explode(F.arrays_zip("nodes", "shares")).alias("s")).select("conv", F.col("s.nodes").alias("node"), F.col("s.shares").alias("given"))
    met = _meet(several.drop("value", "group"), shares, ("conv", "node"))
    return alone.unionByName(met.select(*alone.columns))


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, fault of the rows, damaged by crc32(``conv:turn``) % 20, nulls read as one space.

    0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 sets its role to user.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown(conv_col), F.lit(":"), shown(turn_col))) % 20
    found = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), shown(role_col).alias("role"), shown(text_col).alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    return found.where("fault <> 0").select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat("fault", F.when(F.col("fault") == 3, 2).otherwise(1))).alias("fault"))


def _named(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), shown(role_col).alias("role"), shown(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


def _judged_blocks(rows: DataFrame, block_bits: int) -> DataFrame:
    """conv, node, codes, initials, key, blank, duplicate, truncated: the rows in order, cut into blocks."""
    ended = F.rtrim(F.col("text"), F.lit(SPACE))
    whole = F.lit(False)
    for mark in ENDS:
        whole = whole | F.endswith(ended, F.lit(mark))
    facts = rows.select("conv", "turn", "role", "digest", (ended == "").alias("blank"), (~whole).alias("open"), F.monotonically_increasing_id().alias("any"))
    # The last column only lets rows that are equal in all others fall into several ranges.
    order = ("conv", "turn", "role", "digest", "any")
    placed = stash(facts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()).drop("any"), "placed")
    first = placed.where("NOT blank").groupBy("conv", "role", "digest").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    judged = placed.join(first, "seq", "left").select("*", (~F.col("blank") & F.col("first").isNull()).alias("again"), initial.alias("initial"))
    code = F.when(F.col("blank") | F.col("again"), "x").when(F.col("open"), F.upper("initial")).otherwise(F.col("initial"))
    blocks = judged.groupBy("conv", F.shiftright("seq", block_bits).alias("node")).agg(
        F.array_sort(F.collect_list(F.struct("seq", code.alias("code"), "initial"))).alias("rows"),
        F.min_by(F.struct("turn", "role", "digest"), "seq").alias("key"),
        F.count_if("blank").alias("blank"),
        F.count_if("again").alias("duplicate"),
        F.count_if(F.col("open") & ~F.col("blank") & ~F.col("again")).alias("truncated"),
    )
    return blocks.select("conv", "node", F.array_join("rows.code", "").alias("codes"), F.array_join("rows.initial", "").alias("initials"), "key", "blank", "duplicate", "truncated")


def repair(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_bits: int = BLOCK_BITS, group_bits: int = GROUP_BITS
) -> tuple[DataFrame, DataFrame]:
    """The report of every conversation, and the rows of the repaired ones.

    Report: conv, gaps, blank, duplicate, truncated, illegal, cost (longs), audit. Repaired
    rows: conv, place (from 1), role, text, in the order of place within a partition.
    Edits, costs and faults are those of the contract of ``op12_conversations``.

    Rows go by turn, nulls first; rows of one turn by role and then by the SHA-256 of their
    text, so repeated rows are adjacent. Null roles and texts are one space; a null conversation is one like others.
    A conversation may have any number of rows: only its audit, which is one value, and the repaired rows of one
    conversation, which pass one task one by one, aren't spread. Other columns aren't read.
    An empty table gives no rows.
    """
    told = _named(rows, conv_col, turn_col, role_col, text_col)
    blocks = stash(_judged_blocks(told, block_bits), "blocks")
    to_ends = _spread(blocks, _costs("codes"), _costs_of_group, _ends_of_group, F.array(*map(F.lit, LAST)).cast("array<bigint>"), group_bits)
    ended = stash(to_ends.withColumnRenamed("given", "ends"), "ends")
    to_entries = _spread(ended, _exits("codes", "ends"), _exits_of_group, _entries_of_group, F.array(F.lit(START)).cast("array<bigint>"), group_bits)
    edited = to_entries.select("conv", "node", "key", "initials", "blank", "duplicate", "truncated", _edits("codes", "initials", "ends", "given").alias("e"))
    solved = stash(edited.select("conv", "node", "key", "blank", "duplicate", "truncated", F.substring("initials", 1, 1).alias("opens"), F.substring("initials", -1, 1).alias("closes"), "e.*"), "solved")
    turns = told.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    parts = solved.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("node", "audit", "cost", "opens", "closes"))).alias("parts"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
    )
    # Neighbours across the border of two blocks.
    borders = F.zip_with(F.slice("parts", 2, F.size("parts")), F.slice("parts", 1, F.size("parts") - 1), lambda b, a: F.concat(a["closes"], b["opens"]))
    across = F.size(F.filter(borders, lambda x: ~x.isin("su", "ua", "au"))).cast("long")
    counts = parts.select("conv", "blank", "duplicate", "truncated", (F.col("illegal") + across).alias("illegal"), F.col("parts")[0]["cost"].alias("cost"), F.array_join("parts.audit", "").alias("audit"))
    return _meet(turns, counts, ("conv",)), _repaired(told, solved)


REPAIRED = T.StructType().add("place", "long").add("role", "string").add("text", "string")


class Player:
    """Applies the edits of one conversation after the other to its rows, as they come."""

    def __init__(self):
        self.conv, self.edits, self.state, self.place, self.out = object(), deque(), START, 0, []

    def put(self, role: str, text: str) -> None:
        self.state = SYSTEM if self.state == START and role[:1] == "s" else int(THEN[self.state])
        self.place += 1
        self.out.append((self.conv, self.place, role, text))

    def close(self) -> None:
        """Only insertions may be left behind the last row."""
        for _ in range(len(self.edits)):
            assert self.edits.popleft() == "I"
            self.put(WANTS[self.state], "")

    def take(self, conv: object, role: str, audit: str | None, text: str | None) -> None:
        """A row, or the next edits of its conversation."""
        if conv != self.conv:
            self.close()
            self.conv, self.state, self.place = conv, START, 0
        if text is None:
            self.edits.extend(audit)
            return
        while (edit := self.edits.popleft()) == "I":
            self.put(WANTS[self.state], "")
        if edit != "D":
            self.put(role if edit == "K" else WANTS[self.state], text)

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _repaired(told: DataFrame, solved: DataFrame) -> DataFrame:
    """conv, place, role, text: the audits, each before the first row of its block, and the rows in one order, read as a stream."""
    none = F.lit(None).cast("string")
    edits = solved.select("conv", "key.turn", "key.role", "key.digest", F.col("node"), F.col("audit"), none.alias("text"))
    texts = told.select("conv", "turn", "role", "digest", F.lit(None).cast("long").alias("node"), none.alias("audit"), "text")
    order = ("conv", "turn", "role", "digest", F.col("node").asc_nulls_last())
    dealt = edits.unionByName(texts).repartition("conv").sortWithinPartitions(*order).select("conv", "role", "audit", "text")
    schema = T.StructType([dealt.schema["conv"], *REPAIRED])
    made = to_arrow_schema(schema)

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        player = Player()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                player.take(*row)
            if player.out:
                yield _batch(player.taken(), made)
        player.close()
        if player.out:
            yield _batch(player.taken(), made)

    return dealt.mapInArrow(play, schema)


def digests(repaired: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of the rows that ``repair`` returned: ``role:text`` joined by line ends, hashed row by row without holding them."""
    schema = T.StructType([repaired.schema["conv"], T.StructField("repaired_sha256", T.StringType())])
    made = to_arrow_schema(schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []
        for batch in batches:
            for conv, place, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if place == 1:
                    if digest:
                        out.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256()
                digest.update(f"{'' if place == 1 else chr(10)}{role}:{text}".encode())
            if out:
                yield _batch(out, made)
                out = []
        if digest:
            yield _batch([(now, digest.hexdigest())], made)

    return repaired.mapInArrow(hashed, schema)
