"""Random-projection trees over vectors: fitted on a bounded sample, applied to every row.

Two operators stand on them: approximate nearest neighbours, which searches the
forest through one priority queue, and embedding near-duplicates, which lets the
leaves overlap and compares all vectors of a leaf.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.shared import components, stash

SAMPLE_ROWS = 20_000
#: Rows of one block: a cell with more is compared block by block, so that no task holds a whole large cell.
BLOCK_ROWS = 2_048


@dataclass
class Tree:
    """Node i splits by directions[i] at thresholds[i] into left[i] and right[i]; a leaf has -1 there and its number in leaf[i]."""

    directions: np.ndarray
    thresholds: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    leaves: int

    def assign(self, vectors: np.ndarray, spill: float = 0.0) -> list[tuple[np.ndarray, int]]:
        """(row numbers, leaf) for each leaf that has rows. Within ``spill`` of a threshold a row goes both ways."""
        found, todo = [], [(0, np.arange(len(vectors)))]
        while todo:
            k, rows = todo.pop()
            if not len(rows):
                continue
            if self.left[k] < 0:
                found.append((rows, int(self.leaf[k])))
                continue
            side = vectors[rows] @ self.directions[k] - self.thresholds[k]
            todo += [(self.left[k], rows[side <= spill]), (self.right[k], rows[side > -spill])]
        return found


def fit_tree(sample: np.ndarray, leaf_rows: float, spill: float, rng: np.random.Generator, max_depth: int = 24) -> Tree:
    """Splits along the difference of two random rows, until a node has ``leaf_rows`` sampled rows or no clean cut.

    Of the thresholds in the middle half, the one with fewest rows within ``spill`` is
    taken, which goes around dense groups instead of through them. A node where even
    that cut would send most rows both ways stays a leaf.
    """
    nodes: list[list] = []  # direction, threshold, left, right, leaf
    leaves, todo = 0, [(np.arange(len(sample)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        k = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = k
        nodes.append([np.zeros(sample.shape[1]), 0.0, -1, -1, -1])
        cut = None
        if len(rows) > max(2.0, leaf_rows) and depth < max_depth:
            for _ in range(4):
                a, b = sample[rng.choice(rows, 2, replace=False)]
                norm = float(np.linalg.norm(a - b))
                if not norm:
                    continue
                way = (a - b) / norm
                at = np.sort(sample[rows] @ way)
                options = at[len(at) // 4 : max(len(at) // 4 + 1, 3 * len(at) // 4)]
                options = (options[:-1] + options[1:]) / 2 if spill and len(options) > 1 else np.array([np.median(at)])
                near = np.searchsorted(at, options + spill, "right") - np.searchsorted(at, options - spill, "left")
                best = int(near.argmin())
                if near[best] <= 0.4 * len(rows) and at[0] <= options[best] < at[-1]:
                    cut = way, float(options[best])
                    break
        if cut is None:
            nodes[k][4] = leaves
            leaves += 1
            continue
        nodes[k][:2] = cut
        above = sample[rows] @ cut[0] > cut[1]
        todo += [(rows[~above], depth + 1, k, 0), (rows[above], depth + 1, k, 1)]
    columns = list(zip(*nodes))
    return Tree(np.array(columns[0]), np.array(columns[1]), np.array(columns[2]), np.array(columns[3]), np.array(columns[4]), leaves)


@dataclass
class Forest:
    """Trees whose leaves are numbered through: a cell is a leaf of one of them."""

    trees: list[Tree]

    @property
    def starts(self) -> list[int]:
        return [0, *np.cumsum([t.leaves for t in self.trees]).tolist()]

    def cells(self, vectors: np.ndarray, spill: float = 0.0) -> list[list[int]]:
        """Ascending cells of each row."""
        found: list[list[int]] = [[] for _ in vectors]
        for start, tree in zip(self.starts, self.trees):
            for rows, leaf in tree.assign(vectors, spill):
                for i in rows.tolist():
                    found[i].append(start + leaf)
        return [sorted(x) for x in found]

    def search(self, vectors: np.ndarray, sizes: dict[int, int], budget: float) -> list[list[int]]:
        """Cells to visit for each row, best first, until they hold ``budget`` rows.

        One queue holds the nodes of all trees; its priority is the sum of the squared
        distances to the thresholds that were passed on the wrong side.
        """
        sides = [vectors @ t.directions.T - t.thresholds for t in self.trees]
        starts, found = self.starts, []
        left, right, leaf = ([getattr(t, x).tolist() for t in self.trees] for x in ("left", "right", "leaf"))
        for i in range(len(vectors)):
            own = [s[i].tolist() for s in sides]
            queue = [(0.0, t, 0) for t in range(len(self.trees))]
            cells, rows = [], 0
            while queue and rows < budget:
                far, t, k = heapq.heappop(queue)
                while left[t][k] >= 0:
                    side = own[t][k]
                    near, other = (right[t][k], left[t][k]) if side > 0 else (left[t][k], right[t][k])
                    heapq.heappush(queue, (far + side * side, t, other))
                    k = near
                cell = starts[t] + leaf[t][k]
                if size := sizes.get(cell, 0):
                    cells.append(cell)
                    rows += size
            found.append(cells)
        return found


def fit_forest(sample: np.ndarray, trees: int, leaf_rows: float, spill: float = 0.0, seed: int = 11) -> Forest:
    """``leaf_rows`` counts sampled rows."""
    rng = np.random.default_rng(seed)
    return Forest([fit_tree(sample, leaf_rows, spill, rng) for _ in range(trees)])


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def usable(vector: str) -> Column:
    """Vectors that take part: not null or empty, not zero, every component finite. NaN and the infinities aren't between these bounds."""
    most = 1.7976931348623157e308
    return F.coalesce(
        F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & x.cast("double").between(-most, most)) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def taking_part(vectors: DataFrame, vector_col: str) -> Column:
    """``usable``, and of the length that most usable vectors have (the larger one where two are as common)."""
    most = vectors.where(usable(vector_col)).groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return usable(vector_col) & (F.size(vector_col) == (most.d if most else 0))


def distinct_vectors(vectors: DataFrame, taken: Column, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, copies): every row ``taken`` as id, h1, h2, vector, and one row for each different vector: rep (its smallest id), n, h1, h2, vector.

    Copies are counted before the shuffle, so a vector that a third of the rows share
    is no hot group. Null ids take no part.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & taken).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    counted = rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    keys = stash(counted, "keys")
    own = rows.join(keys, ["h1", "h2"]).where("id = rep").dropDuplicates(["h1", "h2"])
    return rows, stash(own.select("rep", "n", "h1", "h2", "vector"), "vectors")


def sample_of(copies: DataFrame, sample_rows: int) -> tuple[np.ndarray, int]:
    """(the ``sample_rows`` vectors of smallest hash, as a matrix; the number of vectors)."""
    found = copies.orderBy("h2", "h1").limit(sample_rows).select("vector").toPandas()
    return matrix(found["vector"]), copies.count()


def calibrated_budget(copies: DataFrame, forest: Forest, index: DataFrame, sizes: dict[int, int], asked: np.ndarray, k: int, recall: float) -> float:
    """Rows that a query has to visit so that ``asked``, a few vectors, find on average ``recall`` of their true ``k`` nearest.

    Their true neighbours come from a comparison with all rows; each task returns its
    best ``k + 1``. What is known of the cells of those neighbours gives the place in the
    search at which each is met.
    """
    shared = copies.sparkSession.sparkContext.broadcast(asked)
    top = k + 1

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = pd.DataFrame({"asked": [], "rep": [], "score": []})
        for pdf in batches:
            if len(pdf):
                scores = shared.value @ matrix(pdf["vector"]).T
                own = pd.DataFrame({"asked": np.repeat(np.arange(len(scores)), len(pdf)), "rep": np.tile(pdf["rep"].to_numpy(), len(scores)), "score": scores.ravel()})
                found = pd.concat([found, own]).sort_values(["asked", "score", "rep"], ascending=[True, False, True]).groupby("asked").head(top)
        yield found.astype({"asked": "int32", "rep": "int64", "score": "float64"})

    some = copies.select("rep", "vector").mapInPandas(best, "asked int, rep long, score double")
    truth = some.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "rep"))).where(F.col("rank") <= top).drop("rank")
    cells = index.select("rep", "cell").join(stash(truth, "truth"), "rep").groupBy("asked", "rep").agg(F.collect_list("cell").alias("cells")).collect()
    orders = forest.search(asked, sizes, math.inf)
    met = []
    passed = [dict(zip(o, np.cumsum([sizes[c] for c in o]).tolist())) for o in orders]
    for r in cells:
        met.append(min(passed[r.asked][c] for c in r.cells))
    return float(np.quantile(met, recall, method="higher"))


def nearest(
    vectors: DataFrame,
    is_query: Callable[[Column], Column],
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = 12,
    leaf_rows: int = 256,
    recall: float = 0.92,
    sample_rows: int = SAMPLE_ROWS,
    calibration_rows: int = 128,
) -> DataFrame:
    """The ``k`` largest inner products found for each query: query_id long, rank int, vec_id long, score double.

    ``is_query`` tells from the id which rows are queries; every usable row but the query's own is a
    candidate. The forest is fitted on ``sample_rows`` different vectors, and all rows
    are indexed. A query visits cells until they hold the rows that ``calibration_rows``
    vectors needed to find ``recall`` of their true neighbours (``calibrated_budget``), and
    k + 1 rows of one tree at least. Vectors with near neighbours need few; vectors
    without any, as uniform ones of many dimensions, need a share of all rows. Ties go to the smaller id.

    Copies of a vector are searched once: of each vector, only its k + 1 smallest ids
    can be among anyone's k nearest. Null, empty, zero and non-finite vectors, and null
    ids, take no part, nor do vectors of another length than most of the sample have. Repeated ids
    are separate candidates; a query leaves out rows of its own id, and a repeated query id
    has its own k rows for each different vector. No usable rows give no rows. Other columns aren't read.
    """
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, copies = distinct_vectors(vectors, taking_part(vectors, vector_col), id_col, vector_col)
    sample, total = sample_of(copies, sample_rows)
    if not total:
        return empty
    leaf = min(leaf_rows, max(16.0, total / 100))
    forest = fit_forest(sample, trees, leaf * len(sample) / total)
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast(forest)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cells_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series(shared.value.cells(matrix(column)) if len(column) else [], dtype=object)

    index = stash(copies.select("rep", "vector", F.explode(cells_of("vector")).alias("cell")), "index")
    sizes = {r.cell: r["count"] for r in index.groupBy("cell").count().collect()}  # as many as the forest has cells
    all_sizes = context.broadcast(sizes)
    budget = max(calibrated_budget(copies, forest, index, sizes, sample[:calibration_rows], k, recall), trees * (k + 1) + 1)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def visits_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series(shared.value.search(matrix(column), all_sizes.value, budget) if len(column) else [], dtype=object)

    queries = stash(rows.where(is_query(F.col("id"))).join(copies.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("id").alias("query_id"), "rep"), "queries")
    asked = copies.join(queries.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("query"), F.col("vector").alias("asked"))
    visits = stash(asked.select("query", "asked", F.posexplode(visits_of("asked")).alias("turn", "cell")), "visits")

    # Blocks keep both sides of a group small at any size: a cell's rows are dealt to blocks of its own number, its queries to rounds.
    asking = visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("rounds"))
    plan = stash(index.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).join(asking, "cell"), "plan")
    dealt = index.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    left = dealt.select("cell", "block", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("round"), "rep", "vector")
    top = k + 1

    def rank(key: tuple, found: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(asking):
            return pd.DataFrame({"query": [], "rep": [], "score": []})
        reps = found["rep"].to_numpy()
        order = reps.argsort()
        reps = reps[order]
        scores = matrix(asking["asked"]) @ matrix(found["vector"])[order].T
        least = asking["least"].to_numpy(float)
        if scores.shape[1] > top:  # of equal scores, the smaller ids
            kth = np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top]
            least = np.fmax(kth, least)
        q, v = np.nonzero(~(scores < least[:, None]))
        return pd.DataFrame({"query": asking["query"].to_numpy()[q], "rep": reps[v], "score": scores[q, v]})

    def visit(chosen: DataFrame) -> DataFrame:
        right = chosen.join(plan, "cell").select(
            "cell",
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.pmod(F.xxhash64("query"), "rounds").cast("int").alias("round"),
            "query",
            "asked",
            "least",
        )
        keys = ["cell", "block", "round"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rank, "query long, rep long, score double")

    # The first cells of each query give a score that its nearest must reach; the other cells need return no less.
    first = stash(visit(visits.where(F.col("turn") < trees).withColumn("least", F.lit(None).cast("double"))), "first")
    best = first.groupBy("query", "rep").agg(F.max("score").alias("score")).groupBy("query").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    least = stash(best.select("query", F.get("scores", F.lit(top - 1)).alias("least")), "least")
    later = visit(visits.where(F.col("turn") >= trees).join(least, "query"))

    def best_of(rows: DataFrame, key: tuple[str, ...], order: tuple, most: int) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= most)

    found = first.unionByName(later).groupBy("query", "rep").agg(F.max("score").alias("score"))
    found = stash(best_of(found, ("query",), (F.desc("score"), "rep"), top).drop("rank"), "found")
    few = best_of(rows.select("h1", "h2", F.col("id").alias("vec_id")), ("h1", "h2"), ("vec_id",), top)
    ids = few.join(copies.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "vec_id")
    near = best_of(found.join(ids, "rep").select("query", "vec_id", "score"), ("query",), (F.desc("score"), "vec_id"), top)
    out = queries.join(stash(near.drop("rank"), "near"), F.col("rep") == F.col("query")).where("vec_id <> query_id")
    return best_of(out.select("query_id", "vec_id", "score"), ("query_id",), (F.desc("score"), "vec_id"), k).select("query_id", "rank", "vec_id", "score")


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.9,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = 6,
    leaf_rows: int = 256,
    spill: float = 0.3,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row for each vector: id, n_links long, component_id long, kept boolean.

    Vectors that share a leaf of a tree are compared by cosine in double precision and
    linked at ``threshold`` or more. A pair counts in the first leaf that its two
    vectors share, so ``n_links`` needs no list of pairs; leaves emit only counts and
    one edge for each linked vector. ``spill`` is the overlap of the leaves in standard
    deviations of the projected difference of a pair at the threshold.

    Copies of a vector are compared once and counted as often as they occur. Unusable
    vectors, and those of another length than most have, link with nothing and are
    their own component. Rows with a null id are
    returned with null ids, no links and kept. Repeated ids count as separate vectors.
    """
    all_ids = vectors.select(F.col(id_col).cast("long").alias("id"))
    taken = taking_part(vectors, vector_col)
    rows, copies = distinct_vectors(vectors, taken, id_col, vector_col)
    sample, total = sample_of(copies, sample_rows)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True) if total else sample
    width = spill * math.sqrt(max(0.0, 2 - 2 * threshold)) / math.sqrt(max(1, sample.shape[1]))
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast(fit_forest(unit, trees, leaf_rows * len(sample) / total, width) if total else None)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cells_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            m = matrix(column)
            yield pd.Series(shared.value.cells(m / np.linalg.norm(m, axis=1, keepdims=True), width) if len(column) else [], dtype=object)

    placed = stash(copies.select("rep", "n", "vector", cells_of("vector").alias("cells")), "placed")
    index = placed.select("rep", "n", "vector", "cells", F.explode("cells").alias("cell"))
    blocks = index.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = index.join(stash(blocks, "blocks"), "cell").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "n", "vector", "cells"
    )

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        cell, low, high = key
        group = group.sort_values("rep", ignore_index=True)
        m = matrix(group["vector"])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        linked = m @ m.T >= threshold
        np.fill_diagonal(linked, False)
        block = group["block"].to_numpy()
        if low != high:
            linked &= block[:, None] != block[None, :]
        some = linked.any(axis=1)
        group, linked = group[some], linked[np.ix_(some, some)]
        reps, n = group["rep"].to_numpy(), group["n"].to_numpy()
        earlier = [[c for c in cells if c < cell] for cells in group["cells"]]
        names = {c: i for i, c in enumerate(sorted({c for x in earlier for c in x}))}
        member = np.zeros((len(reps), max(1, len(names))), np.float32)
        for i, cells in enumerate(earlier):
            member[i, [names[c] for c in cells]] = 1
        counted = linked & (member @ member.T == 0)
        label = np.arange(len(reps))
        while True:  # rows are in order of rep, so the smallest position is the smallest id
            low_label = np.minimum(label, np.where(linked, label[None, :], len(reps)).min(axis=1, initial=len(reps)))
            if (low_label == label).all():
                break
            label = low_label
        return pd.DataFrame({"rep": reps, "links": counted @ n, "root": reps[label]})

    found = stash(pairs.groupBy("cell", "low", "high").applyInPandas(compare, "rep long, links long, root long"), "links")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    each = copies.select("rep", "n", "h1", "h2").join(linked, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    each = stash(each.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "each")
    with_vector = rows.select("id", "h1", "h2").join(each, ["h1", "h2"]).select("id", "n_links", "component_id")
    without = vectors.where(F.col(id_col).isNull() | ~taken).select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"))
    out = with_vector.unionByName(without)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).alias("kept"))
