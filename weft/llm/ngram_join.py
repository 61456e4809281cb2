"""N-gram Jaccard self-join by token-combination prefixes.

The tokens of a document are its distinct word shingles. They are ordered by how
many documents have them, rarest first, and a document indexes the prefix that any
partner must reach into. The prefix is extended so that partners share several of
its tokens: rare ones are indexed alone, frequent ones only in combinations of two
of the same class. Candidates are then verified on whole sets.

Links are only needed as components, so a bucket's members are first compared with
one pivot; what the pivot joins needs no comparison of its own. Of the buckets that
still hold members apart, small ones are compared pair by pair. Large ones become
hubs: each member is written as its differences from what most members have, and two
members that no hub joins must share one of those differences, which are rare. So the
combination is extended by a token that the hub doesn't have in common, and only
members that share it meet. No link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.shared import components, drop_stash, stash
from weft.llm.word_hash import WordHashes, mixed, pair, run_hashes, signed

#: Buckets of the frequency sketch are 2 to a power between these: two for each document. It is the only thing about tokens that reaches the driver.
SKETCH_BITS = (19, 22)
#: The sketch is summed in so many parts.
SKETCH_PARTS = 64
#: Parts are first summed over so many groups of tasks, so that no task gathers what all tasks have sent.
SUM_GROUPS = 32
#: Least and most bytes of the bitmap that tells which documents' sets are needed; it has two for each of them between these.
MARK_BYTES = (1 << 20, 1 << 26)
#: Classes of frequent tokens. Partners share more tokens than there are classes, hence two of one class.
CLASSES = 16
#: A token is frequent when its bucket holds so many documents more than the median bucket.
FREQUENT = 64
#: Bins of the counts that pairs are first compared by.
BINS = 256
#: Pairs for each member of a bucket, beyond which they aren't listed but the bucket becomes a hub.
PAIRS_A_MEMBER = 16
#: So many times, what meets in a hub becomes a hub of its own if it is large; then its pairs are listed.
HUB_ROUNDS = 6
#: Sets of so many shingles or more use all classes.
LARGE_FROM = 40


def small_to(percent: int) -> int:
    """Sets of up to so many use one class. Those from LARGE_FROM on do both, as the sizes of partners differ."""
    return -(-LARGE_FROM * 100 // percent)


def shingle_set(memo: WordHashes, text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    words = memo.of(text.encode("utf-8", "surrogatepass").lower().split()) if text else ()  # of bytes, only A to Z are lowered
    return np.unique(run_hashes(words, min(size, len(words)))) if len(words) else np.zeros(0, np.uint64)


def prefix_length(n: int, percent: int) -> int:
    """Tokens that a set of n must look at to meet every partner in one token: n less the smallest overlap, plus one."""
    return n - -(-n * percent // 100) + 1


def index_keys(tokens: np.ndarray, counts: np.ndarray, limit: float, percent: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(keys, what each allows, rare tokens, frequent tokens of the prefix).

    ``tokens`` are sorted, ``counts`` holds the sketch's count of each, ``limit`` is
    where frequent ones begin. A rare token allows an overlap of as many tokens as
    stand from it on, if it is the first that two sets share; a combination says
    nothing, which is 0.
    """
    n = len(tokens)
    all_classes = [1] * (n <= small_to(percent)) + [CLASSES] * (n >= LARGE_FROM)
    most = min(n, prefix_length(n, percent) + max(all_classes))
    rank = counts.astype(np.int64) * n + np.arange(n)  # by count, then by token
    order = np.sort(np.partition(rank, most - 1)[:most]) % n
    tokens, counts = tokens[order], counts[order]
    rare = int(np.searchsorted(counts, limit, "right"))
    keys, bounds = [tokens[:rare]], [n - np.arange(rare)]
    for classes in all_classes if most - rare > 1 else []:
        often = np.sort(tokens[rare : min(n, prefix_length(n, percent) + classes)])
        own = (often >> np.uint64(40)) % np.uint64(classes)
        for c in range(classes):
            group = often[own == c]
            i, j = np.triu_indices(len(group), 1)
            keys.append(pair(group[i], group[j], classes))
            bounds.append(np.zeros(len(i), np.int64))
    return np.concatenate(keys), np.concatenate(bounds), rare, most - rare


def _measure(size: int, bits: int):
    parts = (1 << bits) // SKETCH_PARTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, sketch = WordHashes(), np.zeros(1 << bits, np.int32)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                tokens = shingle_set(memo, text, size)
                sketch[bucket_of(tokens, bits)] += 1
                digest = xxhash.xxh3_128_intdigest(tokens.tobytes())
                out.append((len(tokens), (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)))
            found = pd.DataFrame(out, columns=["n", "s1", "s2"])
            yield found.assign(id=pdf["id"].to_numpy(), part=-1, counts=None)[["id", "n", "s1", "s2", "part", "counts"]]
        filled = [i for i in range(SKETCH_PARTS) if sketch[i * parts : (i + 1) * parts].any()]
        yield pd.DataFrame({"id": None, "n": task_group(), "s1": 0, "s2": 0, "part": filled, "counts": [narrowed(sketch[i * parts : (i + 1) * parts]) for i in filled]})

    return run


def sketch_bits(documents: int) -> int:
    """With a fixed number of buckets, tokens that more and more documents share would look as rare as any, and their buckets and pairs outgrow the input."""
    return min(SKETCH_BITS[1], max(SKETCH_BITS[0], documents.bit_length() + 1))


def bucket_of(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(tokens) >> np.uint64(64 - bits)).astype(np.int64)


def narrowed(counts: np.ndarray) -> bytes:
    """Counts in bytes, or in wider numbers where one needs them."""
    return counts.astype(np.uint8 if counts.max() < 1 << 8 else np.int32).tobytes()


def task_group() -> int:
    return TaskContext.get().partitionId() % SUM_GROUPS


def _added(size: int) -> Callable:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.int32)
        for x in rows["data"]:
            total += np.frombuffer(x, np.uint8 if len(x) == size else np.int32)
        return pd.DataFrame({"part": [key[0]], "data": [total.tobytes()]})

    return run


def _united(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"part": [key[0]], "data": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows["data"]]).tobytes()]})


def _gathered(parts: DataFrame, combine: Callable, kind: type, size: int) -> np.ndarray:
    """Rows (part, group, data) put together by ``combine``, group by group and then over the groups: SKETCH_PARTS x size numbers."""
    some = parts.groupBy("part", "group").applyInPandas(combine, "part int, data binary")
    found = np.zeros((SKETCH_PARTS, size), kind)
    for r in some.groupBy("part").applyInPandas(combine, "part int, data binary").collect():
        found[r.part] = np.frombuffer(r.data, kind)
    return found.ravel()


def mark_places(ids: np.ndarray, size: int) -> list[np.ndarray]:
    """Bits of a bitmap of ``size`` bytes that stand for an id."""
    h = mixed(ids.view(np.uint64))
    return [(x % np.uint64(8 * size)).astype(np.int64) for x in (h, h >> np.uint64(32))]


def is_marked(ids: np.ndarray, bits: np.ndarray, size: int) -> np.ndarray:
    """Which ids a bitmap of ``size`` bytes has."""
    found = np.ones(len(ids), bool)
    for at in mark_places(ids, size):
        found &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found


def bin_counts(tokens: np.ndarray) -> bytes:
    """How many of a set's tokens fall in each of BINS bins, in bytes, or wider numbers where a bin needs them."""
    counts = np.bincount((mixed(tokens) % np.uint64(BINS)).astype(np.int64), minlength=BINS)
    return counts.astype(np.uint8 if counts.max() < 1 << 8 else np.uint32).tobytes()


@F.pandas_udf(T.StructType().add("common", T.LongType()).add("both", T.LongType()))
def most_common(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The most tokens that two sets can share by their bins, and the sum of their sizes."""
    of = lambda x: np.frombuffer(x, np.uint8 if len(x) == BINS else np.uint32)
    for one, two in batches:
        a, b = (np.array([of(x) for x in s], np.int64).reshape(-1, BINS) for s in (one, two))
        yield pd.DataFrame({"common": np.minimum(a, b).sum(axis=1), "both": a.sum(axis=1) + b.sum(axis=1)})


def _mark(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(8 * size, bool)
        for pdf in batches:
            for at in mark_places(pdf["id"].to_numpy().astype(np.int64), size):
                bits[at] = True
        parts = np.packbits(bits, bitorder="little").reshape(SKETCH_PARTS, -1)
        filled = [i for i in range(SKETCH_PARTS) if parts[i].any()]
        yield pd.DataFrame({"part": filled, "group": task_group(), "data": [parts[i].tobytes() for i in filled]})

    return run


def _differences(percent: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What a hub and a member that has most of its tokens there don't share; a row without a token for each such member."""
        for pdf in batches:
            hubs, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            near = []
            for hub, own, core in zip(pdf["p"], pdf["own"], pdf["core"]):
                apart = np.setxor1d(own, core)
                if 100 * (len(own) + len(core) - len(apart)) >= 2 * percent * len(own):
                    near.append(hub)
                    hubs.append(np.full(len(apart), hub, np.int64))
                    tokens.append(apart)
            found = pd.DataFrame({"p": np.concatenate(hubs), "token": pd.array(np.concatenate(tokens), "Int64")})
            yield pd.concat([found, pd.DataFrame({"p": pd.array(near, "int64"), "token": pd.array([None] * len(near), "Int64")})])

    return run


def _written_as_differences(percent: int, shared, bits: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Members by what they add to their hub, rarest first, and then by what they lack of it."""
        for pdf in batches:
            out = []
            for own, core, fix in zip(pdf["own"], pdf["core"], pdf["fix"]):
                core = np.setxor1d(core, fix) if fix is not None else np.asarray(core)
                added = np.setdiff1d(own, core)
                lacking = np.setdiff1d(core, own)
                counts = shared.value[bucket_of(added.view(np.uint64), bits)]
                added = added[np.lexsort((added, counts))]
                n, common = len(own), len(own) - len(added)
                least = -(-n * percent // 100)
                near = common >= least
                tokens = np.concatenate([added, lacking]) if near else added[: n - least + 1]
                out.append((n, len(core), common, len(added), len(lacking), near, tokens))
            columns = pd.DataFrame(out, columns=["n", "size", "common", "added", "lacking", "near", "tokens"])
            yield pd.concat([pdf[["p", "id", "c"]].reset_index(drop=True), columns], axis=1)

    return run


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles long, component_id long.

    Two documents link when 100 times the intersection of their shingle sets is
    ``percent`` times the union or more; a component has the smallest id that links
    reach. ``id_col`` must hold whole numbers.

    Null and empty texts, and texts without words, have no shingles and link with
    nothing. Documents with equal sets are linked without being compared. Rows with a
    null id get a null component and take no part. Rows that repeat an id are one
    document with several texts: it links where one of them does. Columns besides
    the two aren't read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).alias("text"))
    bits = sketch_bits(docs.count())
    measured = stash(rows.mapInPandas(_measure(size, bits), "id string, n long, s1 long, s2 long, part int, counts binary"), "measured")
    sets = measured.where("part < 0").select(F.col("id").cast("long").alias("id"), "n", "s1", "s2")
    sketch = _gathered(measured.where("part >= 0").select("part", F.col("n").alias("group"), F.col("counts").alias("data")), _added((1 << bits) // SKETCH_PARTS), np.int32, (1 << bits) // SKETCH_PARTS)
    shared = spark.sparkContext.broadcast(sketch)
    limit = float(np.median(sketch)) + FREQUENT

    def marks(ids: DataFrame) -> tuple:
        """(broadcast bitmap of the distinct ids, its bytes): which ids they are reaches a scan in a fixed size; it may let others through."""
        mark_bytes = min(MARK_BYTES[1], max(MARK_BYTES[0], 1 << (2 * ids.count()).bit_length()))
        bitmap = _gathered(ids.mapInPandas(_mark(mark_bytes), "part int, group int, data binary"), _united, np.uint8, mark_bytes // SKETCH_PARTS)
        return spark.sparkContext.broadcast(bitmap), mark_bytes

    # Equal sets are one member: that of the smallest id. Rows that repeat an id stay together.
    firsts = stash(sets.where("n > 0 AND id IS NOT NULL").groupBy("s1", "s2").agg(F.min("id").alias("first")), "firsts")
    # Only members are indexed: keys of copies would all be shared. One that the bitmap lets through is one more member, compared like any other.
    members_marked, members_bytes = marks(firsts.select(F.col("first").alias("id")).distinct())

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, counts = WordHashes(), shared.value
        for pdf in batches:
            seen, found = set(), []
            pdf = pdf[is_marked(pdf["id"].to_numpy().astype(np.int64), members_marked.value, members_bytes)]
            for key, text in sorted(zip(pdf["id"].astype("int64"), pdf["text"]), key=lambda x: x[0]):
                tokens = shingle_set(memo, text, size)
                # Fewer tokens allow no link but between equal sets; equal sets of a batch are indexed once, by the smallest id.
                if len(tokens) * (100 - percent) < percent or (digest := xxhash.xxh3_128_digest(tokens.tobytes())) in seen:
                    continue
                seen.add(digest)
                found.append((key, len(tokens), *index_keys(tokens, counts[bucket_of(tokens, bits)], limit, percent)))
            each = [len(x[2]) for x in found]
            joined = lambda i, kind: np.concatenate([np.zeros(0, kind), *[x[i] for x in found]])
            ids, sizes, rare = (np.array([x[i] for x in found], np.int64) for i in (0, 1, 4))
            yield pd.DataFrame({"key": signed(joined(2, np.uint64)), "id": np.repeat(ids, each), "bound": joined(3, np.int64)})
            # One row for each document holds the sizes of its set and of its rare prefix, below zero.
            yield pd.DataFrame({"key": signed(mixed(ids.view(np.uint64))), "id": ids, "bound": -1 - ((sizes << 31) | rare)})

    indexed = rows.where("id IS NOT NULL AND text IS NOT NULL").mapInPandas(index, "key long, id long, bound long")
    of_key = Window.partitionBy("key")
    other = F.max("id").over(of_key) != F.min("id").over(of_key)
    shared_keys = stash(indexed.withColumn("other", other).where("other OR bound < 0").drop("other"), "shared-keys")
    packed = -1 - F.col("bound")
    sizes = shared_keys.where("bound < 0").select("id", F.shiftright(packed, 31).cast("int").alias("n"), packed.bitwiseAND(0x7FFFFFFF).cast("int").alias("rare"))
    longest = F.expr(f"n - ceil(n * {percent} / 100) + 1 + CASE WHEN n >= {LARGE_FROM} THEN {CLASSES} ELSE 1 END")  # as index_keys has it
    profiles = stash(sizes.withColumn("often", (F.least("n", longest) - F.col("rare")).cast("int")).distinct(), "profiles")

    def shared_only(found: DataFrame, before: DataFrame) -> DataFrame:
        """Rows of keys that two documents still have; the table that they come from goes."""
        kept = stash(found.withColumn("other", other).where("other").drop("other"), "buckets")
        drop_stash(before)
        return kept

    buckets = shared_only(shared_keys.where("bound >= 0"), shared_keys)
    # Partners share CLASSES + 1 tokens of their prefixes, small ones two; as many of them are rare as neither has frequent ones.
    need = F.when(F.col("n") > small_to(percent), CLASSES + 1).otherwise(2) - F.col("often")
    size_before = buckets.count()
    while size_before:
        # A document with fewer shared rare tokens than that has no partner, and leaves its buckets.
        singles = buckets.groupBy("id").agg(F.count_if(F.col("bound") > 0).alias("singles"))
        enough = stash(singles.join(profiles, "id").where(F.col("singles") >= need).select("id").distinct(), "enough")
        buckets = shared_only(buckets.join(enough, "id").select("key", "id", "bound"), buckets)
        drop_stash(enough)
        size_now = buckets.count()
        if size_now > 0.9 * size_before:
            break
        size_before = size_now
    left = buckets
    buckets = buckets.join(profiles, "id")

    # The member with fewest tokens of its own is likeliest to be what the others were copied from.
    head = F.min(F.struct("rare", "id", "n", "often", "bound")).over(of_key)
    buckets = stash(buckets.withColumn("p", head).select(*buckets.columns, "p"), "buckets")
    drop_stash(left)
    drop_stash(profiles)

    def shared_enough(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, and n, often, bound of both, a row for each bucket) that meet in enough rare tokens and whose first one allows a link."""
        fits = F.expr(f"bounda > 0 AND boundb > 0 AND {100 + percent} * least(bounda, boundb) >= {percent} * (na + nb)") | F.expr("bounda = 0 OR boundb = 0")
        counted = pairs.groupBy("a", "b", "na", "nb", "oftena", "oftenb").agg(F.count_if(F.col("bounda") > 0).alias("r"), F.bool_or(fits).alias("fits"))
        # Of the set whose prefix ends first, a token that isn't shared there isn't shared at all. Prefixes leave
        # out all but CLASSES + 1 tokens of the smallest overlap, so partners of like size share more than those.
        overlap = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent) - 1e-9) - F.ceil(percent * F.greatest("na", "nb") / 100 - 1e-9)
        least = F.when(F.least("na", "nb") >= LARGE_FROM, CLASSES + 1 + F.greatest(F.lit(0), overlap)).otherwise(2) - F.least("oftena", "oftenb")
        return counted.where(F.col("fits") & (F.col("r") >= least)).select("a", "b")

    # Sets of the documents that are left in buckets. What the bitmap lets through besides are sets that nobody asks for.
    marked, mark_bytes = marks(buckets.select("id").distinct())

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for pdf in batches:
            ids = pdf["id"].to_numpy().astype(np.int64)
            wanted = is_marked(ids, marked.value, mark_bytes)
            found = [shingle_set(memo, t, size) for t in pdf["text"][wanted]]
            yield pd.DataFrame({"id": ids[wanted], "tokens": pd.Series([signed(x) for x in found], dtype=object), "bins": pd.Series([bin_counts(x) for x in found], dtype=object)})

    tokens = stash(rows.where("id IS NOT NULL AND text IS NOT NULL").mapInPandas(to_sets, "id long, tokens array<long>, bins binary"), "tokens")

    def with_sets(rows: DataFrame, of: str, name: str, column: str = "tokens") -> DataFrame:
        """``rows`` with the set of the document ``of``. Only sets that are asked for move; none does where ``rows`` are few enough for Spark to broadcast."""
        return rows.join(tokens.select(F.col("id").alias(of), F.col(column).alias(name)), of)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link: first by what their counts of tokens in bins allow, which is little to move, then on whole sets."""
        counted = with_sets(with_sets(pairs.select("a", "b"), "a", "ba", "bins"), "b", "bb", "bins").withColumn("m", most_common("ba", "bb"))
        pairs = stash(counted.where(f"{100 + percent} * m.common >= {percent} * m.both").select("a", "b").distinct(), "pairs")
        others = with_sets(stash(pairs.select("b").distinct(), "asked"), "b", "tb")
        common = F.size(F.array_intersect("ta", "tb"))
        met = with_sets(pairs, "a", "ta").join(others, "b")
        return met.where(100 * common >= percent * (F.size("ta") + F.size("tb") - common)).select("a", "b").distinct()

    def close(one: str, two: str) -> str:
        return f"100 * least({one}, {two}) >= {percent} * greatest({one}, {two})"

    same = sets.where("n > 0 AND id IS NOT NULL").join(firsts, ["s1", "s2"]).where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    sides = lambda one, two: [F.col(f"{x}{c}").alias(f"{c}{i}" if c != "id" else i) for x, i in ((one, "a"), (two, "b")) for c in ("id", "n", "often", "bound")]
    pivots = shared_enough(buckets.where(f"id <> p.id AND {close('n', 'p.n')}").select(*sides("", "p.")))
    edges = stash(same.unionByName(verified(pivots)), "edges")
    found = stash(components(edges), "components")

    def met(one: DataFrame, two: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
        """Every pair of a row of ``one`` and a row of ``two`` that lie in different components and are of like size: x_ and y_ of each column."""
        left, right = (rows.select(*keys, *[F.col(c).alias(f"{i}_{c}") for c in ("id", "n", "c", *columns)]) for rows, i in ((one, "x"), (two, "y")))
        return left.join(right, keys).where(f"x_c <> y_c AND {close('x_n', 'y_n')}")

    def sized(members: DataFrame, keys: list[str]) -> DataFrame:
        """The members of each key that lies in two components or more, with its largest component and whether its pairs are too many to list."""
        parts = members.groupBy(*keys, "c").agg(F.count("*").alias("m"))
        per_key = parts.groupBy(*keys).agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("own"), F.max(F.struct("m", "c")).alias("main"))
        apart = per_key.where("m * m > own").select(*keys, F.col("main.c").alias("main"), (F.col("m") * F.col("m") - F.col("own") > 2 * PAIRS_A_MEMBER * F.col("m")).alias("large"))
        return stash(members.join(stash(apart, "apart"), keys), "sized")

    def of_two(x: str, y: str, columns: list[str]) -> list:
        """a, b and na, nb … of a pair whose smaller id comes first."""
        swap = F.col(f"{x}id") > F.col(f"{y}id")
        named = lambda c, i: i if c == "id" else f"{c}{i}"
        return [F.when(swap, F.col(f"{q}{c}")).otherwise(F.col(f"{o}{c}")).alias(named(c, i)) for c in ("id", *columns) for o, q, i in ((x, y, "a"), (y, x, "b"))]

    def listed(members: DataFrame) -> DataFrame:
        """Pairs of buckets that are small enough: those outside a bucket's largest component with everyone else."""
        pairs = met(members.where("c <> main"), members, ["key"], ["often", "bound", "main"]).where("y_c = y_main OR x_id < y_id")
        return shared_enough(pairs.select(*of_two("x_", "y_", ["n", "often", "bound"])))

    def hub_pairs(members: DataFrame, last: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(proven edges, pairs to verify, members of what is still too large) of the buckets ``members`` (key, id, rare, c).

        A bucket's hub stands for the set that most of its members have: that of the
        member with fewest rare tokens, mended by what more than half of the near
        members add or lack. With D tokens lacking and A added to a hub of P, let
        W be 100 D + percent A. Two members link if and only if they share differences in number
        (W + W' - (100 - percent) P) / (100 + percent), so where that is nothing, both link
        to the member of least W. Others share a difference within a prefix of theirs.
        """
        heads = members.groupBy("key").agg(F.min(F.struct("rare", "id")).getField("id").alias("p"))
        hub = stash(members.join(heads, "key").groupBy("p", "id", "c").agg(F.min("rare").alias("rare")), "hubs")
        cores = with_sets(stash(hub.select("p").distinct(), "heads"), "p", "core")
        sides = with_sets(hub, "id", "own").join(cores, "p")
        counted = stash(sides.select("p", "own", "core").mapInPandas(_differences(percent), "p long, token long").groupBy("p", "token").count(), "differences")
        most = counted.where("token IS NULL").select("p", F.col("count").alias("near"))
        fixes = counted.where("token IS NOT NULL").join(most, "p").where("2 * count > near").groupBy("p").agg(F.collect_list("token").alias("fix"))
        schema = "p long, id long, c long, n int, size int, common int, added int, lacking int, near boolean, tokens array<long>"
        written = sides.join(fixes, "p", "left").select("p", "id", "c", "own", "core", "fix").mapInPandas(_written_as_differences(percent, shared, bits), schema)
        weight = 100 * F.col("lacking") + percent * F.col("added")
        written = stash(written.withColumn("w", weight.cast("long")).withColumn("k", ((100 - percent) * F.col("size")).cast("long")), "written")
        least = written.groupBy("p").agg(F.min(F.struct("w", "id")).alias("q")).select("p", F.col("q.w").alias("wq"), F.col("q.id").alias("q"))
        ranked = written.join(stash(least, "least"), "p").withColumn("linked", F.expr("w + wq <= k"))
        proven = ranked.where("linked AND id <> q").select(F.col("id").alias("a"), F.col("q").alias("b"))
        # Shared differences at least, with any partner, and with one where either isn't linked.
        any_ = F.greatest(F.lit(1), F.ceil((F.col("w") - F.col("k")) / 100), F.ceil((F.col("w") + F.col("wq") - F.col("k")) / (100 + percent)))
        some = F.greatest(any_, F.ceil((F.col("w") - F.col("wq") + 1) / (100 + percent)))
        differences = F.col("added") + F.col("lacking")
        short = F.when(F.col("near"), F.greatest(F.col("added"), differences - some + 1)).otherwise(F.size("tokens"))
        long = F.when(F.col("near") & ~F.col("linked"), F.greatest(short, differences - any_ + 1)).otherwise(short)
        cut = ranked.withColumn("short", short.cast("int")).withColumn("tokens", F.slice("tokens", F.lit(1), long.cast("int")))
        columns = ["id", "n", "c", "k", "w", "common", "added", "lacking", "near", "linked"]
        places = stash(cut.select("p", *columns, "short", F.posexplode("tokens").alias("at", "token")).withColumn("beyond", F.col("at") >= F.col("short")).drop("short"), "places")
        # A place beyond the short prefix only meets short places of linked members.
        meets = sized(places.where("NOT beyond"), ["p", "token"])
        beyond = places.where("beyond")
        linked = places.where("NOT beyond AND linked")
        large = meets.where("false" if last else "large")
        small = meets if last else meets.where("NOT large")
        told = ["k", "w", "common", "added", "lacking", "near", "linked", "at"]
        pairs = met(small.where("c <> main"), small, ["p", "token"], [*told, "main"]).where("y_c = y_main OR x_id < y_id").drop("x_main", "y_main")
        pairs = pairs.unionByName(met(beyond, linked, ["p", "token"], told))
        left_over = "least(x_added + x_lacking - x_at, y_added + y_lacking - y_at)"
        both_near = f"NOT (x_near AND y_near) OR {100 + percent} * {left_over} >= x_w + y_w - x_k"
        overlap = f"x_at >= x_added OR {100 + percent} * (least(x_common, y_common) + least(x_added - x_at, y_added - y_at)) >= {percent} * (x_n + y_n)"
        asked = pairs.where(f"NOT (x_linked AND y_linked) AND ({both_near}) AND ({overlap})").select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
        again = large.join(hub.select("p", "id", "rare"), ["p", "id"]).select(F.xxhash64("p", "token").alias("key"), "id", "c", "rare")
        return proven, asked, again

    def with_components(members: DataFrame) -> DataFrame:
        return members.drop("c").join(found, F.col("id") == F.col("node"), "left").drop("node").withColumn("c", F.coalesce("component", "id")).drop("component")

    members = sized(with_components(buckets.drop("p")), ["key"])
    drop_stash(buckets)
    edges = stash(edges.unionByName(verified(listed(members.where("NOT large")))), "edges")
    hubs = members.where("large").select("key", "id", "c", "rare")
    for turn in range(HUB_ROUNDS):
        if hubs.isEmpty():
            break
        proven, asked, again = hub_pairs(hubs, turn == HUB_ROUNDS - 1)
        edges = stash(edges.unionByName(proven).unionByName(verified(asked)), "edges")
        if not again.isEmpty():
            found = stash(components(edges), "components")
            hubs = sized(with_components(again), ["key"]).select("key", "id", "c", "rare")
        else:
            break
    found = stash(components(edges), "components")

    out = sets.join(found, F.col("id") == F.col("node"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
