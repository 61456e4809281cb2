"""Conversation repair: audits against a search over all edits, blocks of every size, odd rows, and the query against a plain one."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import catalog
from weft.llm import conversation_repair as cr

GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAMES = {"u": "user", "a": "assistant"}


def plain_repair(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired of (turn, role, text) in order: Dijkstra by cost and then audit."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        ended = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("b" if not ended else "d" if (role, text) in seen else "t" if ended[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    queue, done = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, i, q, out = heapq.heappop(queue)
        if i == len(rows) and q in (0, 3):
            break
        if (i, q) in done:
            continue
        done.add((i, q))
        for r in "ua":
            if (q, r) in GRAMMAR:
                heapq.heappush(queue, (cost + 2, audit + "I", i, GRAMMAR[q, r], (*out, f"{NAMES[r]}:")))
        if i < len(rows):
            _, role, text = rows[i]
            cut = faults[i] == "t"
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, q, out))
            if faults[i] not in ("b", "d"):
                if (q, role[:1]) in GRAMMAR:
                    heapq.heappush(queue, (cost + cut, audit + "K", i + 1, GRAMMAR[q, role[:1]], (*out, f"{role}:{text}")))
                for r in "ua":
                    if (q, r) in GRAMMAR:
                        heapq.heappush(queue, (cost + 2 + cut, audit + "R", i + 1, GRAMMAR[q, r], (*out, f"{NAMES[r]}:{text}")))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, "\n".join(out)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def some_rows(rng, n):
    texts = ["Hi.", "Hi", "Yes!", "no", "", " \n", "Why? ", "ok.\t", "Zoé…", " "]
    roles = ["user", "assistant", "system", "tool", " ", "user", "assistant"]
    return [(rng.choice([None, rng.randint(0, n), rng.randint(0, n)]), rng.choice(roles), rng.choice(texts) + (rng.choice(["", f"{rng.randint(0, n)}."]))) for _ in range(n)]


def test_blocks_and_their_tree_give_the_least_path():
    rng = random.Random(3)
    for _ in range(300):
        block = "".join(rng.choice(cr.CLASSES) for _ in range(rng.randint(1, 9)))
        rows = [(i, {"s": "system", "u": "user", "a": "assistant", "o": "tool"}.get(c.lower(), "x"), "" if c == "x" else f"{i}" + ("" if c.isupper() else ".")) for i, c in enumerate(block)]
        solved = cr.Solved([block], np.array([cr.LAST]))
        assert (int(solved.cost[0, 0]), solved.audits(np.array([0]))[0]) == plain_repair(rows)[5:7], block


@pytest.mark.parametrize("block_bits, group_bits", [(1, 1), (3, 2), (12, 10)])
def test_repair_equals_the_search(spark, block_bits, group_bits):
    rng = random.Random(block_bits)
    convs = {i: some_rows(rng, n) for i, n in enumerate([1, 1, 2, 3, 4, 5, 8, 13, 40, 200])} | {None: some_rows(rng, 30), -7: [(4, "user", "Same.")] * 90}
    data = [(c, *r, 1) for c, rows in convs.items() for r in rows]
    df = spark.createDataFrame(data, "conv_id long, turn int, role string, text string, node int").select("*", F.lit(1).alias("conv"), F.lit(2).alias("seq"), F.lit("x").alias("audit"))
    report, repaired = cr.repair(df.repartition(5), block_bits=block_bits, group_bits=group_bits)
    got = {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in report.collect()}
    want = {c: plain_repair(in_order(rows)) for c, rows in convs.items()}
    assert got == {c: x[:7] for c, x in want.items()}
    hashes = {r.conv: r.repaired_sha256 for r in cr.digests(repaired).collect()}
    assert hashes == {c: hashlib.sha256(x[7].encode()).hexdigest() for c, x in want.items() if x[7]}
    empty, none = cr.repair(df.where("false"))
    assert empty.count() == 0 and none.count() == 0


def test_the_query_equals_a_plain_one(spark, tmp_path):
    rng = random.Random(8)
    data = [(c, *r) for c in [*range(120), None] for r in some_rows(rng, rng.randint(1, 9))]
    data += [(500, None, None, None), (501, 0, None, "x."), (502, 3, "user", None)]
    spark.createDataFrame(data, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want, damaged = {}, {}
    for c, t, role, text in data:
        role, text = role if role is not None else " ", text if text is not None else " "
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
        damaged.setdefault(c, [])
        damaged[c] += [(t, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    for c, rows in damaged.items():
        *numbers, audit, out = plain_repair(in_order(rows))
        want[c] = (*numbers, audit, hashlib.sha256(out.encode()).hexdigest())
    got = catalog.op12_conversations(spark, str(tmp_path)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert any(not rows for rows in damaged.values())
