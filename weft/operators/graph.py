"""Graph operators as loops of joins; every round is written to the shared folder, so lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.numbering import numbered
from weft.operators.tables import forget, saved, unsent


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` saved, and ``old``, which it was computed from, removed."""
    kept = saved(new)
    forget(old)
    return kept


def ends_trimmed(edges: DataFrame) -> DataFrame:
    """The edges (src, dst) that are left when nodes without an edge in, or without one out, are removed again and again."""
    left = saved(edges)
    n = left.count()
    while n:
        kept = left.join(unsent(left.select(F.col("dst").alias("src")).distinct()), "src", "left_semi").join(unsent(left.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi")
        left = replaced(left, kept.select("src", "dst"))
        more = left.count()
        if more == n:
            break
        n = more
    return left


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component, size of every cycle of more than one node (G03), named by its smallest node.

    Colours run forward: each node takes the smallest node that reaches it. What of a
    colour reaches its smallest node again is a component; the rest goes on without it.
    No table grows beyond the edges. Self-loops and null ends take no part.
    """
    left = ends_trimmed(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct())
    none = left.select(F.col("src").alias("node"), F.col("src").alias("component")).where("false")
    found = none
    while not left.isEmpty():
        colour = saved(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            near = left.join(unsent(colour.withColumnRenamed("node", "src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("near"))
            lower = colour.join(unsent(near), "node", "left").select("node", F.col("colour").alias("old"), F.least("colour", F.coalesce("near", "colour")).alias("low"))
            # What reaches the node of one's colour reaches oneself.
            jump = lower.join(unsent(colour.select(F.col("node").alias("low"), F.col("colour").alias("lower"))), "low").select("node", "old", F.least("low", "lower").alias("colour"))
            after = saved(jump)
            forget(colour)
            colour = after.select("node", "colour")
            if after.where("old <> colour").isEmpty():
                break
        inner = saved(left.join(unsent(colour.select(F.col("node").alias("src"), "colour")), "src").join(unsent(colour.select(F.col("node").alias("dst"), F.col("colour").alias("own"))), "dst").where("colour = own").select("src", "dst", "colour"))
        member = saved(colour.where("node = colour"))
        frontier = member
        while True:
            before = inner.join(unsent(frontier.select(F.col("node").alias("dst"))), "dst").select(F.col("src").alias("node"), "colour").distinct().join(unsent(member.select("node")), "node", "left_anti")
            frontier = saved(before)
            if frontier.isEmpty():
                break
            member = saved(member.unionByName(frontier))
        found = saved(found.unionByName(member.select("node", F.col("colour").alias("component"))))
        open_ = left.join(unsent(member.select(F.col("node").alias("src"))), "src", "left_anti").join(unsent(member.select(F.col("node").alias("dst"))), "dst", "left_anti")
        left = ends_trimmed(open_.select("src", "dst"))
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return found.join(unsent(sizes), "component").select("node", "component", "size")


def shortest_depths(roots: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """node, depth, root: the fewest edges from any root, and the smallest root at that depth (G04, G06). ``most`` bounds the depth where the report does."""
    frontier = saved(roots.select(F.col("node"), F.lit(0).alias("depth"), F.col("node").alias("root")).distinct())
    seen, depth = frontier, 0
    while most is None or depth < most:
        depth += 1
        next_ = frontier.join(edges.select(F.col("src").alias("node"), "dst"), "node").groupBy("dst").agg(F.min("root").alias("root"))
        next_ = next_.select(F.col("dst").alias("node"), F.lit(depth).alias("depth"), "root").join(seen.select("node"), "node", "left_anti")
        frontier = saved(next_)
        if frontier.isEmpty():
            break
        seen = saved(seen.unionByName(frontier))
    return seen


def groups(pairs: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, group: connected components of the pairs (a, b), named by their smallest node.

    Every node takes the smallest label around it and then the label of that label, until
    nothing changes: the second step halves long chains, so rounds grow with the logarithm of a chain.
    Minima are pre-aggregated in the map tasks, and labels are joined from a written table, so
    that Spark can split the partition of a node with very many neighbours. No task
    gathers a component. A pair with a null end takes no part; a node paired with itself is a group.
    """
    kept = pairs.where("a IS NOT NULL AND b IS NOT NULL")
    both = saved(kept.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*").distinct())
    label = saved(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("group")))
    for _ in range(most_rounds):
        if label.isEmpty():
            break
        around = both.join(label.select(F.col("node").alias("other"), F.col("group").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        lower = label.join(around, "node").select("node", F.col("group").alias("old"), F.least("group", "near").alias("low"))
        further = lower.join(label.select(F.col("node").alias("low"), F.col("group").alias("lower")), "low")
        after = replaced(label, further.select("node", "old", F.least("low", "lower").alias("group")))
        label = after.select("node", "group")
        if after.where("old <> group").isEmpty():
            break
    else:
        raise RuntimeError(f"groups did not settle in {most_rounds} rounds")
    forget(both)
    return label


def topological(edges: DataFrame) -> DataFrame:
    """node, level: needs before dependants (F07, G08); nodes of a cycle, and those behind one, have a null level.

    ``edges``: src needs dst. A level is the longest chain of needs below a node; there is one round for each level.
    """
    rows = saved(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    needs = rows.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("needs"))
    nodes = rows.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    rest = saved(nodes.join(needs, "node", "left").select("node", F.coalesce("needs", F.lit(0)).alias("needs")))
    done, level = [], 0
    while not (ready := rest.where("needs = 0").select("node")).isEmpty():
        done.append(ready.withColumn("level", F.lit(level)))
        met = rows.join(ready.select(F.col("node").alias("dst")), "dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("met"))
        rest = saved(rest.where("needs > 0").join(met, "node", "left").select("node", (F.col("needs") - F.coalesce("met", F.lit(0))).alias("needs")))
        level += 1
        if level % 50 == 0:  # one table again, so that a long chain isn't a union of thousands
            done = [saved(_union(done))]
    return _union([*done, rest.select("node", F.lit(None).cast("int").alias("level"))])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def late_states(states: DataFrame, needs: DataFrame) -> DataFrame:
    """node, state: a fresh node is stale when anything it needs, near or far, isn't fresh (G11): a walk from those towards what needs them."""
    seen = frontier = saved(states.where("state <> 'fresh'").select("node").distinct())
    rows = saved(needs.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    while not frontier.isEmpty():
        frontier = saved(rows.join(frontier.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = saved(seen.unionByName(frontier))
    return states.join(seen.withColumn("late", F.lit(True)), "node", "left").select("node", F.when((F.col("state") == "fresh") & F.col("late"), "stale").otherwise(F.col("state")).alias("state"))


def run_plan(states: DataFrame, named: DataFrame, levels: DataFrame) -> DataFrame:
    """Steps to run, in order: the named ones and everything stale."""
    wanted = states.where("state <> 'fresh'").select("node").unionByName(named.select("node")).distinct()
    return numbered(wanted.join(levels, "node").select("node", "level"), ("level", "node"), "step").select("node", "step")


def labelled_paths(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: one row for each path from a root, labels joined along it.

    ``roots``: node, label; ``edges``: src, dst, label. A path that would come to one of its own nodes again
    ends before it, so cycles end by themselves. There is one round for each edge of the longest path, and as many rows as paths:
    a node that is reached in several ways has several. Nodes are strings; null ends take no part.
    """
    steps = saved(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", F.coalesce("label", F.lit("")).alias("step")))
    reached = frontier = saved(roots.select("node", F.coalesce("label", F.lit("")).alias("label"), F.array("node").alias("past")))
    while True:
        further = frontier.join(unsent(steps), F.col("node") == F.col("src")).where(~F.array_contains("past", F.col("dst")))
        frontier = saved(further.select(F.col("dst").alias("node"), F.concat("label", "step").alias("label"), F.concat("past", F.array("dst")).alias("past")))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached.select("node", "label")
