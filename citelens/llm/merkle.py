"""Merkle manifest of a dataset: every row a leaf, a subtree a group, one root; proofs and their verification for every row.

Method: sibling-shift self-joins.  At every level the nodes of a group stand at 0, 1, 2, ...; each asks for the places of its
siblings, which it computes (its own place XOR 1 in a binary tree, else its slot shifted around the run of ``arity``), and an
equijoin on (group, place) answers.  The row of slot zero then emits the run's parent.  The subroots, by group, are the leaves
of one more tree in the same way.  Downwards, each node's path (the digests left and right of it, level by level) is its own
siblings before its parent's path, so what the upper levels share crosses the network once a run and not once a leaf.

Plan: the texts are hashed where they are read, and only digests are shuffled.  Places come from range partitions and their
row counts, so a group with a third of all rows is spread like any other; the join keys are unique; levels are written to the
shared folder.  The driver holds level counts and the root.

Defined results: H is lowercase hex SHA-256 of its inputs one after the other.  A field is ``-`` if null, else its UTF-8 byte
count, ``:`` and its value.  Rows without an order value come first in their group; equal leaves of one place take places in
any order, which gives the same digests; a null group is a group of its own and the first.  A lone leaf is its group's
subroot, a lone subroot the root; a row without any sibling has the proof of no digests.  An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelens.llm.shared import cut, stored

ROWS_PER_RANGE = 100_000


def digest(*fields: Column) -> Column:
    """H of fields, each as ``-`` or byte count, colon and value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def group_key(group: Column) -> Column:
    """A text that orders as the group does, null first, bytewise, and is never null."""
    text = group.cast("string")
    return F.when(text.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), text))


def numbered(rows: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """rows (group_key, order, ...) with at, the place in the group from 0, and n, the group's rows."""
    tied = rows.withColumn("tie", F.monotonically_increasing_id())  # parts equal rows, so that they need not share a range
    ranges = max(1, -(-rows.count() // rows_per_range))
    placed = cut(tied.repartitionByRange(ranges, "group_key", "order", "tie").withColumn("range", F.spark_partition_id()))
    counts = placed.groupBy("group_key", "range").agg(F.count("*").alias("rows"))
    whole = Window.partitionBy("group_key")
    counts = counts.select("group_key", "range", F.sum("rows").over(whole).alias("n"), (F.sum("rows").over(whole.orderBy("range")) - F.col("rows")).alias("before"))
    within = F.row_number().over(Window.partitionBy("range", "group_key").orderBy("order", "tie"))
    joined = placed.withColumn("within", within).join(counts, ["range", "group_key"])
    return joined.withColumn("at", F.col("before") + F.col("within") - 1).drop("tie", "range", "before", "within", "order")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (group_key, at, n, node, ...) with left and right, the digests of the run's others on either side, joined in order."""
    slot = F.col("at") % arity
    if arity == 2:
        asks = nodes.select("group_key", "at", F.col("at").bitwiseXOR(F.lit(1)).alias("sibling"))
    else:
        shift = F.explode(F.sequence(F.lit(1), F.lit(arity - 1)))
        asks = nodes.select("group_key", "at", "n", shift.alias("shift")).select("group_key", "at", "n", (F.col("at") - slot + (slot + F.col("shift")) % arity).alias("sibling")).filter("sibling < n").drop("n")
    answers = asks.join(nodes.select("group_key", F.col("at").alias("sibling"), F.col("node").alias("other")), ["group_key", "sibling"])
    sides = answers.groupBy("group_key", "at").agg(F.sort_array(F.collect_list(F.struct("sibling", "other"))).alias("others"))
    joined = nodes.join(sides, ["group_key", "at"], "left")
    part = lambda keep: F.coalesce(F.array_join(F.transform(F.filter("others", keep), lambda x: x["other"]), ""), F.lit(""))
    return joined.withColumn("left", part(lambda x: x["sibling"] < F.col("at"))).withColumn("right", part(lambda x: x["sibling"] > F.col("at"))).drop("others")


def climb(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """(levels, tops): for each level its nodes with left and right (nodes alone in their group are no level's), and the top of
    each group (group_key, node)."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, tops, nodes = [], None, leaves
    while True:
        done = nodes.filter("n = 1").select("group_key", "node")
        tops = done if tops is None else tops.unionByName(done)
        if most <= 1:
            return levels, cut(tops)
        level = stored(with_siblings(nodes.filter("n > 1"), arity))
        levels.append(level)
        parent = F.sha2(F.concat("left", "node", "right"), 256)
        nodes = level.filter(F.col("at") % arity == 0).select("group_key", F.floor(F.col("at") / arity).alias("at"), F.ceil(F.col("n") / arity).alias("n"), parent.alias("node"))
        most = -(-most // arity)


def descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """leaves with top and path, an array of (left, right) from the leaf up; tops has (group_key, top, path) and gives each
    group the path on from its top."""
    step, known = F.array(F.struct("left", "right")), None
    found = leaves.filter("n = 1").join(tops, "group_key")
    for height in reversed(range(len(levels))):
        level = levels[height].withColumn("run", F.floor(F.col("at") / arity))
        paths = level.filter(F.col("n") <= arity).join(tops, "group_key")
        if known is not None:
            paths = paths.unionByName(level.filter(F.col("n") > arity).join(known, ["group_key", "run"]))
        paths = paths.withColumn("path", F.concat(step, "path")).drop("left", "right", "run")
        if height:
            known = cut(paths.select("group_key", F.col("at").alias("run"), "top", "path"))
        else:
            found = found.unionByName(paths)
    return found


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def proof(path: Column) -> Column:
    """H of the path's digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def manifest(leaves: DataFrame, arity: int = 8) -> DataFrame:
    """leaves (group_key, order, node, ...) with subroot, root and path (left, right) of each; group_key and order as given by
    group_key() and by what orders a group's rows.  Other columns pass through."""
    first = stored(numbered(leaves))
    levels, tops = climb(first, arity)
    groups = cut(numbered(tops.select(F.lit("").alias("group_key"), F.col("group_key").alias("order"), F.col("group_key").alias("key"), "node")))
    upper, crown = climb(groups, arity)
    root = crown.first()
    if root is None:
        path = F.array().cast("array<struct<left:string,right:string>>")
        return first.drop("at", "n").withColumn("subroot", F.lit(None).cast("string")).withColumn("root", F.lit(None).cast("string")).withColumn("path", path)
    start = crown.select("group_key", F.col("node").alias("top"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    paths = descend(groups, upper, start, arity)
    above = cut(paths.select(F.col("key").alias("group_key"), F.col("node").alias("top"), "path"))
    found = descend(first, levels, above, arity)
    return found.drop("at", "n").withColumnRenamed("top", "subroot").withColumn("root", F.lit(root["node"]))
