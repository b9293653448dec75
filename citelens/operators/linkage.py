"""Ward's merge tree of all rows by reciprocal nearest neighbours, its cut into clusters, and the tree of those clusters.

In every round each group that is the nearest of its own nearest merges with it.  Ward's measure never makes a merged group nearer
to a third than the nearer of its parts was, so the merges are those of the plain loop that takes the least cost first.  Nearest
groups follow one order of pairs (cost, then a hash of the pair), so that many equal distances still bring many merges a round.

Plan: groups are (node, size, height, centre).  Only groups that are new, or whose nearest has merged, are measured again, in
tasks of two blocks of an eighth of them, ``width`` at least and MOST at most; every task gives the best of either side, from tiles of ``TILE``.
So a round shuffles the groups sixteen times, up to 8 * MOST of them.  Rounds go on from the shared
folder, as tables (a checkpoint's inferred constraints double with every round).  The last ``width`` groups are merged in one task.  Work is rows squared, as of any exact tree.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citelens.sources.tables import cut, shared_folder, stored

GROUP = "node long, size double, height double, centre array<double>"
NEAREST = "node long, other long, cost double, tie long"
MERGE = "left long, right long, node long, height double, size double"
NAMES = 1 << 40  # a merged group is named round * NAMES + its least leaf
WIDTH = 1000
CHUNK = 100_000  # pairs measured at once
TILE, MOST = 1000, 131_072


def numbered(rows: DataFrame, *order, name: str = "number") -> DataFrame:
    """rows with places from 0 in the given order, found by a range sort and the sizes of its partitions."""
    placed = cut(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), "_part").withColumn(name, place).drop("_at", "_part", "_before")


def _ties(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair, whichever way round."""
    with np.errstate(over="ignore"):
        h = np.minimum(a, b).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.maximum(a, b).astype(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = table.column("node").to_numpy()
    flat = table.column("centre").combine_chunks().flatten().to_numpy()
    return ids, table.column("size").to_numpy(), flat.reshape(len(ids), -1)


def _measure(left: pa.Table, right: pa.Table) -> pa.Table:
    """NEAREST of both sides: the best of the other side for each group, a tile of pairs at a time."""
    schema = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("cost", pa.float64()), ("tie", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    one, two, found, waiting = _block(left), _block(right), [], 0
    for i in range(0, len(one[0]), TILE):
        for j in range(0, len(two[0]), TILE):
            found.append(_tile([c[i : i + TILE] for c in one], [c[j : j + TILE] for c in two]))
            waiting += len(found[-1][0])
            if waiting > 2 * (len(one[0]) + len(two[0])) + CHUNK:
                found = [_best(found)]
                waiting = len(found[0][0])
    return pa.table(_best(found), schema=schema)


def _best(found: list) -> list[np.ndarray]:
    """The least of each node of lists of (node, other, cost, tie)."""
    node, other, cost, tie = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((other, tie, cost, node))
    first = order[np.r_[True, node[order][1:] != node[order][:-1]]] if len(order) else order
    return [node[first], other[first], cost[first], tie[first]]


def _tile(left: list[np.ndarray], right: list[np.ndarray]) -> list[np.ndarray]:
    """The best of the other side for each group.  A matrix product leaves few pairs to measure exactly."""
    (a, p, x), (b, q, y) = left, right
    weight = p[:, None] * q[None, :] / (p[:, None] + q[None, :])
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    rough, slack = weight * (squares - 2.0 * (x @ y.T)), 1e-9 * weight * squares
    rough[a[:, None] == b[None, :]] = np.inf
    low, high = rough - slack, rough + slack
    i, j = np.nonzero(np.isfinite(rough) & ((low <= high.min(axis=1)[:, None]) | (low <= high.min(axis=0)[None, :])))
    cost = np.empty(len(i))
    for at in range(0, len(i), CHUNK):
        s, t = i[at : at + CHUNK], j[at : at + CHUNK]
        cost[at : at + CHUNK] = weight[s, t] * ((x[s] - y[t]) ** 2).sum(axis=1)
    tie = _ties(a[i], b[j])
    return _best([(np.concatenate([a[i], b[j]]), np.concatenate([b[j], a[i]]), np.concatenate([cost, cost]), np.concatenate([tie, tie]))])


def _searched(asking: DataFrame, asked: int, groups: DataFrame, n: int, width: int) -> DataFrame:
    """NEAREST of the asking groups among all, and of all among the asking: a pair of blocks is one task."""
    wide = max(width, min(-(-n // 8), MOST))
    rows, columns = -(-asked // wide), -(-n // wide)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block = lambda m: F.pmod(F.xxhash64("node"), F.lit(m)).cast("int")
    left = asking.select("node", "size", "centre", block(rows).alias("r")).withColumn("c", every(columns))
    own = (F.col(c).alias(c) for c in ("node", "size", "centre"))  # columns of their own: the asking may be all groups
    right = groups.select(*own, block(columns).alias("c")).withColumn("r", every(rows))
    return left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(_measure, NEAREST)


def _finish(turn: int):
    """The merges of at most ``width`` groups, least cost first."""

    def merge(table: pa.Table) -> pa.Table:
        node, size, x = _block(table)
        order = np.argsort(node)
        node, size, x = node[order].copy(), size[order].copy(), x[order].copy()
        height = table.column("height").to_numpy()[order].copy()
        merges, open_ = [], np.ones(len(node), bool)

        def costs(i):
            d = size[i] * size / (size[i] + size) * ((x - x[i]) ** 2).sum(axis=1)
            d[~open_] = np.inf
            d[i] = np.inf
            return d

        cost = np.stack([costs(i) for i in range(len(node))])
        for step in range(len(node) - 1):
            i, j = np.unravel_index(int(cost.argmin()), cost.shape)
            top = max(np.sqrt(2.0 * cost[i, j]), height[i], height[j])
            name = (turn + step) * NAMES + min(node[i] % NAMES, node[j] % NAMES)
            merges.append((node[i], node[j], name, top, size[i] + size[j]))
            x[i] = (size[i] * x[i] + size[j] * x[j]) / (size[i] + size[j])
            size[i], height[i], node[i], open_[j] = size[i] + size[j], top, name, False
            cost[j, :] = cost[:, j] = np.inf
            cost[i, :] = cost[:, i] = costs(i)
        columns = list(zip(*merges)) if merges else [()] * 5
        names = ("left", "right", "node", "height", "size")
        return pa.table({n: pa.array(np.asarray(c), pa.int64() if n in ("left", "right", "node") else pa.float64()) for n, c in zip(names, columns, strict=True)})

    return merge


def _named_merges(groups: DataFrame, width: int) -> DataFrame:
    """MERGE of groups (GROUP) with passing names."""
    spark, path, turn = groups.sparkSession, f"{shared_folder(groups.sparkSession)}/merges-{uuid.uuid4().hex}", 0
    groups = cut(groups)
    n, best = groups.count(), None
    spark.createDataFrame([], MERGE).write.parquet(f"{path}/round=0")
    while n > width:
        turn += 1
        asking, asked = (groups, n) if best is None else (groups.join(best.select("node"), "node", "left_anti"), None)
        found = _searched(asking, asking.count() if asked is None else asked, groups, n, width)
        both = found if best is None else best.unionByName(found)
        best = stored(both.groupBy("node").agg(F.min(F.struct("cost", "tie", "other")).alias("_b")).select("node", "_b.other", "_b.cost", "_b.tie"))
        mutual = best.join(best.select(F.col("other").alias("node"), F.col("node").alias("other")), ["node", "other"]).filter("node < other")
        side = lambda key, mark: groups.select(F.col("node").alias(key), *(F.col(c).alias(mark + c) for c in ("size", "height", "centre")))  # noqa: B023, E731
        met = mutual.join(side("node", "a_"), "node").join(side("other", "b_"), "other")
        size = F.col("a_size") + F.col("b_size")
        centre = F.zip_with("a_centre", "b_centre", lambda u, v: (F.col("a_size") * u + F.col("b_size") * v) / (F.col("a_size") + F.col("b_size")))
        name = F.lit(turn * NAMES) + F.least(F.col("node") % NAMES, F.col("other") % NAMES)
        height = F.greatest(F.sqrt(2 * F.col("cost")), "a_height", "b_height")
        merged = stored(met.select(F.col("node").alias("left"), F.col("other").alias("right"), name.alias("node"), height.alias("height"), size.alias("size"), centre.alias("centre")))
        merged.drop("centre").write.mode("overwrite").parquet(f"{path}/round={turn}")
        gone = merged.select(F.explode(F.array("left", "right")).alias("node"))
        groups = stored(groups.join(gone, "node", "left_anti").unionByName(merged.select("node", "size", "height", "centre")))
        best = best.join(gone, "node", "left_anti").join(gone.withColumnRenamed("node", "other"), "other", "left_anti").select("node", "other", "cost", "tie")
        n = groups.count()
    groups.groupBy().applyInArrow(_finish(turn + 1), MERGE).write.mode("overwrite").parquet(f"{path}/round={turn + 1}")
    return spark.read.schema(f"{MERGE}, round int").parquet(path).drop("round")


def weighted_tree(leaves: DataFrame, n: int, width: int = WIDTH) -> DataFrame:
    """MERGE of leaves (leaf from 0, size, centre): node n + i is the i-th merge by height, left the child of the smaller number."""
    named = _named_merges(leaves.select(F.col("leaf").alias("node"), F.col("size").cast("double").alias("size"), F.lit(0.0).alias("height"), "centre"), width)
    placed = numbered(named, "height", "node").withColumn("to", F.col("number") + n)
    names = placed.select(F.col("node").alias("name"), F.col("to"))
    final = lambda df, c: df.join(names.select(F.col("name").alias(c), F.col("to").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    told = final(final(placed.drop("node", "number"), "left"), "right")
    return cut(told.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), F.col("to").alias("node"), "height", "size"))


def merge_tree(rows: DataFrame, key: tuple[str, ...] = ("id",), vector: str = "embedding", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """((key..., leaf), (left, right, node, height, size)): Ward's tree of rows (key..., vector).

    Leaves are numbered from 0 by key, merges from the number of leaves on by height.  Rows whose vector is null, empty or holds null
    or non-finite components take no part; vectors of different widths are an error.  Equal rows merge at height 0.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    sound = rows.filter(F.size(vector) > 0).select(*key, v.alias("centre"))
    sound = sound.filter(~F.exists("centre", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    leaves = cut(numbered(sound, *key, "centre", name="leaf"))
    seen = leaves.agg(F.count("*").alias("n"), F.min(F.size("centre")).alias("least"), F.max(F.size("centre")).alias("most")).first()
    if seen.least != seen.most:
        raise ValueError(f"vectors of {seen.least} and {seen.most} components")
    return leaves.select(*key, "leaf"), weighted_tree(leaves.withColumn("size", F.lit(1.0)), seen.n, width)


def roots(merges: DataFrame) -> DataFrame:
    """(child, root): the topmost node above each child of the given merges, by doubling."""
    up = stored(merges.select(F.explode(F.array("left", "right")).alias("child"), F.col("node").alias("root")))
    while True:
        above = up.select(F.col("child").alias("root"), F.col("root").alias("next"))
        higher = stored(up.join(above, "root", "left").select("child", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not higher.filter("moved").head(1):
            return up
        up = higher.drop("moved")


def cut_tree(leaves: DataFrame, tree: DataFrame, k: int) -> DataFrame:
    """leaves with root (node of the tree) and comp: k clusters, numbered from 0 by falling size, ties to the least leaf."""
    n = leaves.count()
    under = roots(tree.filter(F.col("node") < 2 * n - k)).select(F.col("child").alias("leaf"), "root")
    placed = leaves.join(under, "leaf", "left").withColumn("root", F.coalesce("root", "leaf"))
    sizes = placed.groupBy("root").agg(F.count("*").alias("n"), F.min("leaf").alias("least"))  # k rows
    order = sizes.select("root", (F.row_number().over(Window.orderBy(F.desc("n"), "least")) - 1).alias("comp"))
    return placed.join(F.broadcast(order), "root").select(*leaves.columns, "root", "comp")


def contracted(parts: DataFrame, tree: DataFrame) -> DataFrame:
    """(left, right, node, height): the merges above the clusters of cut_tree, a cluster's top node renamed to its number."""
    tops = parts.select("root", "comp").distinct()
    upper = tree.join(tops.agg(F.count("*").alias("k")).crossJoin(parts.agg(F.count("*").alias("n"))).select((2 * F.col("n") - F.col("k")).alias("from")), F.col("node") >= F.col("from"))
    named = lambda df, c: df.join(tops.select(F.col("root").alias(c), F.col("comp").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(F.col(f"_{c}").cast("long"), c)).drop(f"_{c}")
    return named(named(upper, "left"), "right").select("left", "right", "node", "height")


def topic_paths(merges: DataFrame, comps: DataFrame, most: int = 10_000) -> DataFrame:
    """(comp, path, place) of the clusters (comp) of contracted merges.

    ``path`` is the node that holds the cluster after each merge, its own number first; ``place`` orders clusters so that no two
    branches cross, the side of the smaller cluster number first.  The merges are one fewer than the clusters, of which there may
    be ``most``; they travel as one array.
    """
    if comps.select("comp").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} clusters")
    steps = merges.agg(F.array_sort(F.collect_list(F.struct("node", "left", "right"))).alias("steps"))
    rows = comps.select(F.col("comp").cast("long").alias("comp")).distinct().crossJoin(F.broadcast(steps))
    at = lambda path: F.element_at(path, -1)
    climb = F.aggregate("steps", F.array("comp"), lambda path, m: F.concat(path, F.array(F.when((at(path) == m["left"]) | (at(path) == m["right"]), m["node"]).otherwise(at(path)))))
    walked = cut(rows.select("comp", climb.alias("path")))
    least = walked.select("comp", F.explode(F.array_distinct("path")).alias("node")).groupBy("node").agg(F.min("comp").alias("least"))
    side = lambda c: least.select(F.col("node").alias(c), F.col("least").alias(f"least_{c}"))
    sided = merges.join(side("left"), "left").join(side("right"), "right")
    sided = sided.select("node", F.when(F.col("least_left") < F.col("least_right"), F.col("right")).otherwise(F.col("left")).alias("second"))
    seconds = sided.agg(F.collect_list("second").alias("seconds"))
    turns = F.transform(F.reverse(F.array_distinct("path")), lambda x: F.array_contains("seconds", x).cast("int"))
    order = Window.orderBy("turns")  # a row a cluster
    return walked.crossJoin(F.broadcast(seconds)).withColumn("turns", turns).select("comp", "path", (F.row_number().over(order) - 1).alias("place"))
