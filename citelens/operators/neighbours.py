"""Neighbour graphs of vectors by descent: a neighbour's neighbour is likely a neighbour.

Lists of ``k`` neighbours start in blocks of rows that fall on the same sides of random planes, and are improved in rounds.  In
a round every node brings together a sample of the entries that are new in its list or name it, with a sample of the old
ones; each pair of which one is new is measured, and enters the lists of both ends if it is nearer than their farthest.  It
ends when a round changes few entries.  Work a round is rows x samples squared, against rows squared for the exact search.

Plan: a node's sample is one row of bounded width (both lists are sampled by hash, the naming one behind a group limit, so a
node that very many others name costs no more), measured as matrices in Arrow batches; only pairs that enter a list leave the
task.  Every round goes on from the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelens.sources.tables import cut, stored, unstored

PAIRS = "node long, other long, distance double"
WIDTH_OF_BLOCK = 1000


def _packed(vector: Column) -> Column:
    """A vector as the bytes of 32-bit floats, scaled to length 1."""

    @F.pandas_udf("binary")
    def pack(rows):
        unit = (np.asarray(v, np.float64) for v in rows)
        return rows.__class__([(v / (np.linalg.norm(v) or 1.0)).astype(np.float32).tobytes() for v in unit])

    return pack(vector)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def _in_blocks(rows: DataFrame, k: int, tables: int, seed: int, width: int) -> DataFrame:
    """PAIRS: each row's k nearest among its block, for every table of blocks; a block is a cell of random planes, cut by hash to about ``width`` rows."""
    n = rows.count()
    planes = int(np.ceil(np.log2(max(n / width, 1)))) + 1 if n > width else 0
    dim = rows.select(F.octet_length("packed") / 4).first()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("packed"))
            for t in range(tables):
                sides = x @ np.random.default_rng([seed, t]).standard_normal((int(dim[0]), planes), dtype=np.float32) > 0 if planes else np.zeros((len(x), 1), bool)
                cell = (sides @ (1 << np.arange(sides.shape[1], dtype=np.int64))).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"t": np.full(len(x), t, np.int32), "cell": cell, "node": batch.column("node"), "packed": batch.column("packed")}, pa.schema([("t", pa.int32()), ("cell", pa.int64()), ("node", pa.int64()), ("packed", pa.binary())]))

    placed = cut(rows.mapInArrow(place, "t int, cell long, node long, packed binary"))
    sizes = placed.groupBy("t", "cell").agg(F.ceil(F.count("*") / width).alias("parts"))
    placed = placed.join(sizes, ["t", "cell"]).withColumn("part", F.pmod(F.xxhash64("node", "t"), F.col("parts")))

    def measure(table: pa.Table) -> pa.Table:
        ids, x = table.column("node").to_numpy(), _matrix(table.column("packed"))
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        away = np.sqrt(np.maximum(2.0 - 2.0 * (x @ x.T).astype(np.float64), 0.0))
        np.fill_diagonal(away, np.inf)
        m = min(k, len(ids) - 1)
        near = np.argsort(away, axis=1, kind="stable")[:, :m]
        return pa.table({"node": np.repeat(ids, m), "other": ids[near].ravel(), "distance": np.take_along_axis(away, near, 1).ravel()})

    return placed.groupBy("t", "cell", "part").applyInArrow(measure, PAIRS)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest entries (node, other, distance, fresh) of each node; an entry that was there stays old."""
    once = pairs.groupBy("node", "other").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("node").orderBy("distance", "other")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each node's sample that are near enough for a list of one of them."""
    schema = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("distance", pa.float64())])
    for batch in batches:
        lists = batch.column("members")
        flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
        ids, fresh, worst, x = (flat.field(i) for i in range(4))
        ids, fresh, worst, x = ids.to_numpy(), fresh.to_numpy(zero_copy_only=False).astype(bool), worst.to_numpy(), _matrix(x)
        found, begin = [], 0
        for end in ends:
            i = slice(begin, end)
            begin = end
            away = np.sqrt(np.maximum(2.0 - 2.0 * (x[i] @ x[i].T).astype(np.float64), 0.0))
            wanted = (fresh[i][:, None] | fresh[i][None, :]) & (away < worst[i][:, None]) & (ids[i][:, None] != ids[i][None, :])
            a, b = np.nonzero(wanted)
            found.append((ids[i][a], ids[i][b], away[a, b]))
        node, other, distance = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        yield pa.RecordBatch.from_pydict({"node": node, "other": other, "distance": distance}, schema)


def descent(rows: DataFrame, k: int = 100, sample: int = 24, few: float = 0.001, tables: int = 3, seed: int = 0, vector: str = "embedding", width: int = WIDTH_OF_BLOCK) -> DataFrame:
    """(node, other, distance): about the k nearest by cosine of every row (id long, vector); distance is that of the vectors at length 1.

    ``sample`` bounds each of the four lists that a node brings together; it ends when a round brings fewer than ``few`` of
    all entries.  Tables of at most ``width`` rows are measured whole, and so exactly.
    """
    packed = cut(rows.select(F.col("id").cast("long").alias("node"), _packed(F.col(vector)).alias("packed")))
    if not packed.head(1):
        return packed.select("node", F.col("node").alias("other"), F.lit(0.0).alias("distance"))
    lists = stored(_best(_in_blocks(packed, k, tables, seed, width).withColumn("fresh", F.lit(True)), k))
    n = packed.count()
    if n <= width:
        return lists.select("node", "other", "distance")
    turn = 0
    while True:
        turn += 1
        by_chance = lambda key: Window.partitionBy(key, "fresh").orderBy(F.xxhash64(F.lit(seed + turn), "node", "other"))  # noqa: B023, E731
        own = lists.withColumn("nth", F.row_number().over(by_chance("node"))).filter(F.col("nth") <= sample)
        naming = lists.withColumn("nth", F.row_number().over(by_chance("other"))).filter(F.col("nth") <= sample)
        met = own.select("node", F.col("other").alias("member"), "fresh").unionByName(naming.select(F.col("other").alias("node"), F.col("node").alias("member"), "fresh"))
        met = met.groupBy("node", "member").agg(F.max("fresh").alias("fresh"))
        far = lists.groupBy("node").agg(F.when(F.count("*") < k, F.lit(float("inf"))).otherwise(F.max("distance")).alias("worst"))
        known = packed.join(far, "node", "left").select(F.col("node").alias("member"), F.coalesce("worst", F.lit(float("inf"))).alias("worst"), "packed")
        gathered = met.join(known, "member").groupBy("node").agg(F.collect_list(F.struct("member", "fresh", "worst", "packed")).alias("members")).select("members")
        seen = own.filter("fresh").select("node", "other", F.lit(True).alias("seen"))
        old = lists.join(seen, ["node", "other"], "left").select("node", "other", "distance", (F.col("fresh") & F.col("seen").isNull()).alias("fresh"), F.lit(False).alias("entered"))
        came = gathered.mapInArrow(_meetings, PAIRS).groupBy("node", "other").agg(F.min("distance").alias("distance"))
        both = old.unionByName(came.select("node", "other", "distance", F.lit(True).alias("fresh"), F.lit(True).alias("entered")))
        once = both.groupBy("node", "other").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"), F.min("entered").alias("entered"))
        order = Window.partitionBy("node").orderBy("distance", "other")
        last, lists = lists, stored(once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place"))
        changed = lists.filter("entered").count()
        unstored(last)
        if changed <= few * n * k:
            return lists.select("node", "other", "distance")
