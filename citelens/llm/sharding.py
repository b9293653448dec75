"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are first written to the checkpoint folder with a number each, so a row read again after an executor is lost lies where
it lay.  A row's partition is a seeded hash of its keys and that number, which parts equal rows.  One grouped count gives the partitions' sizes; the matrix of how many rows each partition sends to each
shard is drawn from the multivariate hypergeometric distribution with the shard sizes as column sums (at most one apart).
Rows are permuted inside their partition and dealt by the matrix row, exchanged, and permuted again inside the shard.

The matrix is partitions x shards integers and the only thing on the driver; ``max_partitions`` bounds it, beyond which
partitions hold more rows and their sort spills.  A shard is numbered in cells of about ``rows_per_partition`` rows, whose
counts are summed first, so no task holds a shard whole.

Defined results: equal rows are separate rows, each with a place of its own, however many there are; null ids hash like any value; columns named like the results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citelens.llm.shared import cut, fresh


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """partitions x shards; rows sum to counts, columns to the shard sizes, drawn as a uniform permutation would deal them."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    room = np.full(shards, total // shards, np.int64)
    room[: total % shards] += 1
    out = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        out[p] = rng.multivariate_hypergeometric(room, n, method="marginals") if n else 0
        room -= out[p]
    return out


def shuffle_to_shards(rows: DataFrame, keys: list[str], shards: int = 40, seed: int = 5, rows_per_partition: int = 50_000, max_partitions: int = 20_000) -> DataFrame:
    """rows with shard (int, 0 to shards - 1) and slot (long, gapless from 0 inside the shard); keys tell rows apart."""
    kept = rows.drop("shard", "slot")
    number, hash_, part, rank, cell, ends_, s, c, before_ = (fresh(kept, x) for x in ("row_number", "row_hash", "row_part", "row_rank", "row_cell", "dealt_ends", "of_shard", "of_cell", "cell_offset"))
    rows = cut(kept.withColumn(number, F.monotonically_increasing_id()))
    keys = [*keys, number]
    spark = rows.sparkSession
    total = rows.count()
    parts = min(max(8, -(-total // rows_per_partition)), max_partitions)
    cells = max(16, -(-total // (shards * rows_per_partition)))
    hashed = rows.withColumn(hash_, F.xxhash64(F.lit(seed), *keys)).withColumn(part, F.pmod(F.xxhash64(F.lit(seed + 1), *keys), F.lit(parts)).cast("int"))
    counted = {r[0]: r[1] for r in hashed.groupBy(part).count().collect()}
    matrix = communication_matrix([counted.get(p, 0) for p in range(parts)], shards, seed)
    ends = matrix.cumsum(axis=1)
    dealt = spark.createDataFrame([(p, ends[p].tolist()) for p in range(parts)], f"{part} int, {ends_} array<long>")
    local = Window.partitionBy(part).orderBy(hash_, *keys)
    ranked = hashed.withColumn(rank, F.row_number().over(local)).join(F.broadcast(dealt) if parts * shards <= 400_000 else dealt, part)
    shard = F.size(F.filter(ends_, lambda e: e < F.col(rank))).cast("int")
    again = F.xxhash64(F.lit(seed + 2), *keys)
    sent = cut(ranked.withColumn("shard", shard).drop(ends_, rank, part).withColumn(hash_, again).withColumn(cell, F.pmod(F.shiftright(again, 7), F.lit(cells)).cast("int")))
    sizes = sent.groupBy(F.col("shard").alias(s), F.col(cell).alias(c)).count()
    before = Window.partitionBy(s).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn(before_, F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("shard", cell).orderBy(hash_, *keys)
    numbered = sent.withColumn(rank, F.row_number().over(inside)).join(F.broadcast(offsets) if shards * cells <= 100_000 else offsets, (F.col("shard") == F.col(s)) & (F.col(cell) == F.col(c)))
    return numbered.withColumn("slot", (F.col(before_) + F.col(rank) - 1).cast("long")).select(*kept.columns, "shard", "slot")
