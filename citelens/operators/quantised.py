"""Vector search by cells and product-quantised residuals, with exact measure of the best.

A coarse quantiser puts each vector into its nearest cell; what is left of it is cut into ``parts`` pieces, and each piece is
told by one byte, the nearest entry of that piece's codebook.  A query looks into its ``probe`` nearest cells, sums one table
entry a piece for every row there, and its ``keep`` best rows are measured again on the original vectors.

Plan: quantiser and codebooks are fitted on a bounded sample, the codebooks in one task a piece; their size is (cells + codes) x
dimension, whatever the table's.  Every row is indexed.  Cells meet their queries in tasks of one block of a cell's codes and one
block of its queries, so a cell that holds a third of all rows is many tasks; a task gives ``keep`` rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelens.functions.scalars import l2_distance

STEP = 4096  # rows measured at once against cells or codes


@dataclass(frozen=True)
class Quantiser:
    cells: np.ndarray  # cells x dimension
    books: np.ndarray  # parts x codes x (dimension / parts)

    @property
    def dim(self) -> int:
        return self.cells.shape[1]


def _sound(rows: DataFrame, dim: int, vector: str) -> Column:
    v = F.transform(vector, lambda x: x.cast("double"))
    return F.when((F.size(vector) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), v)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (centres * centres).sum(axis=1)
    return np.concatenate([(squares - 2.0 * (x[at : at + STEP] @ centres.T)).argmin(axis=1) for at in range(0, len(x), STEP)]) if len(x) else np.empty(0, np.int64)


def _codebook(x: np.ndarray, codes: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Centres of Lloyd's rounds over the distinct rows, each weighing as often as it occurs; all of them if they are no more than codes."""
    x, weight = np.unique(x, axis=0, return_counts=True)
    if len(x) <= codes:
        return np.concatenate([x, np.repeat(x[-1:], codes - len(x), axis=0)])
    centres = x[np.random.default_rng(seed).choice(len(x), codes, replace=False, p=weight / weight.sum())]
    for _ in range(rounds):
        at = _closest(x, centres)
        total = np.bincount(at, weight, codes)
        sums = np.stack([np.bincount(at, weight * c, codes) for c in x.T], axis=1)
        centres = np.where(total[:, None] > 0, sums / np.maximum(total, 1)[:, None], centres)
    return centres


def fit(rows: DataFrame, cells: int = 1024, parts: int = 32, codes: int = 256, sample: int = 65_536, seed: int = 0, vector: str = "embedding") -> Quantiser | None:
    """The quantiser of rows (id, chunk, vector), fitted on about ``sample`` of them, chosen by a hash of (id, chunk).

    The dimension is the greatest size of a vector; others, and vectors with null or non-finite components, take no part.  There
    are no more cells than one for 40 rows of the sample, and as many parts, 32 at most, as divide the dimension.  None if
    no row takes part.
    """
    dim = rows.agg(F.max(F.size(vector))).first()[0] or 0
    if dim <= 0:
        return None
    sound = rows.select("id", "chunk", _sound(rows, dim, vector).alias("v")).filter("v IS NOT NULL")
    n = sound.count()
    if not n:
        return None
    share = min(1.0, sample / n)
    chosen = sound.filter(F.pmod(F.xxhash64("id", "chunk", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    taken = chosen.count()
    chosen, taken = (chosen, taken) if taken else (sound, n)
    k = max(1, min(cells, taken // 40))
    parts = max(p for p in range(1, min(parts, dim) + 1) if dim % p == 0)
    if k == 1:
        mean = chosen.agg(*(F.avg(F.get("v", F.lit(i))) for i in range(dim))).first()
        centres = np.array([list(mean)], float)
    else:
        centres = np.array(KMeans(k=k, seed=seed, maxIter=10).fit(chosen.select(array_to_vector("v").alias("features"))).clusterCenters())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            left = (x - centres[_closest(x, centres)]).reshape(-1, dim // parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(parts, dtype=np.int32), len(x))), pa.FixedSizeListArray.from_arrays(left.ravel(), dim // parts).cast(pa.list_(pa.float64()))], ["part", "x"])

    def train(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        book = _codebook(_matrix(table.column("x"), dim // parts), codes, seed + part)
        return pa.table({"part": pa.array([part], pa.int32()), "book": pa.array([book.ravel().tolist()], pa.list_(pa.float64()))})

    cut = chosen.select("v").mapInArrow(pieces, "part int, x array<double>")
    books = cut.groupBy("part").applyInArrow(train, "part int, book array<double>").orderBy("part").collect()  # codes x dimension numbers
    return Quantiser(centres, np.array([b.book for b in books]).reshape(parts, codes, dim // parts))


def index(rows: DataFrame, quantiser: Quantiser, vector: str = "embedding") -> DataFrame:
    """(id, chunk, cell, codes): the cell of every row that takes part, and a byte a piece of what is left of it."""
    cells, books, dim = quantiser.cells, quantiser.books, quantiser.dim

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            cell = _closest(x, cells)
            left = (x - cells[cell]).reshape(len(x), len(books), -1)
            coded = np.stack([_closest(left[:, p], book) for p, book in enumerate(books)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("chunk"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in coded], pa.binary())], ["id", "chunk", "cell", "codes"])

    told = rows.select(F.col("id").cast("long").alias("id"), F.col("chunk").cast("int").alias("chunk"), _sound(rows, dim, vector).alias("v"))
    return told.filter("v IS NOT NULL").mapInArrow(encode, "id long, chunk int, cell int, codes binary")


def search(indexed: DataFrame, rows: DataFrame, queries: DataFrame, quantiser: Quantiser, k: int, probe: int = 100, keep: int | None = None, vector: str = "embedding", block: int = 20_000, together: int = 200) -> DataFrame:
    """(query, id, chunk, distance, rank): about the k nearest by L2 distance of queries (query, vector), measured on rows' own vectors.

    The ``keep`` (20 x k if not given) least by codes are measured exactly; ties go to the smaller (id, chunk).  Queries whose
    vectors are null, of another width or not finite have no rows.
    """
    keep, cells, books, dim = keep or 20 * k, quantiser.cells, quantiser.books, quantiser.dim
    asked = queries.select("query", _sound(queries, dim, vector).alias("v")).filter("v IS NOT NULL")
    squares, wanted = (cells * cells).sum(axis=1), min(probe, len(cells))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            near = np.argsort(squares - 2.0 * (x @ cells.T), axis=1, kind="stable")[:, :wanted]
            yield pa.RecordBatch.from_arrays([batch.column("query"), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32())), batch.column("v")], ["query", "cells", "v"])

    kind = queries.schema["query"].dataType.simpleString()
    placed = asked.mapInArrow(places, f"query {kind}, cells array<int>, v array<double>").select("query", F.explode("cells").alias("cell"), "v")
    sized = lambda df, name, size: df.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    blocks = F.broadcast(sized(indexed, "rows", block).join(sized(placed, "asks", together), "cell"))  # a row a cell
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    left = indexed.join(blocks, "cell").withColumn("r", F.pmod(F.xxhash64("id", "chunk"), F.col("rows")).cast("int")).withColumn("q", every("asks"))
    right = placed.join(blocks, "cell").withColumn("q", F.pmod(F.xxhash64("query"), F.col("asks")).cast("int")).withColumn("r", every("rows"))

    def scan(codes: pa.Table, asks: pa.Table) -> pa.Table:
        ids, chunk = codes.column("id").to_numpy(), codes.column("chunk").to_numpy()
        coded = np.frombuffer(b"".join(codes.column("codes").to_pylist()), np.uint8).reshape(-1, len(books))
        best, distance, at = [], [], np.arange(len(books))
        cell = cells[asks.column("cell")[0].as_py()] if len(asks) else None
        for x in _matrix(asks.column("v"), dim) if len(ids) else ():
            table = (((x - cell).reshape(len(books), 1, -1) - books) ** 2).sum(axis=2)
            away = table[at, coded].sum(axis=1)
            order = np.lexsort((chunk, ids, away))[:keep]
            best.append(order)
            distance.append(away[order])
        i = np.concatenate(best) if best else np.empty(0, np.int64)
        who = np.repeat(np.arange(len(best)), [len(b) for b in best])
        return pa.table({"query": asks.column("query").take(pa.array(who, pa.int64())), "id": ids[i], "chunk": chunk[i], "rough": np.concatenate(distance) if distance else np.empty(0)})

    rough = left.select("cell", "r", "q", "id", "chunk", "codes").groupBy("cell", "r", "q").cogroup(right.select("cell", "r", "q", "query", "v").groupBy("cell", "r", "q")).applyInArrow(scan, f"query {kind}, id long, chunk int, rough double")
    order = lambda x: Window.partitionBy("query").orderBy(x, "id", "chunk")
    few = rough.withColumn("place", F.row_number().over(order("rough"))).filter(F.col("place") <= keep).select("query", "id", "chunk")
    own = rows.select(F.col("id").cast("long").alias("id"), F.col("chunk").cast("int").alias("chunk"), _sound(rows, dim, vector).alias("w")).filter("w IS NOT NULL")
    measured = few.join(own, ["id", "chunk"]).join(asked, "query").withColumn("distance", l2_distance(F.col("w"), F.col("v")))
    return measured.withColumn("rank", F.row_number().over(order(F.round("distance", 9)))).filter(F.col("rank") <= k).select("query", "id", "chunk", "distance", "rank")
