"""Approximate nearest neighbours with score-aware anisotropic quantisation.

Vectors are scaled to length 1, so the largest inner product is the largest cosine.  A product quantiser with four-bit
codes (16 centroids a subspace) is trained on a bounded sample under the anisotropic loss: of a residual r of x, the part
along x costs ``eta`` times what the part across it costs, for that is what shifts large inner products.  Codes are chosen
by coordinate descent under the same loss, for every row.  A query's scan adds table entries, two codes at a time (byte
tables of 256 sums); every row whose estimate comes within ``margin`` of the query's k-th best so far is measured exactly in
double precision on the original vector, which lies beside its code.  margin is the sample's own error of estimates, so
near copies whose codes agree are all measured and no shortlist cuts them off.

Plan: rows and queries are dealt to cells, the nearest of centres fitted on the same sample.  A row lies in one cell, packed
with its code into chunks inside the map that encodes; a query is sent to the ``probes`` cells that look nearest, a number
found on the sample: the least that holds at least ``sure`` of its true neighbours.  Chunks and blocks of queries meet by
an equi-join on (cell, slice), so the index crosses the network once, whatever the number of queries, and a large cell is
parted into slices by its rows.  A task keeps k results a query, which a window per query merges.

Of equal vectors only the k + 1 smallest ids are in the index, for no other can be among k results that leave out the query.

Defined results: vectors that are null, zero, of another dimension than the most common, or hold a null or non-finite
component take no part, nor do rows without an id; ties go to the smaller id; rows that share an id are candidates each,
listed once with the best of them, and as a query the least of their vectors stands for the id; with fewer candidates than
k all are returned; results have their own columns, so clashing names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citelens.llm.shared import cut

CENTROIDS = 16


class AnisotropicQuantizer:
    """codebooks: subspaces x 16 x width; eta: how much dearer residual along the vector is than across it."""

    def __init__(self, codebooks: np.ndarray, eta: float):
        self.codebooks, self.eta = codebooks, eta

    @property
    def subspaces(self) -> int:
        return len(self.codebooks)

    def pad(self, x: np.ndarray) -> np.ndarray:
        width = self.subspaces * self.codebooks.shape[2]
        return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """rows x subspaces codes: nearest first, then coordinate descent under the anisotropic loss."""
        parts = self.pad(x).reshape(len(x), self.subspaces, -1)
        error = parts[:, :, None, :] - self.codebooks[None]  # rows, subspaces, 16, width
        across = (error**2).sum(axis=3)
        along = (error * parts[:, :, None, :]).sum(axis=3)
        codes = across.argmin(axis=2)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
        for _ in range(sweeps):
            for m in range(self.subspaces):
                rest = total - along[rows, m, codes[:, m]]
                loss = across[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2
                codes[:, m] = loss.argmin(axis=1)
                total = rest + along[rows, m, codes[:, m]]
        return codes.astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x byte positions x 256: sums of the table entries of two neighbouring four-bit codes."""
        parts = self.pad(queries).reshape(len(queries), self.subspaces, -1)
        single = np.einsum("qmw,mcw->qmc", parts, self.codebooks).astype(np.float32)
        return (single[:, 1::2, :, None] + single[:, 0::2, None, :]).reshape(len(queries), self.subspaces // 2, 256)


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte: the even subspace low, the odd one high."""
    return codes[:, 0::2] | codes[:, 1::2] << 4


def train_quantizer(x: np.ndarray, subspaces: int, eta: float = 4.0, rounds: int = 12, seed: int = 0) -> AnisotropicQuantizer:
    """Alternates anisotropic codes with the closed-form best centroids: for each, the weighted normal equations of its rows."""
    rng = np.random.default_rng(seed)
    width = -(-x.shape[1] // subspaces)
    model = AnisotropicQuantizer(np.zeros((subspaces, CENTROIDS, width)), eta)
    parts = model.pad(x).reshape(len(x), subspaces, width)
    for m in range(subspaces):
        model.codebooks[m] = parts[rng.choice(len(x), CENTROIDS, replace=len(x) < CENTROIDS), m]
    for _ in range(rounds):
        codes = model.encode(x, sweeps=1)
        for m in range(subspaces):
            own = parts[:, m]
            chosen = model.codebooks[np.arange(subspaces), codes]
            residual = ((parts - chosen) * parts).sum(axis=2)
            rest = residual.sum(axis=1) - residual[:, m]  # along x, from the other subspaces
            for c in range(CENTROIDS):
                i = codes[:, m] == c
                if not i.any():
                    model.codebooks[m, c] = own[rng.integers(len(x))]
                    continue
                p = own[i]
                # Least of |p - z|^2 + (eta - 1) (rest + p.p - p.z)^2 over z.
                left = i.sum() * np.eye(width) + (eta - 1) * p.T @ p
                right = p.sum(axis=0) + (eta - 1) * p.T @ (rest[i] + (p * p).sum(axis=1))
                model.codebooks[m, c] = np.linalg.solve(left, right)
    return model


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vec array<double>): rows that can take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), v.alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.filter(fine)


def _trained(rows: pd.Series, dim: int) -> np.ndarray:
    x = np.array(rows.tolist(), float).reshape(-1, dim) if len(rows) else np.eye(1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cell_centres(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def probes_needed(x: np.ndarray, centres: np.ndarray, k: int, sure: float, queries: int = 500) -> int:
    """The least number of nearest cells that hold ``sure`` of the sample's own k nearest, over up to ``queries`` of its rows."""
    own = (x @ centres.T).argmax(axis=1)
    asked = x[:: max(1, len(x) // queries)]
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")  # of each cell in a query's order
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(sure * len(needed))))]) + 1 if len(needed) else 1


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 5, cells: int = 64, sure: float = 0.995, subspaces: int | None = None, sample: int = 4_000, block: int = 512, chunk: int = 4_096, rows_per_slice: int = 100_000, seed: int = 0) -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest by cosine, of all rows but those of its own id.

    sample bounds the rows that train the quantiser and the cells (on the driver); block and chunk bound what one join row
    holds.  subspaces must be even; None gives every dimension a four-bit code of its own, the most exact form.
    """
    rows = usable(vectors, id_col, vector)
    dims = {r[0]: r[1] for r in rows.groupBy(F.size("vec").alias("d")).count().collect()}
    dim = max(dims, key=lambda d: (dims[d], -d), default=1)
    rows = rows.filter(F.size("vec") == dim)
    n = dims.get(dim, 0)
    place = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000))
    got = rows.filter(place < int(1_000_000 * min(1.0, sample / max(n, 1)))).orderBy(place, "id", "vec").limit(2 * sample).select("vec").toPandas()
    train = _trained(got["vec"], dim)
    model = train_quantizer(train, subspaces or dim + dim % 2, seed=seed)
    centres = cell_centres(train, max(1, min(cells, len(train) // 20, n // 2_000)), seed=seed)
    probes = probes_needed(train, centres, k, sure)
    code, asked = model.encode(train), train[:: max(1, len(train) // 200)]
    stored = np.concatenate([model.codebooks[m][code[:, m]] for m in range(model.subspaces)], axis=1)
    error = asked @ (stored[:, :dim] - train).T
    margin = 8.0 * float(error.std()) + 1e-6  # four deviations of either estimate
    id_type = rows.schema["id"].dataType.simpleString()

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["vec"].tolist(), float).reshape(-1, dim)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            own, ids = (unit @ centres.T).argmax(axis=1), batch["id"].to_numpy()
            for cell in np.unique(own):
                places = np.flatnonzero(own == cell)
                for at in range(0, len(places), chunk):
                    i = places[at : at + chunk]
                    codes = np.concatenate([pack_codes(model.encode(unit[i[j : j + 1024]])) for j in range(0, len(i), 1024)])
                    yield pd.DataFrame({"cell": [int(cell)], "rows": [len(i)], "ids": [ids[i].tolist()], "codes": [codes.tobytes()], "vectors": [x[i].tobytes()]})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["vec"].tolist(), float).reshape(-1, dim)
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            each = near.shape[1]
            yield pd.DataFrame({"cell": near.ravel(), "query_id": np.repeat(batch["id"].to_numpy(), each), "query_vector": np.repeat(np.array([v.tobytes() for v in x], object), each)})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}  # block of queries -> their ids, and ids and scores of the k best of each so far
        for batch in batches:
            for name, ids, codes, raw, asked_ids, asked_raw in zip(*(batch[c] for c in ("block", "ids", "codes", "vectors", "query_ids", "query_vectors")), strict=True):
                ids, asked_ids = np.asarray(ids), np.asarray(asked_ids)
                x, q = np.frombuffer(raw, float).reshape(-1, dim), np.frombuffer(b"".join(asked_raw), float).reshape(-1, dim)
                norm, q_norm = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
                code = np.frombuffer(codes, np.uint8).reshape(len(ids), -1)
                _, top_ids, top = best.setdefault(name, (asked_ids, np.full((len(q), k), ids[0], ids.dtype), np.full((len(q), k), -np.inf)))
                for at in range(0, len(q), 32):
                    part = slice(at, min(at + 32, len(q)))
                    tables = model.tables(q[part] / q_norm[part, None])
                    estimate = np.zeros((len(tables), len(ids)), np.float32)
                    for m in range(code.shape[1]):
                        estimate += tables[:, m][:, code[:, m]]
                    estimate[asked_ids[part, None] == ids[None, :]] = -np.inf
                    guess = np.partition(estimate, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(tables), -np.inf)
                    bar = np.maximum(top[part, -1], guess) - margin
                    i, j = np.nonzero((estimate >= bar[:, None]) & (estimate > -np.inf))
                    score = (x[j] * q[at + i]).sum(axis=1) / (norm[j] * q_norm[at + i])
                    ends = np.searchsorted(i, np.arange(len(tables) + 1))
                    for r in np.unique(i):
                        these = slice(ends[r], ends[r + 1])
                        full = top[at + r] > -np.inf
                        all_ids, all_scores = np.concatenate([top_ids[at + r][full], ids[j[these]]]), np.concatenate([top[at + r][full], score[these]])
                        order = np.lexsort((all_ids, -all_scores))
                        order = order[np.sort(np.unique(all_ids[order], return_index=True)[1])[:k]]
                        top_ids[at + r, : len(order)], top[at + r, : len(order)] = all_ids[order], all_scores[order]
        for asked_ids, top_ids, top in best.values():
            full = (top > -np.inf).ravel()
            yield pd.DataFrame({"query_id": np.repeat(asked_ids, k)[full], "id": top_ids.ravel()[full], "score": top.ravel()[full]})

    rank = Window.partitionBy("vec").orderBy("id")
    held = rows.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= k + 1).drop("r")
    chunks = cut(held.mapInPandas(index, f"cell int, rows long, ids array<{id_type}>, codes binary, vectors binary"))
    slices = cut(chunks.groupBy("cell").agg(F.ceil(F.sum("rows") / rows_per_slice).cast("int").alias("slices")))  # one row a cell
    placed = chunks.join(F.broadcast(slices), "cell").withColumn("slice", F.pmod(F.xxhash64("codes"), F.col("slices")).cast("int"))
    once = usable(queries, id_col, vector).filter(F.size("vec") == dim).groupBy("id").agg(F.min("vec").alias("vec"))
    sent = cut(once.mapInPandas(ask, f"cell int, query_id {id_type}, query_vector binary"))
    parts = slices.join(sent.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("blocks")), "cell")
    sent = sent.join(F.broadcast(parts), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")))
    packed = sent.groupBy("cell", "block", "slices").agg(F.collect_list(F.struct("query_id", "query_vector")).alias("q"))
    packed = packed.select("cell", "block", F.col("q.query_id").alias("query_ids"), F.col("q.query_vector").alias("query_vectors"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    met = placed.join(packed, ["cell", "slice"]).select(F.concat_ws(".", "cell", "slice", "block").alias("block"), "ids", "codes", "vectors", "query_ids", "query_vectors")
    found = met.mapInPandas(scan, f"query_id {id_type}, id {id_type}, score double").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
