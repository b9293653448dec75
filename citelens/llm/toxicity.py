"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w . x) with one weight vector for all ordered thresholds.  x counts a text's distinct
lower-cased words, and the distinct words behind each of their 4- and 5-letter beginnings (inflected forms share them), in
2**DIM_BITS hashed columns.  The weights are sparse: an L1 proximal gradient fit.

The model is fitted on a bounded sample of labelled rows (``max_rows``, the same number of each grade, chosen by a hash of
the id, each grade weighing as the square root of its
frequency, so a rare grade is not drowned).  Everything else runs over all rows: one Arrow map over the
documents, with the non-zero weights as the only state, so scoring has no shuffle and no skew.

A count above ``MOST`` counts as ``MOST``, in the fit and in scoring alike: a distinct word counts once, so only a beginning
that more than eight distinct words of a text share is touched.  Columns in fewer than three labelled rows get no weight, as
the L1 fit could not tell them from noise.

Defined results: null or empty text has the score of no words; a repeated row is scored alike; with no labelled rows, or
one grade only, every document gets that grade (0 if none).  Null labels and null ids are ignored; of several labels of an
id the highest counts; a labelled id with several texts trains on each.  Labels are joined by the id alone and results have
their own columns, so clashing names do no harm.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelens.llm.shared import fresh

DIM_BITS = 20
#: The most that a feature counts in one text.
MOST = 8
#: Contributions of words that a worker remembers before it starts afresh.
REMEMBERED = 200_000
_letters = re.compile(r"[^\W\d_]+")


def _features(word: str) -> tuple[int, ...]:
    mask = (1 << DIM_BITS) - 1
    raw = word.encode()
    out = [zlib.crc32(raw) & mask]
    for n in (4, 5):
        if len(word) >= n:
            out.append(zlib.crc32(word[:n].encode(), n) & mask)
    return tuple(out)


def feature_counts(text: str | None) -> dict[int, int]:
    """Hashed column -> count of distinct words."""
    counts: dict[int, int] = {}
    for word in set(_letters.findall((text or "").lower())):
        for f in _features(word):
            counts[f] = counts.get(f, 0) + 1
    return counts


@dataclass
class OrdinalModel:
    """columns/weights: the non-zero part of w; thresholds: ascending, one fewer than the grades."""

    grades: list[int]
    columns: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """One row a score, one column a grade."""
        below = _sigmoid(self.thresholds[None, :] - score[:, None])
        edges = np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1)
        return np.diff(edges, axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.clip(x, -60, 60) / 2))


def fit_ordinal(columns: list[np.ndarray], counts: list[np.ndarray], grades: np.ndarray, weight: np.ndarray, levels: list[int], l1: float = 1e-3, steps: int = 250, rate: float = 0.3) -> OrdinalModel:
    """Weighted maximum likelihood with L1, by proximal AdaGrad; columns in fewer than three rows carry no weight.

    A row is its hashed columns and their counts, as arrays.
    """
    k = len(levels)
    n = len(columns)
    index, value = np.concatenate(columns), np.minimum(np.concatenate(counts), MOST).astype(np.float32)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(c) for c in columns])
    common = np.flatnonzero(np.bincount(index, minlength=1 << DIM_BITS) >= 3)
    place = np.full(1 << DIM_BITS, -1, np.int64)
    place[common] = np.arange(len(common))
    keep = place[index] >= 0
    index, value, row = place[index[keep]], value[keep], row[keep]
    w, seen = np.zeros(len(common)), np.full(len(common), 1e-8)
    y = np.searchsorted(levels, grades)
    weight = weight / weight.sum()
    cumulative = np.clip(np.cumsum(np.bincount(y, weight, k))[:-1], 1e-6, 1 - 1e-6)
    theta, theta_seen = np.log(cumulative / (1 - cumulative)), np.full(k - 1, 1e-8)
    for _ in range(steps):
        score = np.bincount(row, w[index] * value, n)
        edges = np.concatenate([[-60.0], theta, [60.0]])
        upper, lower = _sigmoid(edges[y + 1] - score), _sigmoid(edges[y] - score)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        slope = weight * (du - dl) / p
        grad = np.bincount(index, slope[row] * value, len(common))
        seen += grad * grad
        step = rate / np.sqrt(seen)
        w = w - step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        grad_theta = -np.bincount(y, weight * du / p, k)[:-1] + np.bincount(y, weight * dl / p, k)[1:]
        theta_seen += grad_theta * grad_theta
        theta = np.maximum.accumulate(theta - rate / np.sqrt(theta_seen) * grad_theta)
    used = np.flatnonzero(w)
    return OrdinalModel(list(levels), common[used], w[used], theta)


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", grade: str = "toxic", max_rows: int = 4000, seed: int = 3) -> OrdinalModel:
    """Fits on at most about ``max_rows`` labelled rows (the documented bound on what reaches the driver).

    The labels are sampled first, so only their documents are turned into features and no text is shuffled.
    """
    labels = labels.filter(F.col(grade).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(grade).cast("int").alias("grade")).groupBy(id_col).agg(F.max("grade").alias("grade"))
    counts = {int(r[0]): r[1] for r in labels.groupBy("grade").count().collect()}
    levels = sorted(counts)
    if len(levels) < 2:
        return OrdinalModel(levels or [0], np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    each = max_rows // len(levels)
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1_000_000))
    bound = F.lit(0)
    for level in levels:
        bound = F.when(F.col("grade") == level, F.lit(int(1_000_000 * min(1.0, each / counts[level])))).otherwise(bound)
    chosen = labels.filter(place < bound).orderBy(place, id_col).limit(2 * max_rows)
    sample = docs.select(F.col(id_col), F.col(text).alias("text")).join(F.broadcast(chosen), id_col).select(place.alias("place"), id_col, "grade", "text")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted(feature_counts(t).items()) for t in batch["text"]]
            yield pd.DataFrame({"place": batch["place"], "grade": batch["grade"], "columns": [np.array([c for c, _ in f], np.int32).tobytes() for f in found], "counts": [np.array([n for _, n in f], np.int32).tobytes() for f in found]})

    found = sample.mapInPandas(features, "place long, grade int, columns binary, counts binary")
    got = found.orderBy("place", "grade", "columns", "counts").limit(2 * max_rows).toPandas()
    columns, numbers = ([np.frombuffer(bytes(b), np.int32) for b in got[c]] for c in ("columns", "counts"))
    grades = got["grade"].to_numpy()
    if len(set(grades)) < 2:
        return OrdinalModel(sorted(set(grades.tolist())) or levels[:1], np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    order = sorted(range(len(grades)), key=lambda i: (grades[i], columns[i].tobytes(), numbers[i].tobytes()))  # a fixed order, whatever the tasks'
    grades = grades[order]
    levels = sorted(set(grades.tolist()))
    share = {level: counts[level] ** 0.5 / (grades == level).sum() for level in levels}
    return fit_ordinal([columns[i] for i in order], [numbers[i] for i in order], grades, np.array([share[g] for g in grades]), levels)


def severity(model: OrdinalModel, text: Column) -> Column:
    """Struct of expected_severity double, grade int, p_worst double for a text column."""
    known = dict(zip(model.columns.tolist(), model.weights.tolist(), strict=True))
    levels = np.array(model.grades, float)

    @F.pandas_udf("expected_severity double, grade int, p_worst double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memory: dict[str, tuple[int, ...]] = {}
        for batch in texts:
            scores = np.zeros(len(batch))
            for i, t in enumerate(batch):
                columns: dict[int, int] = {}
                for word in set(_letters.findall((t or "").lower())):
                    hit = memory.get(word)
                    if hit is None:
                        if len(memory) >= REMEMBERED:
                            memory.clear()
                        hit = memory[word] = tuple(f for f in _features(word) if f in known)
                    for f in hit:
                        columns[f] = columns.get(f, 0) + 1
                scores[i] = sum(known[f] * min(n, MOST) for f, n in sorted(columns.items()))
            p = model.probabilities(scores) if len(levels) > 1 else np.ones((len(batch), 1))
            yield pd.DataFrame({"expected_severity": p @ levels, "grade": levels[p.argmax(axis=1)].astype("int32"), "p_worst": p[:, -1]})

    return score(text)


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, expected_severity, grade, p_worst) for every row of docs."""
    return docs.select(id_col, severity(model, F.col(text)).alias("s")).select(id_col, "s.expected_severity", "s.grade", "s.p_worst")


def drop_toxic(docs: DataFrame, model: OrdinalModel, text: str = "text", limit: float = 0.3) -> DataFrame:
    """The rows of docs whose expected severity is below limit, as they are."""
    name = fresh(docs, "severity")
    return docs.withColumn(name, severity(model, F.col(text))).filter(F.col(name)["expected_severity"] < limit).drop(name)
