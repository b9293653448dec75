"""Text analytics on tokens and counts: (id, token, n)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelens.functions.scalars import word_tokens

# Common English function words.
STOP_WORDS = ("the", "and", "for", "that", "this", "with", "are", "was", "were", "from", "not", "but", "have", "has", "had", "its", "which", "into", "than", "then", "they", "their", "there", "been", "can", "will", "would", "our", "these", "those", "such", "also", "may", "more", "most", "between", "using", "used", "use", "who", "all", "any", "one", "two")
# English endings and what takes their place, tried in this order.
ENDINGS = (("ational", "ate"), ("fulness", "ful"), ("ization", "ize"), ("iveness", "ive"), ("ations", "ate"), ("ation", "ate"), ("sses", "ss"), ("ments", "ment"), ("ies", "y"), ("ing", ""), ("edly", ""), ("ed", ""), ("ly", ""), ("es", "e"), ("s", ""))


def tokens(texts: DataFrame, id_col: str = "id", text: Column | None = None, stop: bool = True) -> DataFrame:
    """(id, pos, token): words of three letters and more, lower-cased, without stop words."""
    t = texts.select(F.col(id_col).alias("id"), F.posexplode(word_tokens(F.col("abstract") if text is None else text)).alias("pos", "token"))
    return t.filter(~F.col("token").isin(*STOP_WORDS)) if stop else t


def sentences(texts: DataFrame) -> DataFrame:
    """(id, sent, sentence) of "title. abstract"."""
    whole = F.concat_ws(". ", "title", "abstract")
    s = texts.select("id", F.posexplode(F.split(whole, r"(?<=[.!?])\s+")).alias("sent", "sentence"))
    return s.filter(F.length(F.trim("sentence")) > 0)


def stem(word: Column) -> Column:
    """Rule stemmer: the first ending that fits and leaves three letters is replaced."""
    out = word
    for ending, other in reversed(ENDINGS):
        fits = word.endswith(ending) & (F.length(word) >= len(ending) + 3)
        out = F.when(fits, F.concat(F.substring(word, F.lit(1), F.length(word) - len(ending)), F.lit(other))).otherwise(out)
    return out


def stem_sql(word: str) -> str:
    """stem() as SQL."""
    cases = (f"WHEN ends_with({word}, '{e}') AND length({word}) >= {len(e) + 3} THEN substr({word}, 1, length({word}) - {len(e)}) || '{o}'" for e, o in ENDINGS)
    return f"CASE {' '.join(cases)} ELSE {word} END"


def surface_forms(token_rows: DataFrame) -> DataFrame:
    """(stem, token): the shortest word of each stem, ties to the first by code point."""
    s = token_rows.withColumn("stem", stem(F.col("token")))
    return s.groupBy("stem").agg(F.min_by("token", F.struct(F.length("token"), "token")).alias("token"))


def counts(token_rows: DataFrame) -> DataFrame:
    return token_rows.groupBy("id", "token").agg(F.count("*").alias("n"))


def vocabulary(count_rows: DataFrame, n_docs: int, min_df: float = 0.001, max_df: float = 0.8, max_features: int = 10_000) -> DataFrame:
    """(token, df, total): within both document-frequency fractions, the most frequent, relaxed once if nothing is left."""
    per = count_rows.groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("total"))
    within = lambda low, high: (F.col("df") >= low * n_docs) & (F.col("df") <= high * n_docs)
    wide = per.withColumn("strict", within(min_df, max_df)).filter(within(min_df - 0.1, max_df + 0.1))
    # The strict ones come first; whether there is one is seen in the rows kept, so the corpus is counted once.
    top = wide.orderBy(F.desc("strict"), F.desc("total"), "token").limit(max_features)
    found = top.agg(F.bool_or("strict").alias("found"))
    return top.crossJoin(F.broadcast(found)).filter(F.col("strict") | ~F.col("found")).select("token", "df", "total").orderBy(F.desc("total"), "token")


def tfidf(count_rows: DataFrame, n_docs: int, few: bool = False, of: DataFrame | None = None) -> DataFrame:
    """(id, token, tfidf): n * (ln((1 + docs) / (1 + df)) + 1), each document of length 1.

    With ``few`` distinct tokens (a bounded vocabulary) every task holds their frequencies, and rows stay where they are.
    ``of`` (rows as count_rows) are those of the documents asked for, where these are not all; frequencies are of all.
    """
    df = count_rows.groupBy("token").agg(F.count("*").alias("df"))
    raw = (count_rows if of is None else of).join(F.broadcast(df) if few else df, "token").withColumn("raw", F.col("n") * (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1))
    return raw.select("id", "token", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))).alias("tfidf"))


def frequent_tokens(token_rows: DataFrame, fraction: float = 0.1, least: int = 20) -> DataFrame:
    """(token, value): the most frequent, at least ``least``; value is the count over the number of distinct tokens."""
    per = token_rows.groupBy("token").agg(F.count("*").alias("n"))
    distinct = per.agg(F.count("*").alias("distinct"))
    top = max(least, int(fraction * (distinct.first()[0] or 0)))
    return per.crossJoin(F.broadcast(distinct)).orderBy(F.desc("n"), "token").limit(top).select("token", (F.col("n") / F.col("distinct")).alias("value"))


def popular_terms(token_rows: DataFrame, n: int = 50) -> DataFrame:
    return token_rows.groupBy("token").agg(F.countDistinct("id").alias("docs")).orderBy(F.desc("docs"), "token").limit(n)


def term_timeline(token_rows: DataFrame, years: DataFrame, terms: DataFrame) -> DataFrame:
    """(token, year, docs): documents of each year that hold each term."""
    held = token_rows.join(terms.select("token"), "token", "left_semi").select("id", "token").distinct()
    return held.join(years.select("id", "year"), "id").groupBy("token", "year").agg(F.count("*").alias("docs"))


def lowess(x: np.ndarray, y: np.ndarray, frac: float = 0.2, rounds: int = 3) -> np.ndarray:
    """Locally weighted lines at every x: tricube weights over the nearest frac of points, then bisquare reweighting."""
    n = len(x)
    k = min(n, max(2, int(frac * n + 1e-10)))
    away = np.abs(x[:, None] - x[None, :])
    reach = np.maximum(np.sort(away, axis=1)[:, k - 1], 1e-12)[:, None]
    near = np.clip(1 - (away / reach) ** 3, 0, None) ** 3
    trust, fit = np.ones(n), y.astype(float)
    for _ in range(rounds + 1):
        w = near * trust
        total = w.sum(axis=1)
        safe = np.where(total > 0, total, 1.0)
        mx, my = (w * x).sum(axis=1) / safe, (w * y).sum(axis=1) / safe
        dx = x[None, :] - mx[:, None]
        spread = (w * dx * dx).sum(axis=1)
        slope = np.where(spread > 1e-12, (w * dx * (y[None, :] - my[:, None])).sum(axis=1) / np.where(spread > 1e-12, spread, 1.0), 0.0)
        fit = np.where(total > 0, my + slope * (x - mx), y)
        off = np.abs(y - fit)
        scale = 6 * np.median(off)
        if scale <= 1e-12:
            break
        trust = np.clip(1 - (off / scale) ** 2, 0, None) ** 2
    return fit


def smoothed_timeline(timeline: DataFrame, frac: float = 0.2) -> DataFrame:
    """(token, year, docs, smooth): a term's years without gaps, smoothed, whole numbers from 0 up.  A group is one term's years."""
    span = timeline.groupBy("token").agg(F.sequence(F.min("year"), F.max("year")).alias("years")).select("token", F.explode("years").alias("year"))
    full = span.join(timeline, ["token", "year"], "left").na.fill(0, ["docs"])

    def smooth(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("year")
        fit = lowess(group["year"].to_numpy(float), group["docs"].to_numpy(float), frac)
        return group.assign(smooth=np.clip(fit + 1e-9, 0, None).astype("int64"))[["token", "year", "docs", "smooth"]]

    return full.groupBy("token").applyInPandas(smooth, "token string, year int, docs long, smooth long")


def document_embeddings(weights: DataFrame, vectors: DataFrame, vocabulary_size: int) -> DataFrame:
    """(id, vector): mean over the vocabulary of tfidf * token vector.

    A document's weights meet in a row, and every task holds the vectors, which are as many as the (bounded) vocabulary has
    tokens; so no vector is copied to the tokens of documents.
    """
    kind = dict(weights.dtypes)["id"]
    held = vectors.select("token", F.col("vector").cast("array<double>").alias("vector")).toArrow().combine_chunks()
    names, numbers = held.column("token").combine_chunks(), held.column("vector").combine_chunks().flatten().to_numpy()
    table = numbers.reshape(len(names), -1) if len(names) else np.zeros((0, 0))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, flat = batch.column("held"), batch.column("held").flatten()
            place, w = pc.index_in(flat.field("token"), names).fill_null(-1).to_numpy(), flat.field("tfidf").to_numpy()
            ends = np.cumsum(lists.value_lengths().to_numpy())
            found = [(at, place[a:b], w[a:b]) for at, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends)) if (place[a:b] >= 0).any()]
            rows = [x[p >= 0] @ table[p[p >= 0]] / vocabulary_size for _, p, x in found]
            taken = batch.column("id").take(pa.array([at for at, _, _ in found], pa.int32()))
            yield pa.record_batch([taken, pa.array(rows, pa.list_(pa.float64()))], ["id", "vector"])

    lists = weights.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("token", "tfidf"))).alias("held"))
    return lists.mapInArrow(summed, f"id {kind}, vector array<double>")


def mean_vectors(chunks: DataFrame, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, dim, value): mean of a document's chunk vectors."""
    t = chunks.select(id_col, F.posexplode(vector).alias("dim", "x"))
    return t.groupBy(id_col, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def chunks(texts: DataFrame, max_tokens: int = 128, overlap: int = 1) -> DataFrame:
    """(id, chunk, text): sentences packed up to max_tokens words; a new chunk starts with the last ``overlap`` sentences.

    A sentence longer than the limit stands alone.  The fold over a document's own sentences is an array aggregate.
    """
    sents = F.filter(F.split(F.col("abstract"), r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 0)
    words = lambda s: F.size(F.split(F.trim(s), r"\s+"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, s: n + words(s))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        fits = (total(acc["open"]) + words(s) <= max_tokens) | (F.size(acc["open"]) == 0)
        tail = F.slice(acc["open"], F.greatest(F.size(acc["open"]) - overlap + 1, F.lit(1)), F.lit(overlap)) if overlap else F.array().cast("array<string>")
        carried = F.when(total(tail) + words(s) <= max_tokens, F.concat(tail, F.array(s))).otherwise(F.array(s))
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.array_join(acc["open"], " ")))).alias("done"), F.when(fits, F.concat(acc["open"], F.array(s))).otherwise(carried).alias("open"))

    split = texts.select("id", "abstract", sents.alias("sents"))
    folded = split.withColumn("f", F.aggregate("sents", start, step))
    parts = F.when(F.size("sents") > 0, F.concat("f.done", F.array(F.array_join("f.open", " ")))).otherwise(F.array("abstract"))
    return folded.select("id", F.posexplode(parts).alias("chunk", "text"))
