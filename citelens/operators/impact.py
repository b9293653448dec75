"""Features of papers, authors and topics for citation-impact models, and their splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citelens.operators import reports


def topic_popularity(mixtures: DataFrame, pubs: DataFrame) -> DataFrame:
    """(year, topic, popularity, rank): summed shares of a topic in each year's papers (id, topic, p), largest first."""
    s = mixtures.join(pubs.select("id", "year"), "id").groupBy("year", "topic").agg(F.round(F.sum("p"), 9).alias("popularity"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("popularity"), "topic")))


def diversity(mixtures: DataFrame) -> DataFrame:
    """(id, diversity): sum of p * ln p over a paper's topics; shares of 0 add nothing."""
    p = F.col("p")
    return mixtures.groupBy("id").agg(F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0)).alias("diversity"))


def productivity(edges: DataFrame, authored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key_out, key_in, weight), (author, productivity)): the author citation graph and its loops' weights."""
    a = authored.select(F.col("id").alias("id_out"), F.col("author").alias("key_out"))
    b = authored.select(F.col("id").alias("id_in"), F.col("author").alias("key_in"))
    graph = edges.join(a, "id_out").join(b, "id_in").groupBy("key_out", "key_in").agg(F.count("*").alias("weight"))
    return graph, graph.filter("key_out = key_in").select(F.col("key_out").alias("author"), F.col("weight").alias("productivity"))


def author_features(papers: DataFrame, authorship: DataFrame, cuts: DataFrame) -> DataFrame:
    """(author, cut, mean, rank, h_index, g_index, coauthors) from papers (id, year, total) up to each cut-off year.

    The team size of a paper is counted before the join, so that no pair of its authors is built; cuts are a few years.
    """
    team = authorship.groupBy("id").agg((F.count("*") - 1).alias("others"))
    rows = authorship.join(papers.join(team, "id"), "id").join(F.broadcast(cuts.select("cut").distinct()), F.col("year") <= F.col("cut"))
    key = F.struct("author", "cut")
    mates = rows.groupBy("author", "cut").agg(F.avg("others").alias("coauthors"))
    indices = reports.impact_indices(rows.withColumn("key", key), "key").select("key.author", "key.cut", F.col("mean"), "h_index", "g_index")
    rank = F.rank().over(Window.partitionBy("cut").orderBy(F.desc(F.round("mean", 9))))
    return indices.join(mates, ["author", "cut"]).withColumn("rank", rank)


def paper_author_means(authorship: DataFrame, features: DataFrame, columns: list[str], first: int = 10) -> DataFrame:
    """(id, columns): means over a paper's first authors and its last one (authorship: id, pos, author; absent ones are left out)."""
    last = F.max("pos").over(Window.partitionBy("id"))
    few = authorship.withColumn("last", last).filter((F.col("pos") < first) | (F.col("pos") == F.col("last")))
    return few.join(features, "author", "left").groupBy("id").agg(*(F.avg(c).alias(c) for c in columns))


def feature_matrix(pubs: DataFrame, parts: list[DataFrame], logged: list[str], now: int) -> DataFrame:
    """pubs (id, year) with recency, the columns of each part (id, ...) and log1p_ columns; a missing value stays null."""
    out = pubs.withColumn("recency", F.lit(now) - F.col("year"))
    for part in parts:
        out = out.join(part, "id", "left")
    return out.select("*", *(F.log1p(c).alias(f"log1p_{c}") for c in logged))


def time_split(rows: DataFrame, step: int, recency: int = 11) -> DataFrame:
    """rows with split: train where the paper is older than ``recency``, validate from there down to step + 2 years, else null."""
    r = F.col("recency")
    return rows.withColumn("split", F.when(r > recency, "train").when(r > step + 1, "validate"))


def resampled(rows: DataFrame, times: int, share: float = 0.8, id_col: str = "id") -> DataFrame:
    """rows with sample (0 to times - 1): each sample holds a row with the given chance, decided by a hash of its id."""
    draws = rows.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    place = F.conv(F.substring(F.md5(F.concat_ws("-", "sample", id_col)), 1, 8), 16, 10).cast("long")
    return draws.filter(place < int(share * 2**32))
