"""The driver tables as citation edges, publications, texts, embeddings and log events; each with its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelens.sources.tables import shared_folder


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Orders cite parts."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id_out"), F.col("l_partkey").alias("id_in")).distinct()


def order_edges(spark: SparkSession, d: str) -> DataFrame:
    """An order cites the earlier orders of its customer."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    a, b = o.alias("a"), o.alias("b")
    return a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.struct("b.o_orderdate", "b.o_orderkey") < F.struct("a.o_orderdate", "a.o_orderkey"))).select(F.col("a.o_orderkey").alias("id_out"), F.col("b.o_orderkey").alias("id_in"))


def pubs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as publications."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.col("c_mktsegment").alias("journal"), F.col("o_orderstatus").alias("type"), F.col("c_nationkey").alias("comp"))


def order_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as publications, with in-degree as total."""
    total = edges(spark, d).groupBy(F.col("id_in").alias("id")).agg(F.count("*").alias("total"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("journal"), F.col("p_type").alias("type"), (F.col("p_size") % 10).alias("comp"))
    return p.join(total, "id", "left").na.fill(0, ["total"])


def authorship(spark: SparkSession, d: str) -> DataFrame:
    """(id, author): the suppliers of an order."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("author"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_suppkey").distinct().join(s, "l_suppkey").select("id", "author")


def texts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), F.substring(F.split("text", "\n")[0], 1, 1023).alias("title"), F.col("text").alias("abstract"), "lang", F.col("source").alias("journal"), (F.col("doc_id") % 5).alias("comp"), (1995 + F.col("doc_id") % 7).cast("int").alias("year"), F.lit("Article").alias("type"))


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 2).alias("id"), (F.col("vec_id") % 2).cast("int").alias("chunk"), "embedding", F.col("label").alias("comp"))


def log_events(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"signup": "start", "purchase": "result", "error": "error", "view": "paper", "click": "feature"}
    event = F.col("event_type")
    for k, v in kinds.items():
        event = F.when(F.col("event_type") == k, v).otherwise(event)
    return table(spark, d, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("job"), "ts", event.alias("event"), "value", "props")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key over as many partitions as a shuffle has: for narrow rows of few files whose further work is long."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name under the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: SQL twins, as common table expressions.
SQL = {
    "edges": "edges AS (SELECT DISTINCT l_orderkey AS id_out, l_partkey AS id_in FROM lineitem)",
    "order_edges": "order_edges AS (SELECT a.o_orderkey AS id_out, b.o_orderkey AS id_in FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND (b.o_orderdate < a.o_orderdate OR (b.o_orderdate = a.o_orderdate AND b.o_orderkey < a.o_orderkey)))",
    "pubs": "pubs AS (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INT) AS year, c_mktsegment AS journal, o_orderstatus AS type, c_nationkey AS comp FROM orders JOIN customer ON o_custkey = c_custkey)",
    "parts": "parts AS (SELECT p_partkey AS id, p_name AS title, p_brand AS journal, p_type AS type, p_size % 10 AS comp, coalesce(total, 0) AS total FROM part LEFT JOIN (SELECT id_in, count(*) AS total FROM edges GROUP BY 1) ON id_in = p_partkey)",
    "by_year": "by_year AS (SELECT id_in AS id, CAST(year(o_orderdate) AS INT) AS year, count(*) AS count FROM edges JOIN orders ON o_orderkey = id_out WHERE id_out <> id_in GROUP BY ALL)",
    "authorship": "authorship AS (SELECT DISTINCT l_orderkey AS id, s_name AS author FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)",
    "texts": "texts AS (SELECT doc_id AS id, substr(string_split(text, chr(10))[1], 1, 1023) AS title, text AS abstract, lang, source AS journal, doc_id % 5 AS comp, CAST(1995 + doc_id % 7 AS INT) AS year FROM documents)",
    "tokens": "tokens AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents)",
    "counts": "counts AS (SELECT id, token, count(*) AS n FROM tokens GROUP BY ALL)",
    "events": "ev AS (SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS job, ts, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'result' WHEN 'error' THEN 'error' WHEN 'view' THEN 'paper' WHEN 'click' THEN 'feature' END AS event, value, props FROM events)",
}


def with_tables(names: str, body: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + " " + body
