"""Table maintenance as pure functions of tables, and the few writers."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUNDLE_VERSION = 1


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; one of the machine's own only where all runs on this machine (tests)."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs within leaves no shuffle files, which else stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder: what loops go on from, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again.  For loops whose columns derive from their own last state: a
    checkpoint keeps what the optimiser inferred about columns, which doubles with every round, and a table does not."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstored(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote and that nothing reads any more, as a loop's last state but one."""
    for df in tables:
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            if not re.fullmatch(r"rows-[0-9a-f]{32}", folder.rpartition("/")[2]):
                raise ValueError(f"{folder} is no table of stored()")
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


MAX_TITLE = 1023


def upsert(base: DataFrame, updates: DataFrame, key: str = "id", newest: str | None = None) -> DataFrame:
    """Rows of updates replace those of base.

    Of several updates of a key the newest wins, ties and updates without ``newest`` to the greatest row, so the result is
    always the same.  A title is cut to MAX_TITLE characters; an empty abstract is stored as null.
    """
    columns = base.columns
    if "title" in columns:
        updates = updates.withColumn("title", F.substring("title", 1, MAX_TITLE))
    if "abstract" in columns:
        updates = updates.withColumn("abstract", F.nullif("abstract", F.lit("")))
    rest = [c for c in updates.columns if c not in (key, newest)]
    row = F.struct(*([newest] if newest else []), *rest)
    last = updates.groupBy(key).agg(F.max(row).alias("_last")).select(key, "_last.*")
    return base.join(last.select(key), key, "left_anti").unionByName(last.select(columns))


def baseline_gate(incoming: DataFrame, known: DataFrame, edges: DataFrame) -> DataFrame:
    """Incoming papers that are new, or known without outgoing citations while they now bring references."""
    new = incoming.join(known.select("id"), "id", "left_anti")
    bare = incoming.join(known.select("id"), "id", "left_semi").join(edges.select(F.col("id_out").alias("id")), "id", "left_anti").filter(F.size("refs") > 0)
    return new.unionByName(bare)


def citation_edges(pubs: DataFrame) -> DataFrame:
    return pubs.select(F.col("id").alias("id_out"), F.explode(F.array_distinct("refs")).alias("id_in"))


def cascade_delete(pubs: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "id_out"), "id_out", "left_anti").join(gone.withColumnRenamed("id", "id_in"), "id_in", "left_anti")
    return pubs.join(gone, "id", "left_anti"), left.select(edges.columns)


def weighted_tokens(texts: DataFrame) -> DataFrame:
    """(id, field, pos, token, weight): the full-text table, title 1.0 and abstract 0.4."""
    part = lambda c, w: texts.select("id", F.lit(c).alias("field"), F.posexplode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))).alias("pos", "token"), F.lit(w).alias("weight"))
    return part("title", 1.0).unionByName(part("abstract", 0.4))


def write_by_year(rows: DataFrame, path: str) -> None:
    """Tab-separated, compressed, a folder a year; years that are already there are left as they are."""
    try:
        there = rows.sparkSession.read.option("sep", "\t").csv(path).select(F.col("year").cast(rows.schema["year"].dataType)).distinct()
        rows = rows.join(there, "year", "left_anti")
    except AnalysisException:
        pass  # nothing is there yet
    rows.write.mode("append").partitionBy("year").option("sep", "\t").option("compression", "gzip").csv(path)


def stage(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, computed and written first if it is not there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        compute().write.parquet(path)
        return spark.read.parquet(path)


def write_id_map(ids: DataFrame, path: str, size: int) -> DataFrame:
    """The ids of an index by place, compressed; their number must be the index's."""
    ids.write.option("compression", "gzip").parquet(path)
    written = ids.sparkSession.read.parquet(path)
    found = written.count()
    if found != size:
        raise ValueError(f"{found} ids for an index of {size} rows")
    return written


def backfilled_years(pubs: DataFrame, dates: DataFrame) -> DataFrame:
    """pubs (id, ...) with ``year`` from dates (id, date), whether or not they had the column; a paper without a date keeps its year.

    Of several dates of a paper the latest counts.
    """
    pubs = pubs if "year" in pubs.columns else pubs.withColumn("year", F.lit(None).cast("int"))
    told = dates.groupBy("id").agg(F.year(F.max("date")).alias("_year"))
    return pubs.join(told, "id", "left").withColumn("year", F.coalesce("_year", "year")).select(pubs.columns)


def write_table(rows: DataFrame, path: str) -> None:
    """Comma-separated and compressed, without the columns of single years."""
    rows.select([c for c in rows.columns if not c.isdigit()]).write.option("header", True).option("compression", "gzip").csv(path)


def save_bundle(tables: dict[str, DataFrame], path: str) -> None:
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps({"version": BUNDLE_VERSION, "tables": sorted(tables)}),)], "value string").coalesce(1).write.text(f"{path}/meta-{uuid.uuid4().hex}")


def load_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    meta = json.loads(spark.read.text(f"{path}/meta-*").first()[0])
    if meta["version"] != BUNDLE_VERSION:
        raise ValueError(f"bundle version {meta['version']}, expected {BUNDLE_VERSION}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}


def graph_nodes(pubs: DataFrame, degree: DataFrame) -> DataFrame:
    """Node table of a graph export, as one JSON text a node."""
    j = pubs.join(degree.select(F.col("node").alias("id"), "degree"), "id", "left").na.fill(0, ["degree"])
    return j.select("id", F.to_json(F.struct(*(c for c in j.columns if c != "id"))).alias("attributes"))


def upsert_batches(updates: DataFrame, path: str, checkpoint: str, key: str = "id"):
    """Stream of updates into versioned tables under path: each micro-batch writes the next version from the last."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.parquet(f"{path}/v{number - 1}") if number else batch.limit(0)
        fresh_rows = upsert(known, batch, key)
        fresh_rows.write.mode("overwrite").parquet(f"{path}/v{number}")

    return updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
