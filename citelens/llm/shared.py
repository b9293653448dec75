"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelens.sources.tables import cut, shared_folder

__all__ = ["WORD", "ascii_lower", "cut", "fresh", "join_counted", "stored", "table", "with_checkpoints"]

#: White space that parts words, and the rest (ASCII only, so every engine agrees on it).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Makes checkpoint() usable, in the folder that the cluster names."""
    shared_folder(spark)
    return spark


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: compressed, and only the columns asked for."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    return stem if stem.lower() not in {c.lower() for c in df.columns} else f"{stem}_{uuid.uuid4().hex[:8]}"


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key and says in ``count`` how many rows of left have it; count goes.

    Keys with more than a thousandth of left's ``total`` rows, of which there are fewer than a thousand, meet by broadcast and
    are never shuffled into one task; all others meet by whatever join Spark picks.  left is read twice, so cut it first.
    """
    often = F.col(count) * 1000 > total
    hot = right.filter(often)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.filter(~often).drop(count), key, how)
    return cold.unionByName(left.join(F.broadcast(hot.drop(count)), key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
