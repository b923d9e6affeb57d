"""Words, lines, tables and checkpoints that several operators use."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of ASCII white space part words; whatever else stands between them is a word.
GAP = r"[\x20\x09-\x0D]+"
#: Rows (of a few numbers) that one task takes at a time without a loss.
SMALL = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """A text, null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column | str) -> Column:
    """The words of a text in order, as array<string>; none for null."""
    return F.array_remove(F.split(whole(text), GAP), "")


def remainder(id_col: str, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n; null ids count as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's, or one of our own where none is set and all runs on one machine (tests)."""
    sc = spark.sparkContext
    if (now := sc._jsc.sc().getCheckpointDir()).isDefined():
        return now.get()
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tidemark-checkpoints-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, with no lineage behind them."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame, n: int, each: int = SMALL) -> DataFrame:
    """df, a relation of n rows, in partitions of some ``each`` rows. Small relations that are joined and grouped again and again, as
    those of a graph, otherwise take a task and its files for every partition of the session; in one partition they need no exchange."""
    return df.coalesce(max(1, -(-n // each)))


def settled(df: DataFrame, condition: Column) -> DataFrame:
    """The rows where a condition on computed columns holds. Those columns are made once: a filter would otherwise be moved below
    the projection that makes them, and make them again for each mention. (Filters don't move below what is not deterministic.)"""
    return df.withColumn("__part", F.spark_partition_id()).where(condition & (F.col("__part") >= 0)).drop("__part")


def meet(rows: DataFrame, side: DataFrame, on: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with side, which has each key once and in ``size`` how many of the rows have it. ``total`` is the number of rows.

    Keys of over a ten-thousandth of the rows (and over 100) are at most 10,000 in number, whatever the data: they go to all tasks,
    so their rows stay where they are. All other keys are joined by a shuffle, where no key is hot. Keys are never null. Up to
    SMALL rows in all are simply joined.
    """
    if total <= SMALL:
        return rows.join(side, on, how)
    most = max(100, total // 10_000)
    hot = side.where(F.col(size) > most).withColumn("__hot", F.lit(True))
    tried = rows.join(F.broadcast(hot), on, "left")
    there = tried.where("__hot").drop("__hot")
    rest = tried.where("__hot IS NULL").select(*rows.columns)
    return there.unionByName(rest.join(side.where(F.col(size) <= most), on, how))
