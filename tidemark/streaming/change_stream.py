"""Change logs as Structured Streaming sources.

The log is a folder of files that grows (or any other streaming source with the same columns). Offsets live in the stream's
checkpoint; ``availableNow`` takes all that was there when the run began and then ends, which bounds a cycle as a log position
does. Each micro-batch is hashed, reduced to the last write of each key, and written under its batch number, so a batch that is
run again replaces itself.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.functions.hashing import row_signature
from tidemark.functions.mappers import RowMapper
from tidemark.operators import changes as ch
from tidemark.operators.scans import Hash, unsigned_signature
from tidemark.plans.cycle import DataSet, run_cycle
from tidemark.plans.state import StateStore
from tidemark.sources.spec import TableSpec

CHANGES = "pk bigint, source_hash bigint, target_hash decimal(20,0), lsn bigint"


def read_log(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start(log: DataFrame, spec: TableSpec, mapper: RowMapper, out: str, checkpoint: str, op: str = "op", lsn: str = "lsn", continuous: str | None = None, hash_: Hash = row_signature, target_hash: Hash = unsigned_signature) -> StreamingQuery:
    """Begin to consume the log into ``out``. Without ``continuous`` (a processing interval) the query ends by itself."""

    def write(batch: DataFrame, number: int) -> None:
        last = ch.last_write(batch, "pk")
        last.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = ch.hashed(log, spec, mapper, hash_, target_hash, op, lsn).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)).start()


def consume(log: DataFrame, spec: TableSpec, mapper: RowMapper, out: str, checkpoint: str, op: str = "op", lsn: str = "lsn", hash_: Hash = row_signature, target_hash: Hash = unsigned_signature) -> DataFrame:
    """Consume what is there to its end; the change map of all batches so far, empty if there were none."""
    start(log, spec, mapper, out, checkpoint, op, lsn, None, hash_, target_hash).awaitTermination()
    return change_map(log.sparkSession, out)


def until_idle(query: StreamingQuery, seconds: float = 10.0, every: float = 0.2) -> int:
    """Let a continuous query run until no rows have come for so long, then stop it; the number of rows that came. A log that never rests
    is bounded by ``availableNow`` instead."""
    rows, last, newest = 0, time.monotonic(), -1
    while query.isActive:
        for p in query.recentProgress:
            if p["batchId"] > newest and p["numInputRows"] > 0:
                rows, last, newest = rows + p["numInputRows"], time.monotonic(), p["batchId"]
        if query.exception() is None and time.monotonic() - last >= seconds and not query.status["isTriggerActive"]:
            query.stop()
        time.sleep(every)
    if (e := query.exception()) is not None:
        raise e
    return rows


def _folders(spark: SparkSession, out: str) -> tuple[int, list[int], list[int]]:
    """The number up to which batches are in a base (-1: none), the batches after it, and the batches and bases that are not needed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    done = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{out}/{n}/_SUCCESS"))]
    base = max((int(n[5:]) for n in done if n.startswith("base=")), default=-1)
    batches = sorted(int(n[6:]) for n in done if n.startswith("batch="))
    old = [n for n in names if n.startswith("base=") and n != f"base={base}" or n.startswith("batch=") and int(n[6:]) <= base]
    return base, [n for n in batches if n > base], old


def _logged(spark: SparkSession, out: str) -> DataFrame | None:
    base, batches, _ = _folders(spark, out)
    paths = [f"{out}/base={base}"] * (base >= 0) + [f"{out}/batch={n}" for n in batches]
    return spark.read.schema(CHANGES).parquet(*paths) if paths else None


def change_map(spark: SparkSession, out: str) -> DataFrame:
    """pk, source_hash, target_hash from the base and the batches under ``out``."""
    logged = _logged(spark, out)
    return spark.createDataFrame([], CHANGES).drop("lsn") if logged is None else ch.newest_changes(logged)


def compact(spark: SparkSession, out: str) -> None:
    """Reduce all batches so far to the last write of each key, so that later cycles don't read the whole log again. The new base counts
    when it is whole; only then older folders go."""
    _, batches, _ = _folders(spark, out)
    if batches:
        ch.last_write(_logged(spark, out), "pk").write.mode("overwrite").parquet(f"{out}/base={batches[-1]}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in _folders(spark, out)[2]:
        fs.delete(path(f"{out}/{name}"), True)


def run_on_batches(log: DataFrame, store: StateStore, source_scan: DataFrame, target_scan: DataFrame, spec: TableSpec, mapper: RowMapper, checkpoint: str, op: str = "op", lsn: str = "lsn") -> StreamingQuery:
    """Each micro-batch of the log is one incremental cycle against the scans. State versions count on from the
    initial load's by the batch's number, so a repeated batch changes nothing."""
    if store.current() is None:
        raise ValueError("load the state first")
    first = store.first()

    def cycle(batch: DataFrame, number: int) -> None:
        run_cycle(store, DataSet(target_scan=target_scan, source_scan=source_scan, source_changes=ch.newest_changes(batch)), version=first + number + 1)

    return ch.hashed(log, spec, mapper, op=op, lsn=lsn).writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stop_all(spark: SparkSession) -> None:
    """Stop all streams and running jobs of the session."""
    for q in spark.streams.active:
        q.stop()
    spark.sparkContext.cancelAllJobs()


