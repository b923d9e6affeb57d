"""Validation cycles: from tables, or from scan files, to the next state and its counts."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.mappers import RowMapper
from tidemark.operators import reconcile, scans
from tidemark.plans.state import StateStore
from tidemark.sources import tables
from tidemark.sources.spec import TableSpec


@dataclass(frozen=True)
class DataSet:
    """What one observation gives."""

    target_scan: DataFrame | None = None
    source_scan: DataFrame | None = None
    source_changes: DataFrame | None = None
    source_extract: DataFrame | None = None

    @staticmethod
    def from_files(spark: SparkSession, target_scan: str = "", source_scan: str = "", source_changes: str = "", source_extract: str = "") -> DataSet:
        def read(path: str, schema: str) -> DataFrame | None:
            return tables.read_scan(spark, path, schema) if path else None

        return DataSet(read(target_scan, tables.TARGET_SCAN), read(source_scan, tables.SOURCE_SCAN), read(source_changes, tables.EXTRACT), read(source_extract, tables.EXTRACT))


def fetch(source: DataFrame, target: DataFrame, spec: TableSpec, mapper: RowMapper, initial: bool, changes: DataFrame | None = None, version: str | None = None, deleted: str | None = None) -> DataSet:
    """The scans of a cycle over rows that are read here, as plans: nothing is read before they are used, and then both sides are read
    in one job. The mapper renders both sides, so an unchanged copy has the hashes that the extract foretells."""
    target_scan = scans.target_scan(target, spec, version=version, deleted=deleted, mapper=mapper)
    if initial:
        return DataSet(target_scan=target_scan, source_extract=scans.extract_scan(source, spec, mapper))
    return DataSet(target_scan=target_scan, source_scan=scans.source_scan(source, spec), source_changes=changes)


def next_state(data: DataSet, before: DataFrame | None, initial: bool, engine: str = "union") -> DataFrame:
    """The state after the observation, keys that are gone left out."""
    if initial:
        return reconcile.without_gone(reconcile.initial_load(data.source_extract, data.target_scan, engine))
    return reconcile.without_gone(reconcile.incremental(before, data.source_scan, data.target_scan, data.source_changes, engine))


@dataclass(frozen=True)
class Outcome:
    version: int
    counts: dict[str, int]
    seconds: float


def run_cycle(store: StateStore, data: DataSet, initial: bool = False, version: int | None = None, engine: str = "union") -> Outcome:
    """Write the next state and count its rows. An initial load starts over: older versions go, but only when the new one is there.
    A version that is there already is not made again, so a cycle can be repeated after a failure."""
    began = time.time()
    have = store.versions()
    if version is None or version not in have:
        version = store.write(next_state(data, None if initial else store.read(), initial, engine), version)
    if initial:
        store.start_from(version)
    counts = reconcile.metrics(store.read(version)).first().asDict()
    return Outcome(version, counts, time.time() - began)


def explain(data: DataSet, before: DataFrame | None, initial: bool = False, engine: str = "union", mode: str = "formatted") -> str:
    """The physical plan of a cycle, as text."""
    df = next_state(data, before, initial, engine)
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def shuffles(df: DataFrame) -> int:
    """How many times a plan shuffles rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange SinglePartition")


def size_mismatch(state: DataFrame) -> DataFrame:
    """One row: how many keys only one side has. A first load calls phantom rows valid; this shows that there are some."""
    return state.agg(
        F.count_if(F.col("target_signature").isNull()).alias("source_only"),
        F.count_if(F.col("source_signature").isNull()).alias("target_only"),
    )
