"""Observations of two tables wherever they are: scans by the databases that can hash, rows and hashes here otherwise.

A source in PostgreSQL is hashed by its own hashtextextended, a destination in ClickHouse by its own xxh3; one number a row crosses
the network. The extract of an initial load reads whole source rows, and has to foretell the destination's hashes: it is
hashed here, by the same functions. Tables in files, and in databases that don't hash, are hashed by XXH64 on both sides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from tidemark.functions.hashing import pg_hash, row_signature, unsigned, xxh3
from tidemark.functions.mappers import RowMapper
from tidemark.operators import scans
from tidemark.operators.scans import Hash
from tidemark.plans.cycle import DataSet
from tidemark.sources.spec import TableSpec
from tidemark.sources.tables import Database, Files


def _unsigned_pg(text: Column) -> Column:
    return unsigned(pg_hash(text))


def source_hash(table: Files | Database) -> Hash:
    """The function that gives the source's own hashes."""
    return pg_hash if isinstance(table, Database) and table.kind == "postgres" else row_signature


def target_hash(table: Files | Database) -> Hash:
    """The function that gives the destination's own hashes, unsigned."""
    if isinstance(table, Database) and table.hashes:
        return xxh3 if table.kind == "clickhouse" else _unsigned_pg
    return scans.unsigned_signature


@dataclass(frozen=True)
class Observer:
    """Both tables of a spec and how to scan them."""

    spark: SparkSession
    spec: TableSpec
    source: Files | Database
    target: Files | Database
    mapper: RowMapper
    version: str | None = None
    deleted: str | None = None

    def _pushed(self, table: Files | Database) -> bool:
        return isinstance(table, Database) and table.hashes

    def source_rows(self) -> DataFrame:
        return self.source.rows(self.spark, self.spec)

    def target_rows(self) -> DataFrame:
        return self.target.rows(self.spark, self.spec, side="target", version=self.version, deleted=self.deleted)

    def source_scan(self) -> DataFrame:
        if self._pushed(self.source):
            return self.source.scan(self.spark, self.spec, "source")
        return scans.source_scan(self.source_rows(), self.spec, source_hash(self.source))

    def extract(self) -> DataFrame:
        return scans.extract_scan(self.source_rows(), self.spec, self.mapper, source_hash(self.source), target_hash(self.target))

    def target_scan(self) -> DataFrame:
        if self._pushed(self.target):
            return self.target.scan(self.spark, self.spec, "target", deleted=self.deleted)
        return scans.target_scan(self.target_rows(), self.spec, target_hash(self.target), self.version, self.deleted, mapper=self.mapper)

    def data(self, initial: bool, changes: DataFrame | None = None) -> DataSet:
        if initial:
            return DataSet(target_scan=self.target_scan(), source_extract=self.extract())
        return DataSet(target_scan=self.target_scan(), source_scan=self.source_scan(), source_changes=changes)

    def inspect(self, pks: list[int]) -> dict[str, DataFrame]:
        """Hashes and texts of some rows: source, extract and target."""
        if self._pushed(self.source):
            source = self.source.scan(self.spark, self.spec, "source", pks, text=True)
        else:
            source = scans.inspect_source(self.source_rows(), self.spec, pks, source_hash(self.source))
        if self._pushed(self.target):
            target = self.target.scan(self.spark, self.spec, "target", pks, text=True, deleted=self.deleted)
        else:
            target = scans.inspect_target(self.target_rows(), self.spec, pks, target_hash(self.target), self.version, self.deleted, mapper=self.mapper)
        extract = scans.inspect_extract(self.source_rows(), self.spec, pks, self.mapper, source_hash(self.source), target_hash(self.target))
        return {"source": source, "extract": extract, "target": target}

    def bytes(self, side: str) -> int:
        """Size of a table, by its files or by the database's own count."""
        return (self.source if side == "source" else self.target).size(self.spark, self.spec, side)
