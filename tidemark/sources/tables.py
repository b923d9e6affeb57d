"""Readers: a table's rows from files or over JDBC, scan files with fixed schemas, and sizes."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.canonical import NULL_MARK
from tidemark.sources.spec import TableSpec, database_of, jdbc_options, quote

# Fixed schemas of scan files: nothing is inferred.
SOURCE_SCAN = "pk bigint, source_hash bigint"
TARGET_SCAN = "pk bigint, target_hash decimal(20,0)"
EXTRACT = "pk bigint, source_hash bigint, target_hash decimal(20,0)"
SOURCE_INSPECT = SOURCE_SCAN + ", source_text string"
TARGET_INSPECT = TARGET_SCAN + ", target_text string"
EXTRACT_INSPECT = EXTRACT + ", source_text string, target_text string"


def read_scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A scan file (CSV with a header, RFC 4180 quotes, or Parquet by its suffix) as a typed table."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    return spark.read.schema(schema).csv(path, header=True, escape='"', multiLine="text" in schema, mode="FAILFAST")


def threads(name: str, default: int) -> int:
    """A positive whole number from the environment."""
    text = os.environ.get(name)
    if text is None or text == "":
        return default
    if not text.isdigit() or int(text) < 1:
        raise ValueError(f"{name} must be a positive integer, not {text!r}")
    return int(text)


def bytes_of(df: DataFrame) -> int:
    """Bytes of the files behind a table, by the file system that Spark reads them from."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


@dataclass(frozen=True)
class Files:
    """A table in files that Spark reads: Parquet unless the path says otherwise."""

    path: str

    def rows(self, spark: SparkSession, spec: TableSpec, schema: str | None = None, side: str = "source", version: str | None = None, deleted: str | None = None) -> DataFrame:
        suffix = self.path.rstrip("/").rpartition(".")[2].lower()
        kind = suffix if suffix in ("csv", "json", "orc", "parquet") else "parquet"
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.csv(self.path, header=True, escape='"') if kind == "csv" else reader.format(kind).load(self.path)

    def size(self, spark: SparkSession, spec: TableSpec, side: str = "source") -> int:
        return bytes_of(self.rows(spark, spec))


@dataclass(frozen=True)
class Database:
    """A table over JDBC. Hashes are computed by the database, so one number a row crosses the network; reads are split by
    ranges of the key between the least and the greatest, which the database is asked for. ``load`` runs a statement given as
    reader options; tests have their own."""

    url: str
    driver: str = ""
    partitions: int = 0
    load: Callable[[SparkSession, dict[str, str]], DataFrame] | None = None

    @property
    def kind(self) -> str:
        return database_of(self.url)

    def _mark(self) -> str:
        return '"' if self.kind == "postgres" else "`"

    def _text(self, columns: list[str]) -> str:
        q = [quote(c, self._mark()) for c in columns]
        if self.kind == "postgres":
            return "concat(" + ", ".join(f"COALESCE({c}::text, '{NULL_MARK}')" for c in q) + ")"
        if self.kind == "clickhouse":
            return "concat(" + ", ".join(f"ifNull(CAST({c} AS String), '{NULL_MARK}')" for c in q) + ")"
        return "concat(" + ", ".join(f"COALESCE(CAST({c} AS CHAR), '{NULL_MARK}')" for c in q) + ")"

    @property
    def hashes(self) -> bool:
        """Whether the database can hash rows itself."""
        return self.kind in ("postgres", "clickhouse")

    def hash_query(self, spec: TableSpec, side: str, pks: list[int] | None = None, text: bool = False, deleted: str | None = None) -> str:
        """The statement of a hash scan; with ``text`` also the hashed text, with ``pks`` only these keys."""
        columns = spec.source_columns if side == "source" else spec.target_columns
        name = spec.table if side == "source" else spec.target_name
        key, row = quote(spec.pk, self._mark()), self._text(columns)
        where = [f"{key} IN ({', '.join(str(int(k)) for k in pks)})"] if pks is not None else []
        shown = f", replace(replace({row}, chr(10), '\\n'), chr(13), '\\r') AS {side}_text" if text else ""
        if self.kind == "postgres":
            value = f"hashtextextended({row}, 1337)"
            if side == "target":
                value = f"CASE WHEN {value} < 0 THEN {value}::numeric + 18446744073709551616 ELSE {value}::numeric END"
            tail = ""
        elif self.kind == "clickhouse":
            shown = shown.replace("chr(", "char(")
            value, tail = f"xxh3({row})", " FINAL"
            where.append(f"{quote(deleted, self._mark()) if deleted else '_peerdb_is_deleted'} = 0")
        else:
            raise ValueError(f"{self.kind} does not hash rows itself; scan its rows instead")
        return f"SELECT {key} AS pk, {value} AS {side}_hash{shown} FROM {quote(name, self._mark())}{tail}" + (" WHERE " + " AND ".join(where) if where else "")

    def size_query(self, spec: TableSpec, side: str) -> str:
        name = (spec.table if side == "source" else spec.target_name).replace("'", "''")
        if self.kind == "postgres":
            return f"SELECT pg_table_size('{name}') AS bytes"
        if self.kind == "clickhouse":
            return f"SELECT sum(data_uncompressed_bytes) AS bytes FROM system.columns WHERE database = currentDatabase() AND table = '{name}'"
        return f"SELECT data_length AS bytes FROM information_schema.tables WHERE table_schema = database() AND table_name = '{name}'"

    def query(self, spark: SparkSession, sql: str, bounds: tuple[str, int, int] | None = None) -> DataFrame:
        """A statement's rows; with the name of a whole-number column and its bounds, in ``partitions`` ranges of it at once."""
        options = jdbc_options(self.url) | ({"driver": self.driver} if self.driver else {})
        if bounds:
            options |= {"dbtable": f"({sql}) t", "partitionColumn": bounds[0], "lowerBound": str(bounds[1]), "upperBound": str(bounds[2] + 1), "numPartitions": str(self.partitions)}
        else:
            options |= {"query": sql}
        return self.load(spark, options) if self.load else spark.read.format("jdbc").options(**options).load()

    def bounds(self, spark: SparkSession, spec: TableSpec, side: str) -> tuple[int, int] | None:
        """The least and greatest key; None for an empty table."""
        key = quote(spec.pk, self._mark())
        name = quote(spec.table if side == "source" else spec.target_name, self._mark())
        (row,) = self.query(spark, f"SELECT min({key}) AS low, max({key}) AS high FROM {name}").collect()
        return None if row[0] is None else (int(row[0]), int(row[1]))

    def _ranged(self, spark: SparkSession, spec: TableSpec, side: str, sql: str, column: str) -> DataFrame:
        found = self.bounds(spark, spec, side) if self.partitions > 1 else None
        return self.query(spark, sql, (column, *found) if found else None)

    def rows(self, spark: SparkSession, spec: TableSpec, schema: str | None = None, side: str = "source", version: str | None = None, deleted: str | None = None) -> DataFrame:
        """The key and the side's columns, with those that a versioned destination has besides."""
        of_side = [*spec.source_columns] if side == "source" else [*spec.target_columns, *[c for c in (version, deleted) if c]]
        columns = ", ".join(quote(c, self._mark()) for c in dict.fromkeys([spec.pk, *of_side]))
        name = spec.table if side == "source" else spec.target_name
        return self._ranged(spark, spec, side, f"SELECT {columns} FROM {quote(name, self._mark())}", spec.pk)

    def scan(self, spark: SparkSession, spec: TableSpec, side: str, pks: list[int] | None = None, text: bool = False, deleted: str | None = None) -> DataFrame:
        """pk and the side's hash (with ``text``, its text too), hashed by the database."""
        sql = self.hash_query(spec, side, pks, text, deleted)
        kinds = {"pk": "bigint", f"{side}_hash": "bigint" if side == "source" else "decimal(20,0)", f"{side}_text": "string"}
        df = self.query(spark, sql) if pks is not None else self._ranged(spark, spec, side, sql, "pk")
        return df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in df.columns])

    def size(self, spark: SparkSession, spec: TableSpec, side: str = "source") -> int:
        (row,) = self.query(spark, self.size_query(spec, side)).collect()
        if row[0] is None:
            raise ValueError(f"{spec.target_name} has no size: is it there?")
        return int(row[0])

    def changes(self, spark: SparkSession, spec: TableSpec) -> DataFrame:
        raise NotImplementedError(f"{self.kind} tables have no change stream here; give change records as files")


def open_table(url: str) -> Files | Database:
    """Reader for a connection string: a database by its scheme, else files. TIDEMARK_READ_PARTITIONS sets in how many ranges of the
    key a database is read at once."""
    return Files(url) if database_of(url) == "files" else Database(url, partitions=threads("TIDEMARK_READ_PARTITIONS", 1))
