"""Change records: from a replication log to the map of signatures that rows should have.

A record has a log position ``lsn``, an operation ``op`` (I, U, D, T or others), and the row's columns as text. Inserts and updates
count; deletes, truncations and messages say nothing about signatures. Records without a key are dropped. The last record of
a key decides, over the whole log and not only within a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.canonical import row_text
from tidemark.functions.hashing import row_signature
from tidemark.functions.mappers import RowMapper
from tidemark.operators.scans import Hash, unsigned_signature
from tidemark.sources.spec import TableSpec, schema_and_table


def of_table(log: DataFrame, spec: TableSpec, schema_col: str = "schema", table_col: str = "table") -> DataFrame:
    """Records of one table; schema ``public`` where the spec names none."""
    schema, table = schema_and_table(spec.table)
    return log.where((F.col(schema_col) == schema) & (F.col(table_col) == table))


def decode_tuple(log: DataFrame, columns: list[str], kinds: str = "kinds", values: str = "values") -> DataFrame:
    """Columns from arrays of kinds and values: t (text) and b (binary, as text) give the value, n (null), u (unchanged and not
    sent) and others null."""
    out = {}
    for i, c in enumerate(columns):
        kind = F.get(kinds, F.lit(i))
        out[c] = F.when(kind.isin("t", "b"), F.get(values, F.lit(i)))
    return log.withColumns(out)


def row_records(log: DataFrame, pk: str, op: str = "op") -> DataFrame:
    """Inserts and updates with a key."""
    return log.where(F.col(op).isin("I", "U") & F.col(pk).isNotNull())


def last_write(log: DataFrame, pk: str, lsn: str = "lsn") -> DataFrame:
    """The last record of each key (equal positions: the greatest record), partially aggregated before the shuffle."""
    rest = [c for c in log.columns if c not in (pk, lsn)]
    best = log.groupBy(pk).agg(F.max(F.struct(lsn, *rest)).alias("__last"))
    return best.select(*[F.col(pk) if c == pk else F.col(f"__last.{c}").alias(c) for c in log.columns])


def hashed(log: DataFrame, spec: TableSpec, mapper: RowMapper, hash_: Hash = row_signature, target_hash: Hash = unsigned_signature, op: str = "op", lsn: str = "lsn") -> DataFrame:
    """pk, source_hash, target_hash, lsn for each insert and update: a projection, for batches and streams alike."""
    records = row_records(log, spec.pk, op)
    mapper.set_schema(spec.families("source"), spec.families("target"))
    texts = records.select(F.col(spec.pk).cast("bigint").alias("pk"), row_text(spec.source_columns).alias("__s"), mapper.source_text([F.col(c) for c in spec.source_columns]).alias("__t"), F.col(lsn).cast("bigint").alias("lsn"))
    return texts.select("pk", hash_(F.col("__s")).alias("source_hash"), target_hash(F.col("__t")).alias("target_hash"), "lsn")


def newest_changes(changes: DataFrame) -> DataFrame:
    """The change map: one row for each key of hashed records (pk, source_hash, target_hash, lsn)."""
    return last_write(changes, "pk").drop("lsn")


def upsert_map(state_map: DataFrame, changes: DataFrame) -> DataFrame:
    """pk, source_hash, target_hash: the newer map laid over the older one, each column for itself."""
    new = changes.select("pk", F.col("source_hash").alias("s1"), F.col("target_hash").alias("t1"))
    both = state_map.select("pk", "source_hash", "target_hash").join(new, "pk", "full")
    return both.select("pk", F.coalesce("s1", "source_hash").alias("source_hash"), F.coalesce("t1", "target_hash").alias("target_hash"))
