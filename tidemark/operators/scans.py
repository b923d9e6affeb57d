"""Hash scans: one key and one hash for each row, computed where the rows are read.

All of them are projections of the scan: only mapped columns are read, filters on keys reach the files, and nothing is shuffled
(but to find the latest version of a row that a versioned destination keeps several times).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.canonical import row_text, visible
from tidemark.functions.hashing import row_signature, unsigned
from tidemark.functions.mappers import RowMapper
from tidemark.sources.spec import TableSpec

Hash = Callable[[Column], Column]


def unsigned_signature(text: Column) -> Column:
    return unsigned(row_signature(text))


def with_keys(df: DataFrame, pk: str, pks: Sequence[int] | DataFrame | None) -> DataFrame:
    """Rows with these keys: a list goes to the scan as a filter, a table (one column) is a semi-join."""
    if pks is None:
        return df
    if isinstance(pks, DataFrame):
        keys = pks.select(F.col(pks.columns[0]).alias("__pk")).distinct()
        return df.join(keys, df[pk] == keys["__pk"], "left_semi")
    return df.where(F.col(pk).isin([int(k) for k in pks]))


def latest_versions(df: DataFrame, pk: str, version: str) -> DataFrame:
    """The row with the highest version of each key (equal versions: the greatest row). A partial aggregate runs before the shuffle."""
    rest = [c for c in df.columns if c not in (pk, version)]
    best = df.groupBy(pk).agg(F.max(F.struct(version, *rest)).alias("__row"))
    return best.select(*[F.col(pk) if c == pk else F.col(f"__row.{c}").alias(c) for c in df.columns])


def not_deleted(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose soft-delete flag is 0."""
    return df.where(F.col(flag) == 0)


def final(df: DataFrame, pk: str, version: str | None = None, deleted: str | None = None) -> DataFrame:
    """What a versioned destination shows: the latest version of each key, unless it is deleted."""
    df = latest_versions(df, pk, version) if version else df
    return not_deleted(df, deleted) if deleted else df


def _texts(spec: TableSpec, mapper: RowMapper | None, separator: str) -> tuple[Column, Column | None]:
    cols = [F.col(c) for c in spec.source_columns]
    if mapper is None:
        return row_text(cols, separator), None
    mapper.set_schema(spec.families("source"), spec.families("target"))
    return row_text(cols, separator), mapper.source_text(cols)


def _target_text(spec: TableSpec, mapper: RowMapper | None, separator: str) -> Column:
    """A destination row's text: its columns as they are (databases hash this), or rendered by the mapper where the rows are read here
    and no database has printed them."""
    cols = [F.col(c) for c in spec.target_columns]
    if mapper is None:
        return row_text(cols, separator)
    mapper.set_schema(spec.families("source"), spec.families("target"))
    rendered = getattr(mapper, "rendered", None)
    return rendered(cols, spec.target_families()) if rendered else mapper.target_text(cols)


def source_scan(df: DataFrame, spec: TableSpec, hash_: Hash = row_signature, separator: str = "") -> DataFrame:
    """pk, source_hash."""
    text, _ = _texts(spec, None, separator)
    return df.select(F.col(spec.pk).cast("bigint").alias("pk"), hash_(text).alias("source_hash"))


def extract_scan(df: DataFrame, spec: TableSpec, mapper: RowMapper, hash_: Hash = row_signature, target_hash: Hash = unsigned_signature, separator: str = "") -> DataFrame:
    """pk, source_hash and target_hash, the hash that the row is expected to have in the destination."""
    text, mapped = _texts(spec, mapper, separator)
    staged = df.select(F.col(spec.pk).cast("bigint").alias("pk"), text.alias("__s"), mapped.alias("__t"))
    return staged.select("pk", hash_(F.col("__s")).alias("source_hash"), target_hash(F.col("__t")).alias("target_hash"))


def target_scan(df: DataFrame, spec: TableSpec, hash_: Hash = unsigned_signature, version: str | None = None, deleted: str | None = None, separator: str = "", mapper: RowMapper | None = None) -> DataFrame:
    """pk, target_hash (unsigned)."""
    needed = dict.fromkeys([spec.pk, *([version] if version else []), *spec.target_columns, *([deleted] if deleted else [])])
    df = final(df.select(*needed), spec.pk, version, deleted)
    return df.select(F.col(spec.pk).cast("bigint").alias("pk"), hash_(_target_text(spec, mapper, separator)).alias("target_hash"))


def inspect_source(df: DataFrame, spec: TableSpec, pks: Sequence[int] | DataFrame, hash_: Hash = row_signature, separator: str = "") -> DataFrame:
    """pk, source_hash, source_text of some rows."""
    text, _ = _texts(spec, None, separator)
    staged = with_keys(df, spec.pk, pks).select(F.col(spec.pk).cast("bigint").alias("pk"), text.alias("__s"))
    return staged.select("pk", hash_(F.col("__s")).alias("source_hash"), visible("__s").alias("source_text"))


def inspect_extract(df: DataFrame, spec: TableSpec, pks: Sequence[int] | DataFrame, mapper: RowMapper, hash_: Hash = row_signature, target_hash: Hash = unsigned_signature, separator: str = "") -> DataFrame:
    """pk, both hashes and both texts of some rows. Hashes are of the texts before line ends are written out, as in all scans."""
    text, mapped = _texts(spec, mapper, separator)
    staged = with_keys(df, spec.pk, pks).select(F.col(spec.pk).cast("bigint").alias("pk"), text.alias("__s"), mapped.alias("__t"))
    return staged.select("pk", hash_(F.col("__s")).alias("source_hash"), target_hash(F.col("__t")).alias("target_hash"), visible("__s").alias("source_text"), visible("__t").alias("target_text"))


def inspect_target(df: DataFrame, spec: TableSpec, pks: Sequence[int] | DataFrame, hash_: Hash = unsigned_signature, version: str | None = None, deleted: str | None = None, separator: str = "", mapper: RowMapper | None = None) -> DataFrame:
    """pk, target_hash, target_text of some rows."""
    df = final(with_keys(df, spec.pk, pks), spec.pk, version, deleted)
    staged = df.select(F.col(spec.pk).cast("bigint").alias("pk"), _target_text(spec, mapper, separator).alias("__t"))
    return staged.select("pk", hash_(F.col("__t")).alias("target_hash"), visible("__t").alias("target_text"))


def first_keys(df: DataFrame, pk: str, n: int) -> DataFrame:
    """The n rows with the smallest keys."""
    return df.orderBy(pk).limit(n)


def key_union(*tables: DataFrame, pk: str = "pk") -> DataFrame:
    """Distinct keys of several tables."""
    keys = [t.select(F.col(pk).alias("pk")) for t in tables]
    out = keys[0]
    for k in keys[1:]:
        out = out.unionByName(k)
    return out.distinct()
