"""Reconciliation: what two observations, and the change log between them, say about each key.

The state has one row for each key: the last signatures seen on both sides, the pair of signatures that the change log foretold,
the last operations, and whether a rule is broken. A cycle takes the state, a source scan, a target scan and the change map to
the next state.

Two plans give the same rows. ``joins`` is the definition: full outer joins of four relations, one shuffle for each side of each
join. ``union``, the default, tags the four relations, puts them under each other and aggregates by key once: a single shuffle
with partial aggregates before it, into which the count of duplicate target rows goes as well. Keys are unique in the state
and in the change map, where ``newest_changes`` sees to it. Of a key that the source has more than once both plans take one row, the one
with the greatest signatures, never signatures of different rows; ``duplicate_source_rows`` shows such keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import state_machine as sm
from tidemark.functions.hashing import UNSIGNED

STATE = (
    "pk bigint, source_signature bigint, target_signature decimal(20,0), incremental_source_signature bigint, "
    "incremental_target_signature decimal(20,0), source_operation tinyint, target_operation tinyint, validation_error boolean, target_count bigint"
)
STATE_COLUMNS = [part.split()[0] for part in STATE.split(", ")]


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def _need(**inputs: DataFrame | None) -> None:
    if missing := [name for name, df in inputs.items() if df is None]:
        raise ValueError(f"missing input: {', '.join(missing)}")


def _as_state(df: DataFrame) -> DataFrame:
    kinds = dict(part.split(maxsplit=1) for part in STATE.split(", "))
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in STATE_COLUMNS])


def count_duplicates(target: DataFrame) -> DataFrame:
    """pk, target_signature (the least one of the key's rows, where they differ) and target_count."""
    return target.groupBy("pk").agg(F.min("target_hash").cast(UNSIGNED).alias("target_signature"), F.count(F.lit(1)).alias("target_count"))


def duplicate_source_rows(source: DataFrame) -> DataFrame:
    """pk and n of keys that a source scan or extract has more than once."""
    return source.groupBy("pk").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _check(engine: str) -> None:
    if engine not in ("union", "joins"):
        raise ValueError(f"no such engine: {engine}")


def _fit(df: DataFrame, filled: dict[str, Column], shape: dict[str, str]) -> DataFrame:
    return df.select("pk", *[(filled[c] if c in filled else F.lit(None)).cast(kind).alias(c) for c, kind in shape.items()])


def initial_load(extract: DataFrame | None, target: DataFrame | None, engine: str = "union") -> DataFrame:
    """The state after a first observation. extract: pk, source_hash, target_hash; target: pk, target_hash.

    All rows count as inserted by the source, also those that only the destination has: a first look can't tell a phantom row
    from one whose insert it hasn't seen; compare the sizes.
    """
    _need(extract=extract, target=target)
    _check(engine)
    if engine == "joins":
        e = extract.groupBy("pk").agg(F.max(F.struct(F.col("source_hash").alias("ss"), F.col("target_hash").alias("et"))).alias("row")).select("pk", "row.*")
        both = e.join(count_duplicates(target).withColumnRenamed("target_signature", "ts").withColumnRenamed("target_count", "tc"), "pk", "full")
    else:
        shape = {"ss": "bigint", "et": "decimal(20,0)", "ts": "decimal(20,0)", "tc": "bigint"}
        tagged = _fit(extract, {"ss": F.col("source_hash"), "et": F.col("target_hash")}, shape).unionByName(_fit(target, {"ts": F.col("target_hash"), "tc": F.lit(1)}, shape))
        row = F.max(F.when(F.col("tc").isNull(), F.struct("ss", "et")))  # of one row, not of several
        both = tagged.groupBy("pk").agg(row.alias("row"), F.min("ts").alias("ts"), F.sum("tc").alias("tc")).select("pk", "row.ss", "row.et", "ts", "tc")
    return _as_state(
        both.select(
            "pk",
            F.col("ss").alias("source_signature"),
            F.col("ts").alias("target_signature"),
            F.col("ss").alias("incremental_source_signature"),
            F.col("et").alias("incremental_target_signature"),
            F.lit(sm.INSERT).alias("source_operation"),
            F.when(F.col("ts").isNull(), sm.DOES_NOT_EXIST).otherwise(sm.INSERT).alias("target_operation"),
            F.lit(False).alias("validation_error"),
            F.col("tc").alias("target_count"),
        )
    )


_OLD = {"ps": "source_signature", "pt": "target_signature", "pis": "incremental_source_signature", "pit": "incremental_target_signature", "pso": "source_operation", "pdo": "target_operation", "pe": "validation_error"}


def _aligned_by_joins(state: DataFrame, source: DataFrame, target: DataFrame, changes: DataFrame) -> DataFrame:
    s = source.groupBy("pk").agg(F.max("source_hash").alias("ss"))
    p = state.select("pk", *[F.col(v).alias(k) for k, v in _OLD.items()])
    t = count_duplicates(target).select("pk", F.col("target_signature").alias("ts"), F.col("target_count").alias("tc"))
    c = changes.select("pk", F.col("source_hash").alias("si"), F.col("target_hash").alias("ti"))
    return reduce(lambda a, b: a.join(b, "pk", "full"), (s, p, t, c))


def _aligned_by_union(state: DataFrame, source: DataFrame, target: DataFrame, changes: DataFrame) -> DataFrame:
    shape = {"ss": "bigint", "ts": "decimal(20,0)", "tc": "bigint", "si": "bigint", "ti": "decimal(20,0)"}
    shape |= {"ps": "bigint", "pt": "decimal(20,0)", "pis": "bigint", "pit": "decimal(20,0)", "pso": "tinyint", "pdo": "tinyint", "pe": "boolean"}
    tagged = (
        _fit(source, {"ss": F.col("source_hash")}, shape),
        _fit(target, {"ts": F.col("target_hash"), "tc": F.lit(1)}, shape),
        _fit(changes, {"si": F.col("source_hash"), "ti": F.col("target_hash")}, shape),
        _fit(state, {k: F.col(v) for k, v in _OLD.items()}, shape),
    )
    how = {c: F.max for c in shape} | {"ts": F.min, "tc": F.sum, "pe": F.bool_or}
    return reduce(lambda a, b: a.unionByName(b), tagged).groupBy("pk").agg(*[how[c](c).alias(c) for c in shape])


def incremental(state: DataFrame | None, source: DataFrame | None, target: DataFrame | None, changes: DataFrame | None, engine: str = "union") -> DataFrame:
    """The next state. source: pk, source_hash; target: pk, target_hash; changes: pk, source_hash, target_hash."""
    _need(state=state, source=source, target=target, changes=changes)
    _check(engine)
    both = (_aligned_by_union if engine == "union" else _aligned_by_joins)(state, source, target, changes)
    both = both.withColumns(
        {
            "incremental_source_signature": F.coalesce("si", "pis"),
            "incremental_target_signature": F.coalesce("ti", "pit"),
            "source_operation": sm.source_operation("ss", "ps"),
            "target_operation": sm.source_operation("ts", "pt"),
        }
    )
    verified = sm.row_integrity("incremental_source_signature", "incremental_target_signature", "ss", "ts")
    error = sm.validation_error_with_integrity("source_operation", "pso", "target_operation", "pdo", F.coalesce("pe", F.lit(False)), verified)
    both = both.withColumn("validation_error", error)
    return _as_state(both.withColumnsRenamed({"ss": "source_signature", "ts": "target_signature", "tc": "target_count"}))


def with_status(state: DataFrame) -> DataFrame:
    """state with ``status``: 0 valid, 1 pending, 2 error, 3 gone."""
    verified = sm.row_integrity("incremental_source_signature", "incremental_target_signature", "source_signature", "target_signature")
    return state.withColumn("status", sm.validation_status("validation_error", "source_operation", "target_operation", verified, "target_count"))


def without_gone(state: DataFrame) -> DataFrame:
    """The state without keys that both sides have lost."""
    return with_status(state).where(F.col("status") != sm.GONE).drop("status")


def gone(state: DataFrame) -> DataFrame:
    return with_status(state).where(F.col("status") == sm.GONE).drop("status")


def metrics(state: DataFrame) -> DataFrame:
    """One row of counts: source_size, target_size, total_size, valid_count, pending_count, error_count."""
    s = with_status(state)
    of = lambda code: F.count_if(F.col("status") == code)
    return s.agg(
        F.count("source_signature").alias("source_size"),
        F.count("target_signature").alias("target_size"),
        F.count(F.lit(1)).alias("total_size"),
        of(sm.VALID).alias("valid_count"),
        of(sm.PENDING).alias("pending_count"),
        of(sm.ERROR).alias("error_count"),
    )


def errors(state: DataFrame) -> DataFrame:
    """Rows in error, where they are: write them out rather than collect them."""
    return with_status(state).where(F.col("status") == sm.ERROR).drop("status")


def error_chunks(state: DataFrame, most: int | None = None, each: int = 10_000) -> DataFrame:
    """All keys in error, or the first ``most``, in texts of ``each`` keys at most: chunk (rises with the keys), n, error_pks, objects
    (JSON objects parted by commas). Keys are dealt by range, so no task holds them all."""
    shown = errors(state).select("pk", "source_signature", "target_signature").orderBy("pk")
    if most is not None:
        shown = shown.limit(most)
    at = F.monotonically_increasing_id()
    low = (1 << 33) - 1
    numbered = shown.withColumn("at", at).withColumn("chunk", F.col("at") - F.col("at").bitwiseAND(F.lit(low)) % each)
    row = F.struct(F.col("pk"), F.col("source_signature"), F.col("target_signature"))
    made = numbered.groupBy("chunk").agg(F.sort_array(F.collect_list(row)).alias("r"))
    return made.select(
        "chunk",
        F.size("r").cast("bigint").alias("n"),
        F.array_join(F.transform("r", lambda x: x["pk"].cast("string")), ";").alias("error_pks"),
        F.array_join(F.transform("r", lambda x: F.to_json(x, {"ignoreNullFields": "false"})), ",").alias("objects"),
    )


def error_list(state: DataFrame, most: int | None = None) -> DataFrame:
    """One row for people: n_errors, and the keys in error joined by semicolons and as JSON, in order of the key. All of them, unless
    ``most`` bounds the texts. One row holds 2 GB at most; beyond that it fails, and ``error_chunks`` or ``errors`` give all."""
    sorted_ = F.sort_array(F.collect_list(F.struct("chunk", "n", "error_pks", "objects")))
    some = error_chunks(state, most).agg(sorted_.alias("c"))
    n = F.aggregate("c", F.lit(0).cast("bigint"), lambda x, y: x + y["n"])
    texts = some.select(
        F.array_join("c.error_pks", ";").alias("error_pks"),
        F.when(F.size("c") == 0, "").otherwise(F.concat(F.lit("["), F.array_join("c.objects", ","), F.lit("]"))).alias("error_pks_json"),
        n.alias("n_errors"),
    )
    if most is None:
        return texts
    return texts.withColumn("n_errors", errors(state).agg(F.count(F.lit(1))).scalar())


def missing_rows(state: DataFrame) -> DataFrame:
    """Keys that only the source has."""
    return state.where(F.col("source_signature").isNotNull() & F.col("target_signature").isNull())


def phantom_rows(state: DataFrame) -> DataFrame:
    """Keys that only the destination has."""
    return state.where(F.col("source_signature").isNull() & F.col("target_signature").isNotNull())


def corrupted_rows(state: DataFrame) -> DataFrame:
    """Keys on both sides whose pair of signatures is not the one that the change log foretold."""
    verified = sm.row_integrity("incremental_source_signature", "incremental_target_signature", "source_signature", "target_signature")
    return state.where(F.col("source_signature").isNotNull() & F.col("target_signature").isNotNull() & ~verified)


def duplicate_rows(state: DataFrame) -> DataFrame:
    """Keys that the destination has more than once."""
    return state.where(F.col("target_count") > 1)
