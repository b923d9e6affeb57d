"""Operations, validation rules and row status as built-in column expressions.

Every function takes columns (or column names) and returns a Column, so a whole validation cycle stays inside generated code.
``register`` makes the same functions callable from SQL.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Operation codes and row states.
DOES_NOT_EXIST, NOOP, INSERT, UPDATE, DELETE, INSERT_AND_UPDATE, UPDATE_AND_DELETE, TRANSIENT_UPDATE = range(1, 9)
OPERATIONS = ("DOES_NOT_EXIST", "NOOP", "INSERT", "UPDATE", "DELETE", "INSERT_AND_UPDATE", "UPDATE_AND_DELETE", "TRANSIENT_UPDATE")
VALID, PENDING, ERROR, GONE = range(4)
STATES = ("VALID", "PENDING", "ERROR", "GONE")

Col = Column | str


def _col(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _any_null(*cols: Column) -> Column:
    return reduce(or_, (c.isNull() for c in cols))


def operation_name(code: Col) -> Column:
    """Name of an operation code; null for anything else."""
    return F.get(F.array(*map(F.lit, OPERATIONS)), _col(code).cast("int") - 1)


def operation_code(name: Col) -> Column:
    """Code of an operation name; null for anything else."""
    at = F.array_position(F.array(*map(F.lit, OPERATIONS)), _col(name))
    return F.when(at > 0, at.cast("tinyint"))


def source_operation(now: Col, before: Col) -> Column:
    """What happened to a row between two observations of its signature (null: absent). Works for any comparable type; never null."""
    now, before = _col(now), _col(before)
    code = (
        F.when(now.isNull() & before.isNull(), DOES_NOT_EXIST)
        .when(before.isNull(), INSERT)
        .when(now.isNull(), DELETE)
        .when(now != before, UPDATE)
        .otherwise(NOOP)
    )
    return code.cast("tinyint")


def destination_operation(present_end: Col, updated: Col, present_start: Col) -> Column:
    """The operation that three flags tell, composites included; null if a flag is null."""
    end, updated, start = _col(present_end), _col(updated), _col(present_start)
    pick = lambda both, only: F.when(start, both).otherwise(only)
    at_end = F.when(updated, pick(UPDATE, INSERT_AND_UPDATE)).otherwise(pick(NOOP, INSERT))
    not_at_end = F.when(updated, pick(UPDATE_AND_DELETE, TRANSIENT_UPDATE)).otherwise(pick(DELETE, DOES_NOT_EXIST))
    return F.when(~_any_null(end, updated, start), F.when(end, at_end).otherwise(not_at_end)).cast("tinyint")


def row_integrity(incremental_source: Col, incremental_target: Col, source: Col, target: Col) -> Column:
    """Whether the observed pair of signatures is the pair that the change log foretold; true if it foretold none. Never null."""
    inc_s, inc_t, s, t = map(_col, (incremental_source, incremental_target, source, target))
    return _any_null(inc_s, inc_t) | (F.coalesce(inc_s == s, F.lit(False)) & F.coalesce(inc_t == t, F.lit(False)))


def _quiet(op: Column) -> Column:
    return op.isin(NOOP, DOES_NOT_EXIST)


def _rules(so: Column, pso: Column, do: Column, pdo: Column, existing: Column) -> Column:
    stalled = ~pso.isin(NOOP, DOES_NOT_EXIST, DELETE) & _quiet(pdo) & _quiet(do) & _quiet(so)
    delete_lost = (pso == DELETE) & (do == NOOP)
    missing = so.isin(NOOP, UPDATE) & pso.isin(NOOP, UPDATE, INSERT) & (do == DOES_NOT_EXIST)
    phantom = (so == DOES_NOT_EXIST) & (pso == DOES_NOT_EXIST) & (do == NOOP)
    corrupted = (so == NOOP) & (pso == NOOP) & (do != NOOP) & ~existing
    sticky = existing & _quiet(so) & _quiet(do)
    return stalled | delete_lost | missing | phantom | corrupted | sticky


def validation_error(so: Col, pso: Col, do: Col, pdo: Col, existing: Col) -> Column:
    """Whether source and destination operations, now and before, break a rule; null if an argument is null."""
    args = [*map(_col, (so, pso, do, pdo, existing))]
    return F.when(~_any_null(*args), _rules(*args))


def validation_error_with_integrity(so: Col, pso: Col, do: Col, pdo: Col, existing: Col, verified: Col) -> Column:
    """The same, and a quiet source whose row is not verified is an error too."""
    args, ok = [*map(_col, (so, pso, do, pdo, existing))], _col(verified)
    return F.when(~_any_null(*args, ok), _rules(*args) | ((args[0] == NOOP) & ~ok))


def validation_status(error: Col, so: Col, do: Col, verified: Col, target_count: Col) -> Column:
    """State of a row from its current operations; the first fitting line decides."""
    error, so, do, ok, count = map(_col, (error, so, do, verified, target_count))
    ended = lambda op: op.isin(DOES_NOT_EXIST, DELETE)
    pending = (~_quiet(so) & _quiet(do)) | (~F.coalesce(ok, F.lit(False)) & ~ended(so)) | (ended(so) & ~ended(do))
    state = F.when(error, ERROR).when(pending, PENDING).when(ended(so) & ended(do), GONE).when(count > 1, ERROR).otherwise(VALID)
    return state.cast("tinyint")


def count_distinct_characters(text: Col) -> Column:
    """Number of distinct bytes of the UTF-8 text."""
    digits = F.hex(_col(text).cast("binary"))
    pairs = F.regexp_extract_all(digits, F.lit(".."), F.lit(0))
    return F.when(_col(text).isNull(), F.lit(None)).when(F.length(digits) == 0, 0).otherwise(F.size(F.array_distinct(pairs))).cast("int")


_OPS = "'" + "', '".join(OPERATIONS) + "'"
_RULES_SQL = """
  (pso NOT IN (2, 1, 5) AND pdo IN (2, 1) AND do IN (2, 1) AND so IN (2, 1))
  OR (pso = 5 AND do = 2)
  OR (so IN (2, 4) AND pso IN (2, 4, 3) AND do = 1)
  OR (so = 1 AND pso = 1 AND do = 2)
  OR (so = 2 AND pso = 2 AND do <> 2 AND NOT existing)
  OR (existing AND so IN (2, 1) AND do IN (2, 1))"""
_SOURCE_SQL = "CAST(CASE WHEN now IS NULL AND before IS NULL THEN 1 WHEN before IS NULL THEN 3 WHEN now IS NULL THEN 5 WHEN now <> before THEN 4 ELSE 2 END AS TINYINT)"
_TYPES = {"varchar": "STRING", "int": "BIGINT", "uint": "DECIMAL(20,0)"}


def register(spark: SparkSession) -> list[str]:
    """Create the functions as temporary SQL functions of the session; returns their names."""
    made: dict[str, tuple[str, str, str]] = {}
    for short, kind in _TYPES.items():
        made[f"determine_source_operation_{short}"] = (f"now {kind}, before {kind}", "TINYINT", _SOURCE_SQL)
    made["determine_destination_operation"] = (
        "present_end BOOLEAN, updated BOOLEAN, present_start BOOLEAN",
        "TINYINT",
        "CAST(CASE WHEN present_end IS NULL OR updated IS NULL OR present_start IS NULL THEN NULL "
        "WHEN present_end THEN if(updated, if(present_start, 4, 6), if(present_start, 2, 3)) "
        "ELSE if(updated, if(present_start, 7, 8), if(present_start, 5, 1)) END AS TINYINT)",
    )
    pairs = [(k, k) for k in _TYPES] + [(a, b) for a in _TYPES for b in _TYPES if a != b]
    for a, b in pairs:
        name = a if a == b else f"{a[0]}_{b[0]}"
        body = "inc_source IS NULL OR inc_target IS NULL OR (coalesce(inc_source = source, false) AND coalesce(inc_target = target, false))"
        made[f"verify_row_integrity_{name}"] = (f"inc_source {_TYPES[a]}, inc_target {_TYPES[b]}, source {_TYPES[a]}, target {_TYPES[b]}", "BOOLEAN", body)
    ops = "so INT, pso INT, do INT, pdo INT, existing BOOLEAN"
    null = "so IS NULL OR pso IS NULL OR do IS NULL OR pdo IS NULL OR existing IS NULL"
    made["check_for_validation_error_base"] = (ops, "BOOLEAN", f"CASE WHEN {null} THEN NULL ELSE {_RULES_SQL} END")
    made["check_for_validation_error_with_row_integrity"] = (f"{ops}, verified BOOLEAN", "BOOLEAN", f"CASE WHEN {null} OR verified IS NULL THEN NULL ELSE {_RULES_SQL} OR (so = 2 AND NOT verified) END")
    made["validation_status"] = (
        "error BOOLEAN, so INT, do INT, verified BOOLEAN, target_count BIGINT",
        "TINYINT",
        "CAST(CASE WHEN error THEN 2 WHEN (so NOT IN (2, 1) AND do IN (2, 1)) OR (NOT coalesce(verified, false) AND so NOT IN (1, 5)) "
        "OR (so IN (1, 5) AND do NOT IN (1, 5)) THEN 1 WHEN so IN (1, 5) AND do IN (1, 5) THEN 3 WHEN target_count > 1 THEN 2 ELSE 0 END AS TINYINT)",
    )
    made["operation_name"] = ("code INT", "STRING", f"get(array({_OPS}), code - 1)")
    made["operation_code"] = ("name STRING", "TINYINT", f"CAST(nullif(array_position(array({_OPS}), name), 0) AS TINYINT)")
    made["count_distinct_characters"] = ("text STRING", "INT", "CASE WHEN text IS NULL THEN NULL WHEN text = '' THEN 0 ELSE size(array_distinct(regexp_extract_all(hex(encode(text, 'UTF-8')), '..', 0))) END")
    for name, (args, kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return sorted(made)
