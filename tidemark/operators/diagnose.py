"""Drill-down: which rows differ, in which fields, and how."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.mappers import json_text
from tidemark.operators.scans import with_keys

SHOWN = 100


def classify_errors(errors: DataFrame) -> DataFrame:
    """errors (pk, source_signature, target_signature) with ``error_class``: source-only, target-only or drifted. Rows with neither signature are left out."""
    s, t = F.col("source_signature").isNotNull(), F.col("target_signature").isNotNull()
    return errors.where(s | t).withColumn("error_class", F.when(s & t, "drifted").when(s, "source-only").otherwise("target-only"))


def error_counts(errors: DataFrame) -> DataFrame:
    """One row: source_only, target_only, drifted, total."""
    c = classify_errors(errors)
    of = lambda name: F.count_if(F.col("error_class") == name)
    return c.agg(of("source-only").alias("source_only"), of("target-only").alias("target_only"), of("drifted").alias("drifted"), F.count(F.lit(1)).alias("total"))


def files_named_in(log: Column) -> Column:
    """Paths of CSV and Parquet files that a log line names, as an array."""
    return F.regexp_extract_all(log, F.lit(r"([^\s\"'=]+\.(?:csv|parquet))"), F.lit(1))


def rows_of(df: DataFrame, pk: str, keys: DataFrame) -> DataFrame:
    """A table's rows for the keys of another (semi-join)."""
    return with_keys(df, pk, keys)


def equal_values(a: Column, b: Column, kind: str, tolerance: float = 1e-9) -> Column:
    """Whether two values of a field are the same, both null included. Floats may differ by a relative tolerance; JSON texts
    are compared in canonical form."""
    if kind in ("float", "double"):
        fa, fb = a.cast("double"), b.cast("double")
        near = (F.abs(fa - fb) <= tolerance * F.greatest(F.abs(fa), F.abs(fb))) | (fa == fb) | (F.isnan(fa) & F.isnan(fb))
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.coalesce(near, F.lit(False)))
    if kind == "json":
        return json_text(a.cast("string")).eqNullSafe(json_text(b.cast("string")))
    return a.eqNullSafe(b)


def shortened(text: Column, most: int = SHOWN) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def field_diff(source: DataFrame, target: DataFrame, pk: str, json_fields: tuple[str, ...] = ()) -> DataFrame:
    """pk, field, verdict (equal, differs, missing in source, missing in target), source_value, target_value for each field of the
    keys that both tables have. One join by key; fields become rows after it."""
    s_cols, t_cols = [c for c in source.columns if c != pk], [c for c in target.columns if c != pk]
    s = source.select(F.col(pk), *[F.col(c).alias(f"__s_{c}") for c in s_cols])
    t = target.select(F.col(pk), *[F.col(c).alias(f"__t_{c}") for c in t_cols])
    kinds, rows = dict(source.dtypes), []
    for c in sorted({*s_cols, *t_cols}):
        sv = F.col(f"__s_{c}") if c in s_cols else None
        tv = F.col(f"__t_{c}") if c in t_cols else None
        if sv is None:
            verdict = F.lit("missing in source")
        elif tv is None:
            verdict = F.lit("missing in target")
        else:
            verdict = F.when(equal_values(sv, tv, "json" if c in json_fields else kinds[c]), "equal").otherwise("differs")
        show = lambda v: shortened(v.cast("string")) if v is not None else F.lit(None).cast("string")
        rows.append(F.struct(F.lit(c).alias("field"), verdict.alias("verdict"), show(sv).alias("source_value"), show(tv).alias("target_value")))
    return s.join(t, pk).select(F.col(pk).alias("pk"), F.inline(F.array(*rows)))


def drifted_diff(errors: DataFrame, source: DataFrame, target: DataFrame, pk: str, json_fields: tuple[str, ...] = ()) -> DataFrame:
    """Fields of the drifted rows among the errors."""
    keys = classify_errors(errors).where(F.col("error_class") == "drifted").select("pk")
    return field_diff(rows_of(source, pk, keys), rows_of(target, pk, keys), pk, json_fields)


def _unified(a: str | None, b: str | None) -> str | None:
    if a is None or b is None or a == b:
        return None
    return "\n".join(difflib.unified_diff(a.splitlines() or [a], b.splitlines() or [b], lineterm="", n=2))


@F.pandas_udf(StringType())
def text_diff(a, b):  # noqa: ANN001, ANN201
    """Unified diff of two texts with two lines of context; null where they are equal or one is null."""
    import pandas as pd

    return pd.Series([_unified(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two texts, by halving: some 30 comparisons, each linear in the texts."""
    least = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    longer = lambda n, k: F.when((n + k <= least) & (F.substring(a, F.lit(1), n + k) == F.substring(b, F.lit(1), n + k)), n + k).otherwise(n)
    return F.when(least.isNotNull(), F.aggregate(steps, F.lit(0), longer))


def inspect_diff(scan: DataFrame, extract: DataFrame, diffs: bool = False) -> DataFrame:
    """pk, field, verdict (equal, differs, only left, only right), left_value, right_value for the fields that both inspections
    have; with ``diffs`` also the length of the common prefix of texts that differ, and a unified diff of texts over 100 characters. Keys of only one side have one row, field pk."""
    fields = [c for c in scan.columns if c in extract.columns and c != "pk"]
    left = scan.select("pk", F.lit(1).alias("__l"), *[F.col(c).alias(f"__l_{c}") for c in fields])
    right = extract.select("pk", F.lit(1).alias("__r"), *[F.col(c).alias(f"__r_{c}") for c in fields])
    both = left.join(right, "pk", "full")

    def row(field: str, verdict: Column, a: Column, b: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), verdict.alias("verdict"), a.cast("string").alias("left_value"), b.cast("string").alias("right_value"))

    none = F.lit(None).cast("string")
    alone = row("pk", F.when(F.col("__r").isNull(), "only left").otherwise("only right"), none, none)
    same = [row(c, F.when(F.col(f"__l_{c}").eqNullSafe(F.col(f"__r_{c}")), "equal").otherwise("differs"), F.col(f"__l_{c}"), F.col(f"__r_{c}")) for c in fields]
    out = both.select("pk", F.inline(F.when(F.col("__l").isNull() | F.col("__r").isNull(), F.array(alone)).otherwise(F.array(*same))))
    if diffs:
        other = F.col("field").endswith("_text") & (F.col("verdict") == "differs")
        out = out.withColumn("common_prefix", F.when(other, common_prefix(F.col("left_value"), F.col("right_value"))))
        long = F.col("field").endswith("_text") & (F.greatest(F.length("left_value"), F.length("right_value")) > SHOWN)
        out = out.withColumn("diff", text_diff(F.when(long, F.col("left_value")), F.when(long, F.col("right_value"))))
    return out
