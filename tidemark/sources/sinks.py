"""Writers: scan files, error reports, and what is printed about a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_scan(scan: DataFrame, path: str, form: str = "csv") -> None:
    """A scan as CSV with a header (or Parquet), one file for each partition. Quotes are doubled, line ends written out."""
    if form == "csv":
        scan.write.csv(path, header=True, escape='"', mode="overwrite")
    else:
        scan.write.format(form).mode("overwrite").save(path)


def write_errors(errors: DataFrame, path: str) -> None:
    """Rows in error as JSON lines of pk, source_signature, target_signature; all of them, written where they are."""
    errors.select("pk", "source_signature", "target_signature").write.json(path, mode="overwrite", ignoreNullFields=False)


def thousands(n: int) -> str:
    return f"{n:,}"


def metrics_text(metrics: dict[str, int]) -> str:
    """The table of a run's counts."""
    rows = (("Source Row Count", "source_size"), ("Target Row Count", "target_size"), ("Valid Rows", "valid_count"), ("Pending Rows", "pending_count"), ("Error Rows", "error_count"))
    line = "-" * 45
    return "\n".join(["--- Validation Metrics ---", f"{'Metric':<18} {'Count':>25}", line, *(f"{title:<18} {thousands(metrics[k]):>25}" for title, k in rows), line])


def volume_text(source_bytes: int) -> str:
    return f"--- Data Volume ---\n{'Source Data Size':<18} {source_bytes / 1024**3:>25.2f} GB"


def throughput(rows: int, seconds: float, source_bytes: int, output_bytes: int | None = None) -> dict[str, float]:
    """Rows and megabytes a second, and the output's bytes as a percentage of the table's."""
    seconds = max(seconds, 1e-9)
    out = {"rows_per_s": rows / seconds, "mb_per_s": source_bytes / seconds / 1024**2}
    if output_bytes and source_bytes:
        out["transfer_pct"] = 100.0 * output_bytes / source_bytes
    return out


def scan_stats(scan: DataFrame, side: str) -> DataFrame:
    """One row: rows and bytes of a scan's CSV lines (key, hash and line end)."""
    key, value = F.length(F.col("pk").cast("string")), F.length(F.col(f"{side}_hash").cast("string"))
    return scan.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(key + value + 2), F.lit(0)).cast("bigint").alias("output_bytes"))
