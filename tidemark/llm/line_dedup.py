"""Line dedup: passages of three consecutive lines that occur before are taken out of later places.

Lines are what ``\\n`` parts; lines without a word (white space only) are no part of any window and stay where they are
unless the whole text goes. Each run of ``window`` consecutive lines is hashed (two 64-bit hashes, read as one key); a text
of fewer lines has one window, all its lines. The first place of a window is the smallest (id, text, position). Every later
place gives up the lines that it covers, save those that the first place itself holds where both overlap in one text.
Covered positions of a text are merged, and its other lines are joined again.

Plan: windows come from array functions over each text (no shuffle). One partial aggregate by window key finds windows
seen twice with their first place; a join with those keys alone finds the later places (adaptive skew handling splits a hot
key); positions come together by text, and one join by id rebuilds the texts.

Cases: null text is empty and stays null; empty texts stay; rows repeated whole count as one document and are all treated
alike; rows with a null id sort first; other columns, whatever their names, pass through; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import table, whole

NOT_BLANK = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def windows(docs: DataFrame, id_col: str, text_col: str, window: int = 3) -> DataFrame:
    """One row for each window: id, th (hash of the text), at (index of its first line among lines with words), k1, k2."""
    one = F.col(text_col)
    hashed = docs.where(one.rlike(NOT_BLANK)).select(
        F.col(id_col).alias("id"),
        F.xxhash64(one).alias("th"),
        F.transform(
            F.filter(_lines(one), lambda x: x.rlike(NOT_BLANK)),
            lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")),
        ).alias("h"),
    )

    def key(at: Column, part: str, seed: int) -> Column:
        return F.xxhash64(F.lit(seed), F.least(F.size("h"), F.lit(window)), *[F.get(F.col("h"), at + i)[part] for i in range(window)])

    places = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("h") - window, F.lit(0))),
        lambda at: F.struct(at.alias("at"), key(at, "a", 2).alias("k1"), key(at, "b", 3).alias("k2")),
    )
    return hashed.select("id", "th", F.inline(places))


def later_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """Places of windows that have an earlier one: id, th, lo, hi (indices among lines with words, both included)."""
    every = windows(docs, id_col, text_col, window)
    place = F.struct("id", "th", "at")
    repeated = every.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    later = every.join(repeated, ["k1", "k2"]).where(~(same & (F.col("at") == F.col("first.at"))))
    return later.select("id", "th", F.when(same, F.greatest("at", F.col("first.at") + window)).otherwise(F.col("at")).alias("lo"), (F.col("at") + window - 1).alias("hi"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with repeated passages taken out of ``text_col``, and the columns n_lines and n_removed (lines with words), or by other
    names; columns of docs that bear these names are replaced."""
    gone = (
        later_places(docs, id_col, text_col, window)
        .groupBy(F.col("id").alias("__id"), F.col("th").alias("__th"))
        .agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("lo", "hi")))).alias("__gone"))
    )
    keyed = docs.withColumn("__key", F.xxhash64(F.col(text_col)))
    both = keyed.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__th")), "left").drop("__id", "__th", "__key")
    both = both.withColumn("__lines", _lines(whole(text_col)))
    both = both.withColumn("__at", F.filter(F.transform("__lines", lambda x, i: F.when(x.rlike(NOT_BLANK), i)), lambda i: i.isNotNull()))
    both = both.withColumn("__gone", F.filter(F.transform("__gone", lambda i: F.get(F.col("__at"), i)), lambda i: i.isNotNull()))
    keep = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    both = both.withColumn("__keep", F.when(F.size("__gone") == F.size("__at"), F.array().cast("array<int>")).otherwise(keep))
    rest = F.array_join(F.transform("__keep", lambda i: F.get(F.col("__lines"), i)), "\n")
    return both.withColumns(
        {
            text_col: F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(rest),
            names[0]: F.size("__at").cast("bigint"),
            names[1]: F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("bigint"),
        }
    ).drop("__lines", "__at", "__gone", "__keep")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(whole("text").cast("binary"), 256).alias("text_sha256"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
#: Windows are compared as texts here. The ids of documents are unique.
ORACLES = {
    "op2_line_dedup": r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (
  SELECT doc_id, pos, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS full_line
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split)),
word_line AS (
  SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx,
         count(*) OVER (PARTITION BY doc_id) AS n
  FROM line WHERE full_line),
win AS (
  SELECT doc_id, idx, least(n, 3) AS size, least(n, 3) || chr(10) || line || chr(10) || coalesce(l2, '') || chr(10) || coalesce(l3, '') AS k
  FROM (SELECT *, lead(line, 1) OVER (PARTITION BY doc_id ORDER BY pos) AS l2,
               lead(line, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS l3 FROM word_line)
  WHERE idx <= greatest(n - 3, 0)),
ranked AS (
  SELECT *, first_value(doc_id) OVER w AS d0, first_value(idx) OVER w AS a0, row_number() OVER w AS r
  FROM win WINDOW w AS (PARTITION BY k ORDER BY doc_id, idx)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = d0 THEN greatest(idx, a0 + 3) ELSE idx END, idx + 3)) AS idx
  FROM ranked WHERE r > 1),
marked AS (
  SELECT l.doc_id, l.pos, l.line, l.full_line, g.idx IS NOT NULL AS removed
  FROM line l LEFT JOIN word_line w ON l.doc_id = w.doc_id AND l.pos = w.pos
  LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.idx = w.idx)
SELECT doc_id, count(*) FILTER (full_line) AS n_lines, count(*) FILTER (removed) AS n_removed,
  sha256(CASE WHEN count(*) FILTER (removed) > 0 AND count(*) FILTER (removed) = count(*) FILTER (full_line) THEN ''
         ELSE coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT removed), '') END) AS text_sha256
FROM marked GROUP BY doc_id"""
}
