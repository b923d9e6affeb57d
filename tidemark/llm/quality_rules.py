"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted texts against the corpus.

Base rules: a text fails with under 50 words, or if over half as many words as it has lie in three-word windows that the text
holds twice or more.

The method: tokens are runs of letters and digits and runs of other visible characters. Single tokens and pairs of
neighbours are hashed into ``BUCKETS`` buckets. Two multinomials are counted over all texts, one of the trusted target
(documents labelled 1) and one of the raw corpus (all documents), each with add-``PRIOR`` smoothing. A text's score is the sum
of log p_target - log p_raw over its n-grams, divided by their number; a text is kept from ``LEAST`` on. The same corpus and
labels always give the same verdicts.

Plan: the corpus is read twice. The first pass marks trusted rows by a join on the id and counts buckets with map-side
aggregates, so at most BUCKETS rows a task are shuffled after the join. The ratios become one constant array of BUCKETS doubles (128 KB,
whatever the data) in the second pass, which is one projection: no shuffle, no join.

Cases: null and empty texts have no words and fail; a text without n-grams scores 0; labels that are null, repeated or of
missing documents add nothing (an id is trusted if any of its labels is 1); with no trusted text all ratios rest on the prior;
rows that repeat are judged each; other columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import table, whole, words

BUCKETS = 1 << 14
DIGITS = 4  # decimals of a ratio: sums then don't depend on the order in which counts were added
PRIOR = 1.0
LEAST = -0.5
MIN_WORDS, MAX_REPEAT = 50, 50
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"


def _neighbours(items: str) -> Column:
    """A 64-bit hash of each item with the one after it; one fewer than items, or none."""
    some = F.greatest(F.size(items) - 1, F.lit(0))
    return F.zip_with(F.slice(items, 1, some), F.slice(items, 2, some), lambda a, b: F.xxhash64(a, b))


def with_base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    A text's three-word windows are hashed (64 bits for each pair of words, then for each pair of pairs). Only where the sorted hashes show a repeat
    are they sorted again with their positions; both sorts are within the text, n log n in its words.
    """
    text = whole(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.withColumns({"__w": words(text_col), "__l": lines})
    base = base.withColumns(
        {
            "n_words": F.size("__w").cast("bigint"),
            "word_chars": F.length(F.array_join("__w", "")).cast("bigint"),
            "n_symbols": F.when(text.rlike(SYMBOLS), F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).otherwise(0).cast("bigint"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint"),
            "__h": _neighbours("__w"),
        }
    ).drop("__w", "__l")
    base = base.withColumn("__t", _neighbours("__h")).drop("__h")  # two pairs that share a word: a window of three
    base = base.withColumn("__twice", F.size(F.array_distinct("__t")) < F.size("__t"))
    placed = F.when(F.col("__twice"), F.sort_array(F.transform("__t", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    base = base.withColumn("__p", placed).drop("__t", "__twice")
    m = F.size("__p")
    after = F.slice("__p", 2, F.greatest(m, F.lit(1)))
    # each neighbouring pair of equal windows gives both positions
    starts = F.flatten(F.zip_with("__p", after, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    covered = F.array_distinct(F.flatten(F.transform(F.array_distinct(starts), lambda i: F.array(i, i + 1, i + 2))))
    base = base.withColumn("n_repeat_words", F.coalesce(F.when(F.col("__p").isNotNull(), F.size(covered)), F.lit(0)).cast("bigint")).drop("__p")
    return base.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def _buckets(docs: DataFrame, text: Column) -> DataFrame:
    """docs with ``__b``: the buckets of the text's single tokens and of its pairs of neighbours."""
    rows = docs.withColumn("__k", F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
    single = F.transform("__k", lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int"))
    some = F.greatest(F.size("__k") - 1, F.lit(0))
    pair = F.zip_with(F.slice("__k", 1, some), F.slice("__k", 2, some), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"))
    return rows.withColumn("__b", F.concat(single, pair)).drop("__k")


def ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """log p_target - log p_raw by bucket. trusted: one column of ids."""
    mark = trusted.select(F.col(trusted.columns[0]).alias("__id")).where("__id is not null").distinct()
    rows = docs.select(F.col(id_col).alias("__id"), whole(text_col).alias("__t")).join(mark.withColumn("__in", F.lit(1)).hint("merge"), "__id", "left")
    # explode would have the optimizer filter texts without n-grams first, and make all n-grams twice for it
    rows = _buckets(rows, F.col("__t")).select("__in", F.explode_outer("__b").alias("b")).where("b is not null")
    counts = rows.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("__in").alias("target"))
    found = {r.b: (r.raw, r.target) for r in counts.collect()}  # BUCKETS rows at most
    n_raw, n_target = (sum(x[i] for x in found.values()) + PRIOR * BUCKETS for i in (0, 1))
    both = (found.get(b, (0, 0)) for b in range(BUCKETS))
    return [round(math.log((t + PRIOR) / n_target) - math.log((r + PRIOR) / n_raw), DIGITS) for r, t in both]


def with_ratio(docs: DataFrame, model: list[float], text_col: str = "text") -> DataFrame:
    """docs with ``llr``, the length-normalised ratio of each text."""
    rows = _buckets(docs, whole(text_col))
    by_bucket = F.from_json(F.lit(json.dumps(model)), "array<double>")  # a constant, which the optimizer folds to one array
    total = F.aggregate("__b", F.lit(0.0), lambda s, b: s + F.get(by_bucket, b))
    return rows.withColumn("llr", F.when(F.size("__b") > 0, total / F.size("__b")).otherwise(F.lit(0.0))).drop("__b")


def judge(docs: DataFrame, trusted: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the base counts, base_failed, llr and kept."""
    out = with_base(with_ratio(docs, ratios(docs, trusted, id_col, text_col), text_col), text_col)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= least))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return judge(docs, trusted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


QUERIES = {"op3_quality_rules": op3_quality_rules}
#: XXH64, which names the buckets, is no DuckDB function; tests/llm compares with a brute-force version.
ORACLES: dict[str, str] = {}
