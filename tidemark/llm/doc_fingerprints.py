"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A sketch keeps every shingle hash below a fixed fraction (1 / SCALE) of the hash space, so long texts have large sketches,
and the same shingle is kept in every text that has it. Sketches of parts merge by union, and both resemblance and the
containment of a short text in a very long one can be estimated from them. Hashes are XXH64 built pairwise: words to pairs,
pairs to threes, two threes that share a word to fives. Texts are lower-cased; words are parted by ASCII white space.

Cases: a text of one to four words has one shingle, all its words; a text none of whose hashes is below the threshold keeps
its smallest hash, so that only texts without words have an empty sketch; two empty sketches are alike (1), an empty one and
another are not (0); equal texts have equal sketches. For the next document: rows are ordered by id (null first) and the hash
of the text; rows with the same id and text are one document, and each of them gets the same result; a single document is
its own next one; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, table, whole, words

SCALE_BITS = 3  # SCALE = 8
LIMIT = 1 << (64 - SCALE_BITS)  # kept: 0 <= hash < LIMIT, as signed longs


def _paired(items: str, step: int = 1) -> Column:
    """A hash of each item with the one ``step`` places on."""
    some = F.greatest(F.size(items) - step, F.lit(0))
    return F.zip_with(F.slice(items, 1, some), F.slice(items, 1 + step, some), lambda a, b: F.xxhash64(a, b))


def with_sketch(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with the column ``name``: the text's sketch as a sorted array of distinct longs."""
    w, a, b = f"__{name}_w", f"__{name}_a", f"__{name}_b"
    df = df.withColumn(w, words(F.lower(text)))
    df = df.withColumn(a, _paired(w))
    df = df.withColumn(b, _paired(a)).drop(a)
    one = F.when(F.size(w) > 0, F.array(F.xxhash64(F.size(w), F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(a, F.when(F.size(w) < 5, one).otherwise(_paired(b, 2))).drop(w, b)
    df = df.withColumn(b, F.filter(a, lambda h: (h >= 0) & (h < LIMIT)))
    least = F.when(F.size(a) > 0, F.array(F.array_min(a))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(name, F.sort_array(F.array_distinct(F.when(F.size(b) > 0, F.col(b)).otherwise(least)))).drop(a, b)


def as_text(sketch: Column) -> Column:
    """16 lowercase hex digits for each hash, one after the other."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance: hashes in both by hashes in either; 1 for two empty sketches."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(sketches: Column) -> Column:
    """Sketch of several texts together, from an array of their sketches: hashes over the threshold only if nothing else is left."""
    every = F.array_distinct(F.flatten(sketches))
    kept = F.filter(every, lambda h: (h >= 0) & (h < LIMIT))
    return F.sort_array(F.when(F.size(kept) > 0, kept).otherwise(F.slice(F.sort_array(every), 1, 1)))


def next_documents(docs: DataFrame) -> tuple[DataFrame, bool]:
    """For each document (id, th) the one that it follows (prev_id, prev_th) and half of that one's length (need), in cyclic
    order of the ids; and whether rows of docs (id, th, text) repeat. No text is moved for this: ids are dealt by range, and only the last row
    of each range is passed on to the next one."""
    rows = docs.select("id", "th", F.length("text").alias("n"))
    one = rows.groupBy("id", "th").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("times"))
    ranged = cut(one.repartitionByRange(F.col("id").asc_nulls_first(), "th").withColumn("p", F.spark_partition_id()))
    me = F.struct("id", "th", "n")
    lasts = ranged.groupBy("p").agg(F.max(me).alias("last"))
    # one row for each range: as many as there are shuffle partitions
    every = W.partitionBy(F.lit(0)).orderBy("p")
    before = lasts.select("p", F.coalesce(F.lag("last").over(every), F.last("last").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("carry"))
    inside = F.lag(me).over(W.partitionBy("p").orderBy(F.col("id").asc_nulls_first(), "th"))
    out = ranged.withColumn("prev", inside).join(before, "p").withColumn("prev", F.coalesce("prev", "carry"))
    repeats = ranged.where("times > 1").limit(1).count() > 0
    return out.select("id", "th", F.col("prev.id").alias("prev_id"), F.col("prev.th").alias("prev_th"), F.expr("prev.n div 2").cast("int").alias("need")), repeats


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, piece (the first half of its length from the next document's text), next_sketch for each row.

    Texts are shuffled by id once; from there each document sends its beginning, as long as its predecessor needs, and its
    sketch to the predecessor.
    """
    base = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    follows, repeats = next_documents(base)
    f = cut(follows).select(F.col("id").alias("f_id"), F.col("th").alias("f_th"), "prev_id", "prev_th", "need")
    sent = base.join(f, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")))
    sent = with_sketch(sent, F.col("text"), "next_sketch").select("prev_id", "prev_th", F.substring("text", F.lit(1), F.col("need")).alias("piece"), "next_sketch")
    if repeats:
        sent = sent.dropDuplicates(["prev_id", "prev_th"])
    return base.join(sent, F.col("id").eqNullSafe(F.col("prev_id")) & (F.col("th") == F.col("prev_th"))).select("id", "text", "piece", "next_sketch")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited (text), sketch, edited_sketch, next_sketch, near_edited, near_next for each row."""
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("bigint"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.expr("cast(n_chars - n_chars div 2 as int)")), "piece"))
    rows = with_sketch(with_sketch(rows, F.col("text"), "sketch"), F.col("edited"), "edited_sketch")
    near = {"near_edited": likeness(F.col("sketch"), F.col("edited_sketch")), "near_next": likeness(F.col("sketch"), F.col("next_sketch"))}
    return rows.withColumns(near).drop("text", "piece")


def op10_doc_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


QUERIES = {"op10_doc_fingerprints": op10_doc_fingerprints}
#: XXH64 is no DuckDB function; tests/llm compares with a brute-force version.
ORACLES: dict[str, str] = {}
