"""SimHash near-dedup: fingerprints of three-word shingles, linked at two or fewer differing bits.

Fingerprints are made in Arrow batches. Everything after them works on distinct fingerprints, so copies cost nothing, and is
plain DataFrame code:

1. *Pivot distance table.* Each fingerprint gets its Hamming distances to ``1 + BLOCKS * PIVOTS`` reference fingerprints: the
   all-zero one, and for each block of 16 bits ``PIVOTS`` ones that have bits in that block only. What a block's distances have
   over the distance to the all-zero reference is that block's coordinate vector. It depends on the block alone, and all but
   equal blocks differ in it (12 references tell 57,344 to 65,536 of the 65,536 values of a block apart).
2. *Candidates.* Two bits touch two of four blocks at most, so linked fingerprints have equal coordinate vectors in two blocks
   at least: each fingerprint is put in six buckets, by the vectors of two blocks each, and no link is lost. References spread
   over the whole space can't do this: two bits move their distances by up to two, where the distances of unrelated fingerprints
   differ by some six, so each such pivot discards two of three pairs only.
3. *Discard and verify.* Fingerprints that share a bucket are compared: if any of their distances differ by more than two the
   pair goes (triangle inequality), the true distance is taken of the rest.
4. *Crowded buckets.* In a bucket of over ``CROWD`` pairs would grow with the square. There the references are the values at
   distance one or less of a member: two fingerprints are within two bits exactly if one such reference is within one bit of
   both. All members of a reference are linked to the smallest; it has 65 members at most. No link is lost, as a linked
   pair shares a bucket, and that is crowded or not.
5. *Components* by alternating large-star and small-star steps until nothing changes.

No key is hot: buckets, fingerprints and nodes of very many rows are known by their counts and joined apart (``shared.meet``).

Cases: a null text counts as empty; texts without words have fingerprint 0 and link like any other; rows that share an id and a
text are one document, rows that share only the id are not; null ids are never a component's id unless it has no other; empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, gathered, meet, table, whole

LINK_BITS = 2
BLOCKS, BLOCK_BITS = 4, 16
PIVOTS = 12  # references for each block
CROWD = 32
PART = 50_000  # shingles hashed at once: bounds memory for very long texts


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash: bit b is 1 if it is set in over half of the shingles' XXH64 values (seed 42)."""
    import numpy as np
    from xxhash import xxh64_intdigest as xx

    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) < 3:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[:-2], ends[2:]
    n, votes = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, PART):
        spans = zip(starts[at : at + PART].tolist(), ends[at : at + PART].tolist(), strict=True)
        h = np.array([xx(line[a:b], 42) for a, b in spans], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprint_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            made = [fingerprint(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([_signed(x) for x in made], pa.int64())], ["doc_id", "text_hash", "fp"])


def text_hash(text_col: str) -> Column:
    return F.xxhash64(whole(text_col))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint's bits as a signed long) for each row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id bigint, text_hash bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def references() -> list[int]:
    """The reference fingerprints, block by block after the all-zero one: multiples of the 64-bit golden ratio, mixed, cut to a block."""
    out = [0]
    for b in range(BLOCKS):
        for i in range(1, PIVOTS + 1):
            x = i * 0x9E3779B97F4A7C15 % (1 << 64)
            x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
            x ^= x >> 27
            out.append(x & (((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * b)))
    return out


def pivot_table(prints: DataFrame) -> DataFrame:
    """prints with ``pivots``: the distances of fp to the references."""
    return prints.withColumn("pivots", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(r)))).cast("tinyint") for r in references()]))


def _buckets() -> Column:
    """A struct (t, key) for each choice of the blocks that two links agree in: hashes of their coordinates."""
    at = lambda b: [F.get("pivots", F.lit(1 + b * PIVOTS + i)) - F.get("pivots", F.lit(0)) for i in range(PIVOTS)]
    some = combinations(range(BLOCKS), BLOCKS - LINK_BITS)
    return F.array(*[F.struct(F.lit(t).cast("tinyint").alias("t"), F.xxhash64(F.lit(t), *[c for b in blocks for c in at(b)]).alias("key")) for t, blocks in enumerate(some)])


def candidates(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fingerprints in the buckets of 2 to CROWD (t, key, fp, pivots), and the distinct ones in larger buckets (fp)."""
    keyed = pivot_table(distinct.select("fp")).select("fp", F.inline(_buckets()))
    total = 6 * distinct.count()
    sizes = cut(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    few = keyed.join(sizes.where(F.col("n") <= CROWD), ["t", "key"]).select("t", "key", "fp")
    crowd = meet(keyed, sizes.where(F.col("n") > CROWD), ["t", "key"], "n", total).select("fp").distinct()
    return cut(pivot_table(few)), cut(crowd)


def links(distinct: DataFrame) -> DataFrame:
    """Edges a > b between distinct fingerprints whose components are those of all pairs at LINK_BITS or less."""
    few, crowd = candidates(distinct)
    a, b = few.alias("a"), few.alias("b")
    near = (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") > F.col("b.fp"))
    for i in range(len(references())):
        near = near & (F.abs(F.get("a.pivots", F.lit(i)) - F.get("b.pivots", F.lit(i))) <= LINK_BITS)
    true = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= LINK_BITS
    pairs = a.join(b, near & true).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    centres = crowd.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])).alias("centre"))
    star = centres.groupBy("centre").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    over = centres.join(star, "centre").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(over).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for each node of the edges (a, b)."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    before = None
    while before != (now := mark(edges)):
        before, total = now, 2 * now[0]
        both = gathered(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), total)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = meet(both.where("b > a"), low, ["a"], "n", total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = gathered(gathered(large, total).distinct(), total)
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = meet(large, low, ["a"], "n", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(gathered(small.unionByName(low.select("a", F.col("m").alias("b"))), total).distinct())
    return gathered(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), 2 * now[0])


def named(made: DataFrame, edges: DataFrame) -> DataFrame:
    """made (a checkpoint with doc_id and fp) with component_id: the smallest doc_id reachable from the row's fp over the edges between fps."""
    distinct = cut(made.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    linked = cut(components(edges))
    roots = linked.join(distinct, linked["node"] == distinct["fp"]).select("node", "root", "first")
    least = roots.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("size"))
    by_node = meet(roots, least, ["root"], "size", linked.count()).select(F.col("node").alias("fp"), "component")
    by_print = cut(distinct.join(by_node, "fp", "left").select("fp", "n", F.coalesce("component", "first").alias("component_id")))
    return meet(made, by_print, ["fp"], "n", made.count()).drop("n")


def without_copies(docs: DataFrame, made: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that are not told in made (doc_id, text_hash, component_id) to have a smaller id in their component."""
    over = made.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__over"), F.col("text_hash").alias("__text_hash")).distinct()
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("__over")) & (text_hash(text_col) == F.col("__text_hash"))
    return docs.join(cut(over), same, "left_anti")


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp and component_id (smallest doc_id reachable over links, itself included) for each row."""
    made = cut(fingerprints(docs, id_col, text_col))
    return named(made, links(made.select("fp").distinct()))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their component; all columns stay."""
    return without_copies(docs, near_dups(docs, id_col, text_col), id_col, text_col)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = near_dups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash_near_dedup": op9_simhash_near_dedup}
#: XXH64 is no DuckDB function; tests/llm compares with a brute-force version.
ORACLES: dict[str, str] = {}
