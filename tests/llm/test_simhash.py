import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash as S
from tidemark.llm.shared import meet


def brute_fingerprint(text):
    words = [w.decode() for w in bytes((text or "").encode()).lower().split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    """doc_id -> smallest id reachable; prints: id -> fingerprint."""
    ids, root = sorted(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 2 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["a", "Bé", "ccc", "Dd", "e!", "f"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60, 160):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "new"
        rows.append((i, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "\t\n "), (1003, "One"), (1004, "one"), (1005, "x y\vz w " * 3000), (1006, "\x1cfs\x85")]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op9_simhash_near_dedup(spark, str(tmp_path)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components(prints)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("crowd", [2, 32])
def test_crowded_keys_lose_no_link(spark, monkeypatch, crowd):
    """Chains and balls around few centres: both the pair path and the ball path must give the true components."""
    monkeypatch.setattr(S, "CROWD", crowd)
    rng, prints = random.Random(crowd), {0, 1, (1 << 64) - 1}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            prints.add(x)
            y = x
            for b in rng.sample(range(64), rng.randint(1, 3)):
                y ^= 1 << b
            prints.add(y)
            if rng.random() < 0.3:
                x = y
    ids = dict(enumerate(sorted(prints)))
    df = spark.createDataFrame([(S._signed(v),) for v in ids.values()], "fp long")
    got = {r.node: r.root for r in S.components(S.links(df)).collect()}
    want, groups = brute_components(ids), {}
    for i, v in ids.items():
        groups.setdefault(want[i], set()).add(S._signed(v))
    mine = {}
    for v in ids.values():
        mine.setdefault(got.get(S._signed(v), S._signed(v)), set()).add(S._signed(v))
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert got == {**dict.fromkeys(range(401), 0), 1000: 1000, 1001: 1000}


def test_keep_one_and_empty(spark):
    text = "one two three four five six"
    rows = [(3, text, "a"), (2, text, "b"), (None, text, "c"), (9, "other words stand here now", "d"), (9, "other words stand here now", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    assert sorted(r.fp for r in S.keep_one(df).collect()) == ["b", "d", "d"]
    assert S.near_dups(df.limit(0)).count() == 0 and S.keep_one(df.where(F.lit(False))).count() == 0


def test_keep_one_keeps_unrelated_rows_with_the_same_id(spark):
    same, other = "one two three four five six", "quite another text that stands alone here"
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda rows: sorted(map(repr, map(tuple, S.keep_one(frame(rows)).collect())))
    assert kept([(5, same), (None, same), (None, other)]) == sorted([repr((5, same)), repr((None, other))])
    assert kept([(0, same), (1, same), (1, other)]) == sorted([repr((0, same)), repr((1, other))])
    assert kept([(1, same), (1, other), (1, same)]) == sorted([repr((1, same)), repr((1, same)), repr((1, other))])


def test_buckets_come_from_pivot_distances(spark, monkeypatch):
    """Linked fingerprints share a bucket; unrelated ones only where references are too few to tell blocks apart."""
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(300)]
    near = [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in base]
    df = spark.createDataFrame([(S._signed(v),) for v in {*base, *near}], "fp long")
    distances = {r.fp: r.pivots for r in S.pivot_table(df).collect()}
    assert all(distances[S._signed(x)] == [(x ^ r).bit_count() for r in S.references()] for x in base)
    few, crowd = S.candidates(df)
    shared = {(r.t, r.key): [] for r in few.collect()}
    for r in few.collect():
        shared[r.t, r.key].append(r.fp)
    together = {frozenset((a, b)) for fps in shared.values() for a in fps for b in fps if a != b}
    assert all(frozenset((S._signed(x), S._signed(y))) in together for x, y in zip(base, near, strict=True) if x != y)
    assert crowd.count() == 0 and len(together) < 310
    monkeypatch.setattr(S, "PIVOTS", 1)
    monkeypatch.setattr(S, "CROWD", 1 << 30)
    fewer = S.candidates(df)[0].groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0]
    assert fewer > 10 * len(together)


def test_meet_is_a_join_that_keeps_hot_keys_apart(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id") % 300).alias("k"), "id")
    side = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m")).where("k <> 5")
    got = meet(rows, side, ["k"], "n", 500_000)  # as if of a larger table
    assert sorted(map(tuple, got.select("k", "id", "n", "m").collect())) == sorted(map(tuple, rows.join(side, "k").select("k", "id", "n", "m").collect()))
