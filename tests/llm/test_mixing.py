import random
import zlib

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import mixing as M


def spark_hash(*values):
    """xxhash64 of Spark over an int and longs: each value's eight (four) bytes, seeded by the hash before."""
    h = 42
    for v, n in values:
        h = xxhash.xxh64_intdigest((v % (1 << 8 * n)).to_bytes(n, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def deal(given, children):
    """children: name -> (weight, room). One child after the other that can't take its part of the rest."""
    open_, share = dict(children), {}
    while True:
        left, weight = given - sum(share.values()), sum(w for w, _ in open_.values())
        full = sorted((c / w, n) for n, (w, c) in open_.items() if c * weight <= w * left)
        if not full:
            break
        share[full[0][1]] = open_.pop(full[0][1])[1]
    left, weight, upto = given - sum(share.values()), sum(w for w, _ in open_.values()), 0
    for n in sorted(open_, key=lambda n: (open_[n][1] / open_[n][0], n)):
        w = open_[n][0]
        share[n] = left * (upto + w) // weight - left * upto // weight
        upto += w
    return share


def brute(rows, mix):
    crc = lambda s: zlib.crc32(s.encode())
    leaf, have = {}, {}
    for i, text, lang, source in rows:
        d = "(none)" if source is None else f"d{crc(source) % 4}"
        k = (d, lang or "(none)", source or "(none)")
        leaf[i] = (k, len((text or "").split()))
        have[k] = have.get(k, 0) + leaf[i][1]
    wd = lambda d: {"d0": 4, "d1": 3, "d2": 2}.get(d, 1)
    wl = lambda x: 6 if x == "en" else 2
    ws = lambda s: 1 + crc(s) % 3
    room = {k: v * mix.max_epochs for k, v in have.items()}
    total = lambda *p: sum(r for k, r in room.items() if k[: len(p)] == p)
    budget = mix.budget if mix.budget is not None else sum(have.values()) * mix.budget_share[0] // mix.budget_share[1]
    take = {}
    for d, gd in deal(min(budget, total()), {d: (wd(d), total(d)) for d in {k[0] for k in have}}).items():
        for x, gl in deal(gd, {x: (wl(x), total(d, x)) for x in {k[1] for k in have if k[0] == d}}).items():
            for s, g in deal(gl, {s: (ws(s), total(d, x, s)) for s in {k[2] for k in have if k[:2] == (d, x)}}).items():
                take[d, x, s] = g
    copies = {}
    for k in have:
        q, rest = divmod(take[k], have[k]) if have[k] else (0, 0)
        run = 0
        for i in sorted((i for i in leaf if leaf[i][0] == k), key=lambda i: (spark_hash((mix.seed, 4), (q, 8), (i, 8)), i)):
            copies[i] = q + (run < rest)
            run += leaf[i][1]
    return copies, take


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "s0" if rng.random() < 0.4 else f"s{rng.randrange(12)}"
        rows.append((i, rng.choice([None, "", "w " * rng.randint(1, 90), "w"]), rng.choice(["en", "en", "de", "fr", None]), rng.choice([source] * 9 + [None])))
    return rows


def test_against_brute_force(spark):
    for n, mix in ((700, M.Mix()), (300, M.Mix(budget_share=(9, 4), seed=7)), (300, M.Mix(budget=120)), (200, M.Mix(budget=10**9, max_epochs=2)), (50, M.Mix(budget=0))):
        rows = corpus(n, n)
        df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, tokens string").repartition(7)
        want, take = brute(rows, mix)
        out = M.mix_documents(df, mix).collect()
        assert {r.doc_id: r.copies for r in out} == want
        assert {(r["__domain"], r["__lang"], r["__source"]): r["take"] for r in M.plan(df, mix).collect()} == take
        assert M.mixture(df, mix).count() == sum(want.values())


def test_one_large_leaf(spark):
    """So many documents that several share a sub-bucket."""
    rows = [(i, "w w", "en", "s0") for i in range(40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = M.mix_documents(df, M.Mix(budget=31_001)).agg(F.sum("copies"), F.max("copies")).first()
    assert tuple(got) == (15_501, 1)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b", "en", "s"), (1, "a b", "en", "s"), (1, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    out = M.mix_documents(df, M.Mix(budget=12)).collect()
    assert [r.copies for r in out] == [2, 2, 2]
    assert M.mix_documents(df.limit(0)).count() == 0 and M.mixture(df.limit(0)).columns == df.columns


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s", 7, 8, 9, 10)], "doc_id long, text string, lang string, source string, copies long, epochs long, take long, domain long")
    (row,) = M.mixture(df, M.Mix(budget=2, domain="'d'")).collect()
    assert (row.copies, row.epochs, row["take"], row.domain) == (7, 8, 9, 10)


def test_shares_of_very_many_tokens(spark):
    """Tokens times weights pass 64 bits: the shares are still exact."""
    rows = [("p", f"c{i}", 200_000_000_000_000 + i, 3 + i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "p string, c string, room bigint, w bigint")
    given = 40_000_000_000_000_000
    got = {r.c: r.share for r in M._deal(df, ["p"], "c", "room", "w", F.lit(given).cast("bigint")).collect()}
    assert sum(got.values()) == given and all(0 <= got[c] <= room for _, c, room, _ in rows)
