import random

import corpus_pipeline as P
import pytest

from tidemark.llm import near_copies as N
from tidemark.llm import simhash


def brute_set(text):
    words = bytes((text or "").encode()).lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_kept(rows):
    """Ids that are the smallest of their component of similarities of 0.8 or more."""
    sets, root = {i: brute_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            a, b = sets[i], sets[j]
            if j < i and (not a and not b or 5 * len(a & b) >= 4 * len(a | b)) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted({find(i) for i in sets})


def edited(seed=5):
    """Texts with copies in which some words are others: similarities on both sides of 0.8, and one large group."""
    rng, rows = random.Random(seed), [(0, None), (1, ""), (2, "one two"), (3, "ONE two"), (4, "one three")]
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.randint(30, 400))] for _ in range(40)]
    for k in range(160):
        words = list(base[k % 40] if k < 110 else base[0])
        for _ in range(rng.choice([0, 1, 2, len(words) // 60, len(words) // 40, len(words) // 25]) if k >= 40 else 0):
            words[rng.randrange(len(words))] = "new"
        rows.append((10 + k, " ".join(words)))
    return rows


@pytest.mark.parametrize("crowd", [2, 32])
def test_stage_finds_edited_copies(spark, monkeypatch, crowd):
    monkeypatch.setattr(N, "CROWD", crowd)
    rows = edited()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got, want = P.near_dups(spark, docs, ""), brute_kept(rows)
    assert got.dtypes == docs.dtypes and sorted(r.doc_id for r in got.collect()) == want
    assert len(want) < simhash.keep_one(docs).count()  # what two bits of three-word fingerprints leave


def test_long_text_nulls_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(9000))
    docs = spark.createDataFrame([(None, text), (7, text), (8, text + " end"), (9, "x " * 9), (9, "y z")], "doc_id long, text string")
    assert sorted(r.doc_id for r in N.keep_one(docs).collect()) == [7, 9, 9]
    assert N.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [2, 8])
def test_crowds_lose_no_link(spark, monkeypatch, crowd):
    """One large group around a text, one around a far edit of it, and chains away from both: the links are those of all pairs."""
    monkeypatch.setattr(N, "CROWD", crowd)
    rng = random.Random(crowd)

    def edit(words, k):
        words = list(words)
        for at in rng.sample(range(len(words)), k):
            words[at] = f"v{rng.randrange(10**6)}"
        return words

    base = [f"w{i}" for i in range(120)]
    second = edit(base, 5)
    texts = [base, second, *[edit(base, rng.randint(0, 6)) for _ in range(90)], *[edit(second, rng.randint(0, 4)) for _ in range(60)]]
    for _ in range(30):
        texts.append(edit(texts[-1], 1))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in N.keep_one(docs).collect()) == brute_kept(rows)


def test_far_members_give_fewer_differences(spark):
    """Two members 60 differences from the pivot have 35 in common if they are linked, whatever nearer members there are: 26 meet, not 32."""
    member = lambda fp, x: (0, fp, x, 100, 100, len(x), 9 * len(x) - 100)
    rows = [member(1, list(range(60))), member(2, list(range(60))), member(3, list(range(100, 120)))]
    at = spark.createDataFrame(rows, "p long, fp long, x array<long>, n int, np int, d int, g int")
    got = N.differences(at, spark.createDataFrame([], "node long, root long")).collect()
    assert sorted((r.fp, r.e) for r in got) == [(fp, e) for fp in (1, 2) for e in range(26)]


def test_small_graphs_take_few_tasks(spark):
    """Steps over some edges take no task for each partition of the session."""
    sc, before = spark.sparkContext, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(61, 60)], "a long, b long")
        sc.setJobGroup("graph", "")
        got = {tuple(r) for r in simhash.components(edges).collect()}
        ran = sc.statusTracker()
        tasks = sum(ran.getStageInfo(s).numCompletedTasks for j in ran.getJobIdsForGroup("graph") for s in ran.getJobInfo(j).stageIds if ran.getStageInfo(s))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {(i, 0) for i in range(41)} | {(60, 60), (61, 60)}
    assert tasks < 500, tasks
