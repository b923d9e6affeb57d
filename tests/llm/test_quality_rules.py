import math
import random
import re
from collections import Counter

import pytest
import xxhash

from tidemark.llm import quality_rules as Q


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    rep = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(rep) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep), failed


def xx(*values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def buckets(text):
    import regex

    t = [x.encode() for x in regex.findall(Q.TOKEN, text or "")]
    return [xx(x) % Q.BUCKETS for x in t] + [xx(a, b) % Q.BUCKETS for a, b in zip(t, t[1:], strict=False)]


def texts(n=120):
    rng, out = random.Random(4), [None, "", "  \n\t", "one", "a b c a b c", "x\n" * 9, "a a a a", "é|é <b> # é|é\n\n# é|é", "\x0bw\x0cw\x1cw w\r\nw"]
    for _ in range(n):
        w = [rng.choice(["the", "of", "Wind", "river,", "é", "s|t"]) + rng.choice(["", "a", "##", "b."]) for _ in range(rng.randint(30, 120))]
        if rng.random() < 0.3:
            w = w[:20] * 4
        out.append("".join(x + rng.choice("    \n") for x in w))
    return out


def test_against_brute_force(spark, tmp_path):
    rows = list(enumerate(texts()))
    labels = [(i, i % 3 % 2) for i, _ in rows if i % 2] + [(5, None), (7, 1), (7, 0), (9999, 1), (None, 1)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in Q.op3_quality_rules(spark, str(tmp_path)).collect()}
    trusted = {i for i, q in labels if q == 1}
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(buckets(t))
        if i in trusted:
            target.update(buckets(t))
    z = Q.PRIOR * Q.BUCKETS
    score = lambda b: round(math.log((target[b] + Q.PRIOR) / (target.total() + z)) - math.log((raw[b] + Q.PRIOR) / (raw.total() + z)), Q.DIGITS)
    assert len(got) == len(rows)
    for i, t in rows:
        r, b = got[i], buckets(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), t
        want = sum(map(score, b)) / len(b) if b else 0.0
        assert r.llr == pytest.approx(want, abs=1e-9)
        assert r.kept == (not r.base_failed and r.llr >= Q.LEAST)


def test_long_text_and_empty_tables(spark):
    rng = random.Random(0)
    long = " ".join(str(rng.randint(0, 10**6)) for _ in range(60_000))
    df = spark.createDataFrame([(1, long + " " + long), (1, None), (None, "w")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    got = sorted((r.n_words, r.n_repeat_words, r.kept) for r in Q.judge(df, none).collect())
    assert got == [(0, 0, False), (1, 0, False), (120_000, 120_000, False)]
    assert Q.judge(df.limit(0), none).count() == 0
