import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import doc_fingerprints as D


def xx(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else (v[0] % (1 << 8 * v[1])).to_bytes(v[1], "little"), h)
    return h - (1 << 64) if h >> 63 else h


def sketch(text):
    w = [x.decode() for x in text.lower().encode().split()]
    if len(w) < 5:
        h = [xx((len(w), 4), " ".join(w).encode())] if w else []
    else:
        a = [xx(x.encode(), y.encode()) for x, y in zip(w, w[1:], strict=False)]
        b = [xx((x, 8), (y, 8)) for x, y in zip(a, a[1:], strict=False)]
        h = [xx((x, 8), (y, 8)) for x, y in zip(b, b[2:], strict=False)]
    return sorted({x for x in h if 0 <= x < D.LIMIT} or set(sorted(h)[:1]))


def like(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def check(rows, got):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: r[0])
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        hexed = lambda s: "".join(f"{x % (1 << 64):016x}" for x in s)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(sketch(text)), hexed(sketch(edited)))
        assert r.near_edited == pytest.approx(like(sketch(text), sketch(edited)))
        assert r.near_next == pytest.approx(like(sketch(text), sketch(after)))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " \n", "one", "Two é words", "👻👻👻 x 👻", "a b c d e", "w " * 30_000]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 200))) for _ in range(150)]
    texts += texts[40:60]
    rng.shuffle(texts)
    rows = [(i * 7 - 300, t) for i, t in enumerate(texts)]
    spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, id int, th int").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    out = D.op10_doc_fingerprints(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    check(rows, {r.doc_id: r for r in out})


def test_repeated_rows_null_ids_single_and_empty(spark):
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    out = D.compare_with_edits(frame([(2, "c d"), (2, "c d"), (None, "a b"), (None, None)])).collect()
    assert sorted((r.id or 0, r.edited) for r in out) == [(0, ""), (0, "a c"), (2, "c "), (2, "c ")] or sorted((r.id or 0, r.edited) for r in out) == [(0, ""), (0, "a "), (2, "c a"), (2, "c a")]
    (r,) = D.compare_with_edits(frame([(1, "abcd")])).collect()
    assert (r.edited, r.near_next) == ("abab", 1.0)
    assert D.compare_with_edits(frame([]).limit(0)).count() == 0


def test_containment_and_merge(spark):
    rng = random.Random(1)
    parts = [" ".join(rng.choice("abcdefghijkl") + str(rng.randint(0, 9)) for _ in range(n)) for n in (400, 8000)]
    rows = spark.createDataFrame([(parts[0], parts[1] + " " + parts[0])], "short string, long string")
    rows = D.with_sketch(D.with_sketch(rows, F.col("short"), "s"), F.col("long"), "l")
    got = rows.select(D.containment(F.col("s"), F.col("l")).alias("in"), D.containment(F.col("l"), F.col("s")).alias("out"), D.merged(F.array("s", "l")).alias("m"), "l").first()
    assert got["in"] == 1.0 and 0.02 < got["out"] < 0.09 and got["m"] == got["l"]
