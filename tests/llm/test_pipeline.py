import hashlib
import random
import zlib
from collections import Counter

import corpus_pipeline as P
import test_line_dedup
import test_mixing
import test_near_copies
from tokenizers import Tokenizer

from tidemark.llm import bpe, mixing, quality_classifier

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng, rows, labels = random.Random(9), [], []
    passage = "\n".join(" ".join(rng.choice("stone river wind light field".split()) + rng.choice("abcde") for _ in range(20)) for _ in range(4))
    for i in range(260):
        words = [rng.choice("stone river wind light field house the of".split()) + rng.choice("abcdefgh") for _ in range(rng.randint(40, 90))]
        junk = rng.random() < 0.25
        if junk:
            words = [w + "###" for w in words]
        text = "".join(w + ("\n" if k % 9 == 8 else " ") for k, w in enumerate(words))
        if not junk and rng.random() < 0.2:
            text += "\n" + passage
        if rng.random() < 0.6:
            labels.append((i, int(not junk), 0))
        rows.append((i, text, rng.choice(["en", "de", None]), f"s{rng.randrange(5)}", len(text)))
    for i in range(260, 300):  # exact copies and copies with one word more
        k, text, lang, source, _ = rows[rng.randrange(200)]
        text = text if i % 2 else text.replace("\n", " ", 99) + " end"
        rows.append((i, text, lang, source, len(text)))
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0), (402, "tiny", "en", "s1", 4)]
    return rows, labels


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    names, docs, kept = [n for n, _ in P.STAGES], spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    assert names == ["quality", "lines", "near_dups", "mix", "tokens"]
    schema = docs.dtypes
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.dtypes == schema
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
    # quality: junk goes, clean texts stay
    ids = {r.doc_id for r in kept[0]}
    assert all((i in ids) == ("###" not in t) for i, t, *_ in rows if t and len(t) > 100)
    # lines
    want = test_line_dedup.brute([(r.doc_id, r.text) for r in kept[0]])
    before = {r.doc_id: r.text for r in kept[0]}
    want = {i: t for i, t in want.items() if t or not (before[i] or "").strip()}
    assert {r.doc_id: r.text for r in kept[1]} == want and len(want) < len(before)
    assert all(r.n_chars == len(r.text) for r in kept[1] if r.text)
    # near copies
    assert sorted(r.doc_id for r in kept[2]) == test_near_copies.brute_kept([(r.doc_id, r.text) for r in kept[1]]) and len(kept[2]) < len(kept[1])
    # mixture
    copies, _ = test_mixing.brute([(r.doc_id, r.text, r.lang, r.source) for r in kept[2]], mixing.Mix())
    assert Counter(r.doc_id for r in kept[3]) == Counter({i: n for i, n in copies.items() if n})
    # tokens
    library = Tokenizer.from_file(bpe.public_path())
    for r in kept[4]:
        ids = b"".join(x.to_bytes(4, "little") for x in library.encode(want[r.doc_id] or "", add_special_tokens=False).ids)
        assert (bytes(r.ids), r.ids_sha256, r.n_tokens) == (ids, hashlib.sha256(ids).hexdigest(), len(ids) // 4)
    # the whole run gives the same
    key = lambda rs: sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rs)
    assert key(P.run(spark, str(tmp_path)).collect()) == key(kept[4])


def test_empty_and_extra_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3, 5, "x"), (None, None, None, None, None, None, None)], COLUMNS + ", score int, n_lines string")
    for d in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(P.STAGES[:-1]):
            out = stage(spark, d, str(tmp_path))
            assert out.dtypes == docs.dtypes, k
            assert k == 3 or all((r.score, r.n_lines) in ((5, "x"), (None, None)) for r in out.collect())
        assert P.tokens(spark, d, str(tmp_path)).count() == d.count()
    assert zlib.crc32(b"1") % quality_classifier.FOLDS != 0


def test_null_and_repeated_ids(spark, tmp_path):
    """Rows that only share an id, or have none, are documents of their own: none goes with a copy of another."""
    words = lambda k: " ".join(f"{w}{k}" for w in "stone river wind light field house bank tree".split() * 3)
    rows = [(5, words(0)), (None, words(0)), (None, words(1)), (7, words(2)), (8, words(2)), (8, words(3)), (None, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], COLUMNS)
    kept = {(r.doc_id, r.text) for r in P.near_dups(spark, docs, "").collect()}
    assert kept == {(5, words(0)), (None, words(1)), (7, words(2)), (8, words(3)), (9, "")}
    left = {(r.doc_id, r.text) for r in P.lines(spark, docs, "").collect()}  # of the copies one place stays
    assert left >= {(None, words(1)), (8, words(3)), (None, None), (9, "")} and len(left) == 6
    assert P.tokens(spark, docs, "").count() == len(rows) and P.mix(spark, docs, "").columns == docs.columns
