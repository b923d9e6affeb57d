import hashlib
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = bpe.public_path()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


ODD = [
    "", " ", "Hello, World! it's they'll 'S 'RE don''t", "ΑΣ ΟΔΥΣΣΕΥΣ Σ", "İstanbul ǅ ß ﬁ Ⅷ ² ½ ٣ १२३", "é ȫ 가", "a\u0085b​c᠎d\x1ce﻿f　g",
    "<|endoftext|>a<|startoftext|> <|END|> <|endoftext|", "👻👩‍👩‍👧 x️⃣ \U0001f1e9", "aaaaaaaaaaaaaaa", "!!!!!!!!!!!!!??", "中文字符日本語かな한국어", "x" * 3000, "ab" * 2500 + "é" * 800, "1234567890", "_-_a_", "\x00\x01\x7f",
]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, text):
    v = bpe.vocabulary(PATH)
    import numpy as np

    (ids,) = v.encode([text])
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert v.decode(ids) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text(texts):
    import numpy as np

    t = Tokenizer.from_file(PATH) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = t
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.vocabulary(PATH).encode(texts)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_query_matches_library_on_documents(spark, tmp_path, library):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["thndouha", "éeauaux", "Üeinung", "!!", "12", "'s", "🎉"]) for _ in range(rng.randint(0, 200)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "dup"), (902, "dup"), (None, "no id"), (903, "long " * 60_000)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op1_bpe(spark, str(tmp_path)).collect())
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i or -1, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)


def test_decode_operator_and_empty(spark):
    df = spark.createDataFrame([(1, "Some words here"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    assert out == {1: "some</w> words</w> here</w>", 2: ""}
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_text_without_spaces_is_not_quadratic():
    rng = random.Random(2)
    began = time.time()
    bpe.vocabulary(PATH).encode(["".join(rng.choice("abcdefghijklmnop") for _ in range(100_000))])
    assert time.time() - began < 30
