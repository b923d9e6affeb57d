import random
import time

from tidemark.llm.line_dedup import dedup_lines


def brute(rows, window=3):
    """The rule, one text after the other; rows are (id, text) with unique ids."""
    first, gone = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
        for at in range(max(len(lines) - window, 0) + 1) if lines else ():
            key = tuple(lines[at : at + window])
            if key in first:
                d, a = first[key]
                gone.setdefault(i, set()).update(range(max(at, a + window) if d == i else at, min(at + window, len(lines))))
            else:
                first[key] = (i, at)
    out = {}
    for i, text in rows:
        if text is None or i not in gone:
            out[i] = text
            continue
        lines, n, kept = text.split("\n"), -1, []
        total = sum(bool(x.strip(" \t\n\v\f\r")) for x in lines)
        for x in lines:
            n += bool(x.strip(" \t\n\v\f\r"))
            if not (x.strip(" \t\n\v\f\r") and n in gone[i]):
                kept.append(x)
        out[i] = "" if len(gone[i]) == total else "\n".join(kept)
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    passages = [[f"p{k} line {j}" for j in range(rng.randint(1, 6))] for k in range(8)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 5)):
            lines += rng.choice(passages) if rng.random() < 0.5 else [f"own {rng.randint(0, 40)}", rng.choice(["", " ", "x"])]
        rows.append((i, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n\n \n"), (503, "same\n" * 9), (504, "two\nlines"), (505, "two\nlines"), (506, "two")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, at int").repartition(5)
    got = dedup_lines(df).collect()
    want = brute(rows)
    assert {r.doc_id: r.text for r in got} == want
    assert len(got) == len(rows) and got[0].id == "x" and got[0]["at"] == 1
    assert next(r for r in got if r.doc_id == 503).text == "same\nsame\nsame\n"


def test_nulls_repeated_rows_and_empty_table(spark):
    text = "a\nb\nc\nd"
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "q"), (2, "q")], "doc_id long, text string")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.text, r.n_removed) for r in dedup_lines(df).collect())
    assert got == [(-1, text, 0), (1, "", 4), (1, "", 4), (2, "q", 0), (2, "q", 0)]
    assert dedup_lines(df.limit(0)).count() == 0


def test_very_long_text(spark):
    half = "\n".join(f"line {i} of many" for i in range(20_000))
    began = time.time()
    (row,) = dedup_lines(spark.createDataFrame([(1, half + "\n" + half)], "doc_id long, text string")).collect()
    assert row.text == half and row.n_lines == 40_000 and row.n_removed == 20_000
    assert time.time() - began < 40
