import itertools

import pytest
from pyspark.sql import functions as F

from tidemark.functions import state_machine as sm

# Conformance vectors of the validation rules.
SOURCE = [(None, None, 1), ("abc123", None, 3), (None, "def456", 5), ("abc123", "def456", 4), ("abc123", "abc123", 2)]
DESTINATION = [(True, True, True, 4), (True, True, False, 6), (True, False, True, 2), (True, False, False, 3), (False, True, True, 7), (False, True, False, 8), (False, False, True, 5), (False, False, False, 1)]
ERROR = [
    (2, 4, 2, 2, False, True), (4, 4, 1, 1, False, True), (1, 1, 2, 2, False, True), (2, 2, 2, 2, True, True), (4, 4, 4, 4, False, False), (2, 3, 1, 1, False, True),
    (4, 3, 1, 1, False, True), (2, 2, 2, 2, False, False), (2, 2, 4, 4, False, True), (1, 5, 1, 1, False, False), (1, 5, 2, 2, False, True), (2, 2, 4, 2, True, False),
]
INTEGRITY = [(None, None, "abc", "pdq", True), ("abc", "xyz", "abc", "xyz", True), ("abc", "xyz", "abc", "pdq", False)]
ERROR_INTEGRITY = [
    (2, 4, 3, 3, False, False, True), (3, 3, 1, 1, False, True, False), (2, 2, 3, 3, False, False, True), (4, 2, 2, 2, False, False, False),
    (2, 2, 2, 2, True, False, True), (2, 2, 4, 2, True, False, True), (2, 2, 4, 2, True, True, False),
]
# rows: source operation 1 to 5, columns: target operation 1 to 5; no error flag, row verified, no duplicates
MATRIX = ["GPPPG", "VVVVV", "PPVVV", "PPVVV", "PPPPG"]


def literal(x, kind=None):
    c = F.lit(x)
    return c.cast(kind) if kind else c


def run(spark, function, cases, kinds):
    cols = [function(*[literal(x, k) for x, k in zip(c[:-1], kinds, strict=True)]) for c in cases]
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


@pytest.mark.parametrize("kind", ["string", "bigint", "decimal(20,0)"])
def test_source_operation(spark, kind):
    number = {"abc123": 7, "def456": 9, None: None}
    cases = SOURCE if kind == "string" else [(number[a], number[b], x) for a, b, x in SOURCE]
    assert run(spark, sm.source_operation, cases, [kind] * 2) == [c[-1] for c in SOURCE]


def test_vectors(spark):
    ops, b = ["int"] * 4, "boolean"
    assert run(spark, sm.destination_operation, DESTINATION, [b] * 3) == [c[-1] for c in DESTINATION]
    assert run(spark, sm.validation_error, ERROR, [*ops, b]) == [c[-1] for c in ERROR]
    assert run(spark, sm.row_integrity, INTEGRITY, ["string"] * 4) == [c[-1] for c in INTEGRITY]
    assert run(spark, sm.validation_error_with_integrity, ERROR_INTEGRITY, [*ops, b, b]) == [c[-1] for c in ERROR_INTEGRITY]


def test_null_arguments(spark):
    ops = ["int"] * 4
    holes = [(*[None if i == k else (2 if i < 4 else False) for i in range(5)], None) for k in range(5)]
    assert run(spark, sm.validation_error, holes, [*ops, "boolean"]) == [None] * 5
    holes = [(*[None if i == k else (2 if i < 4 else True) for i in range(6)], None) for k in range(6)]
    assert run(spark, sm.validation_error_with_integrity, holes, [*ops, "boolean", "boolean"]) == [None] * 6
    assert run(spark, sm.destination_operation, [(None, True, True, None)], ["boolean"] * 3) == [None]
    for four in itertools.product([None, 1, 2], repeat=4):
        (got,) = run(spark, sm.row_integrity, [(*four, None)], ["bigint"] * 4) if four[0] == 1 and four[2] == 2 else (True,)
        assert got is not None


def test_status_matrix(spark):
    for ok, lines in ((True, MATRIX), (False, ["GPPPG", "PPPPP", "PPPPP", "PPPPP", "PPPPG"])):
        cases = [(False, s + 1, d + 1, ok, 1, "VPEG".index(lines[s][d])) for s in range(5) for d in range(5)]
        assert run(spark, sm.validation_status, cases, ["boolean", "int", "int", "boolean", "bigint"]) == [c[-1] for c in cases]
    more = [(True, 1, 1, True, 1, sm.ERROR), (None, 2, 2, True, 2, sm.ERROR), (None, 2, 2, None, 2, sm.PENDING), (None, 2, 2, True, None, sm.VALID)]
    assert run(spark, sm.validation_status, more, ["boolean", "int", "int", "boolean", "bigint"]) == [c[-1] for c in more]


def test_names_and_bytes(spark):
    assert run(spark, sm.operation_name, [(i, None) for i in range(10)], ["int"]) == [None, *sm.OPERATIONS, None]
    assert run(spark, sm.operation_code, [(n, None) for n in (*sm.OPERATIONS, "X", None)], ["string"]) == [*range(1, 9), None, None]
    assert run(spark, sm.count_distinct_characters, [(t, None) for t in ("", "a", "aab", "é", None)], ["string"]) == [0, 1, 2, 2, None]


def test_sql_functions(spark):
    names = sm.register(spark)
    assert len(names) == 3 + 1 + 9 + 2 + 4
    sql = lambda x: spark.sql(f"SELECT {x}").first()[0]
    for a, b, want in SOURCE:
        quoted = [f"'{x}'" if x else "NULL" for x in (a, b)]
        assert sql(f"determine_source_operation_varchar({', '.join(quoted)})") == want
    say = lambda c: ", ".join("NULL" if x is None else str(x).lower() for x in c)
    for c in DESTINATION:
        assert sql(f"determine_destination_operation({say(c[:-1])})") == c[-1]
    for c in ERROR:
        assert sql(f"check_for_validation_error_base({say(c[:-1])})") is c[-1]
    for c in ERROR_INTEGRITY:
        assert sql(f"check_for_validation_error_with_row_integrity({say(c[:-1])})") is c[-1]
    assert sql("check_for_validation_error_base(2, NULL, 2, 2, false)") is None
    assert sql("verify_row_integrity_i_u(1, 18446744073709551615, 1, 18446744073709551615)") is True
    assert sql("verify_row_integrity_varchar('a', 'b', 'a', NULL)") is False and sql("verify_row_integrity_u_v(NULL, 'b', 1, 'c')") is True
    assert (sql("validation_status(false, 5, 1, true, 1)"), sql("operation_name(6)"), sql("operation_code('DELETE')"), sql("count_distinct_characters('aéa')")) == (1, "INSERT_AND_UPDATE", 5, 3)
