import json
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators import reconcile as R
from tidemark.plans import cycle
from tidemark.plans.state import StateStore
from tidemark.sources import tables

ENGINES = ("union", "joins")


def frames(spark, extract=(), source=(), target=(), changes=()):
    make = lambda rows, schema: spark.createDataFrame([tuple(r) for r in rows], schema.replace("decimal(20,0)", "string")).selectExpr(*[f"cast({c.split()[0]} as {c.split(maxsplit=1)[1]}) {c.split()[0]}" for c in schema.split(", ")])
    text = lambda rows: [tuple(str(x) if i and x is not None else x for i, x in enumerate(r)) for r in rows]
    wide = lambda rows: [(r[0], r[1], None if r[2] is None else str(r[2])) for r in rows]
    return make(wide(extract), tables.EXTRACT), make(source, tables.SOURCE_SCAN), make(text(target), tables.TARGET_SCAN), make(wide(changes), tables.EXTRACT)


def vpe(state):
    m = R.metrics(R.without_gone(state)).first()
    return (m.source_size, m.target_size, m.total_size), (m.valid_count, m.pending_count, m.error_count)


# Small tables of the duplicate and of the corrupt-update scenario.
EXTRACT = [(1, 111111111, 101010101), (2, 222222222, 202020202), (3, 333333333, 303030303)]
TARGET = [(1, 101010101), (2, 202020202), (3, 303030303)]


@pytest.mark.parametrize("engine", ENGINES)
def test_duplicates(spark, engine):
    e, s, t, c = frames(spark, EXTRACT, [r[:2] for r in EXTRACT], [(1, 101010101), (2, 202020202), (2, 202020202), (3, 303030303), (3, 999999999)], EXTRACT)
    first = R.initial_load(e, t, engine)
    assert vpe(first) == ((3, 3, 3), (1, 0, 2))
    assert vpe(R.incremental(first, s, t, c, engine)) == ((3, 3, 3), (1, 0, 2))


@pytest.mark.parametrize("engine", ENGINES)
def test_corrupt_update(spark, engine):
    e, _, t, none = frames(spark, EXTRACT, (), TARGET)
    state = R.initial_load(e, t, engine)
    assert vpe(state) == ((3, 3, 3), (3, 0, 0))
    _, s2, t2, c2 = frames(spark, (), [(1, 111111111), (2, 222222222), (3, 999999999)], [*TARGET[:2], (3, 909090909)], [(3, 100000000, 1000000000)])
    state = R.incremental(state, s2, t2, c2, engine)
    assert vpe(state) == ((3, 3, 3), (2, 1, 0))
    assert vpe(R.incremental(state, s2, t2, none, engine)) == ((3, 3, 3), (2, 0, 1))


@pytest.mark.parametrize("engine", ENGINES)
def test_two_stale_rows_become_errors(spark, engine):
    big = 2**63 + 12345
    extract = [(k, k * 7 - 90, big + k) for k in range(1, 26)]
    e, s, t, c = frames(spark, extract, [r[:2] for r in extract], [(k, h if k not in (11, 12) else h + 1) for k, _, h in extract], extract)
    assert vpe(R.initial_load(e, t, engine)) == ((25, 25, 25), (23, 2, 0))
    state = R.incremental(R.empty_state(spark), s, t, c, engine)
    assert vpe(state) == ((25, 25, 25), (23, 2, 0))
    assert vpe(R.incremental(state, s, t, c, engine)) == ((25, 25, 25), (23, 0, 2))


def test_missing_inputs(spark):
    e, s, t, c = frames(spark, EXTRACT)
    with pytest.raises(ValueError, match="extract"):
        R.initial_load(None, t)
    with pytest.raises(ValueError, match="changes"):
        R.incremental(R.empty_state(spark), s, t, None)
    with pytest.raises(ValueError, match="engine"):
        R.incremental(R.empty_state(spark), s, t, c, "other")


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


key = st.integers(1, 12)
sig = st.integers(1, 3)
table = st.dictionaries(key, sig, max_size=10)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.tuples(table, st.lists(st.tuples(key, sig), max_size=12), st.dictionaries(key, st.tuples(sig, sig), max_size=6)), min_size=2, max_size=3))
def test_engines_agree(spark, cycles):
    states = {}
    for engine in ENGINES:
        source, target, changes = cycles[0]
        e, _, t, _ = frames(spark, [(k, v, v) for k, v in source.items()], (), target)
        state = R.initial_load(e, t, engine)
        for source, target, changes in cycles[1:]:
            _, s, t, c = frames(spark, (), source.items(), target, [(k, a, b) for k, (a, b) in changes.items()])
            state = R.incremental(R.without_gone(state), s, t, c, engine)
        states[engine] = state
    assert rows_of(states["union"]) == rows_of(states["joins"])
    m = R.metrics(states["union"]).first()
    counts = Counter(r.status for r in R.with_status(states["union"]).collect())
    assert (m.valid_count, m.pending_count, m.error_count, m.total_size) == (counts[0], counts[1], counts[2], counts.total())


def test_steady_state_is_valid_and_orders_golden(spark):
    """Counts of the four observations made from orders at scale 0.01."""
    from tidemark.queries import states

    sf = "/root/testdata/sf0.01"
    want = [((14691, 334, 165)), ((13515, 1070, 464)), ((13515, 0, 1531)), ((13515, 0, 1531))]
    for c in (0, 1, 2):
        assert vpe(states(spark, sf, c))[1] == want[c]


def test_union_plan_shuffles_once(spark):
    e, s, t, c = frames(spark, EXTRACT, [r[:2] for r in EXTRACT], TARGET, EXTRACT)
    state = R.initial_load(e, t)
    assert cycle.shuffles(state) == 1
    fresh = spark.createDataFrame(state.collect(), R.STATE)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        union, joins = (cycle.shuffles(R.incremental(fresh, s, t, c, engine)) for engine in ENGINES)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert union == 1 and joins > 3


def test_error_lists(spark):
    rng = random.Random(0)
    target = [(k, k) for k in range(1, 30)] + [(k, k) for k in rng.sample(range(1, 30), 7)]
    e, _, t, _ = frames(spark, [(k, k, k) for k in range(1, 30)], (), target)
    state = R.initial_load(e, t)
    twice = sorted(k for k, n in Counter(k for k, _ in target).items() if n > 1)
    row = R.error_list(state).first()
    assert row.error_pks == ";".join(map(str, twice)) and row.n_errors == 7
    assert row.error_pks_json.startswith(f'[{{"pk":{twice[0]},"source_signature":{twice[0]},"target_signature":{twice[0]}}}')
    assert R.error_list(state, 2).first().error_pks == ";".join(map(str, twice[:2])) and R.error_list(state, 2).first().n_errors == 7
    assert tuple(R.error_list(R.empty_state(spark)).first()) == ("", "", 0)


def test_error_list_has_every_key(spark):
    n = 100_500
    kinds = dict(part.split(maxsplit=1) for part in R.STATE.split(", "))
    state = spark.range(n, numPartitions=3).selectExpr("id AS pk", "true AS validation_error", "id AS source_signature", "2L AS target_count")
    state = state.selectExpr(*[f"cast({c if c in state.columns else 'null'} AS {kinds[c]}) {c}" for c in R.STATE_COLUMNS])
    bad = R.errors(state).count()
    assert bad == n
    row = R.error_list(state).first()
    assert row.n_errors == n and row.error_pks == ";".join(map(str, range(n)))
    assert [x["pk"] for x in json.loads(row.error_pks_json)] == list(range(n))
    chunks = R.error_chunks(state).orderBy("chunk").collect()
    assert max(c.n for c in chunks) <= 10_000 and ";".join(c.error_pks for c in chunks) == row.error_pks


def test_state_store(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/state")
    assert store.current() is None and store.read().count() == 0
    e, s, t, c = frames(spark, EXTRACT, [r[:2] for r in EXTRACT], TARGET, ())
    out = cycle.run_cycle(store, cycle.DataSet(target_scan=t, source_extract=e), initial=True)
    assert out.version == 0 and out.counts["valid_count"] == 3
    for n in (1, 2, 3):
        out = cycle.run_cycle(store, cycle.DataSet(target_scan=t, source_scan=s, source_changes=c), version=n)
        assert out.counts["valid_count"] == 3
    assert store.versions() == [2, 3]
    before = rows_of(store.read(3))
    _, s9, t9, _ = frames(spark, (), [(9, 9)], ())
    cycle.run_cycle(store, cycle.DataSet(target_scan=t9, source_scan=s9, source_changes=c), version=3)  # there already: nothing happens
    assert rows_of(store.read()) == before
    (tmp_path / "state" / "v000000000009").mkdir()  # a write that was broken off
    assert store.current() == 3
    with pytest.raises(ValueError, match="older"):
        store.write(store.read(), 1)
    assert "Exchange" in cycle.explain(cycle.DataSet(target_scan=t, source_scan=s, source_changes=c), store.read())


def test_gone_keys_leave_the_state_and_sizes(spark):
    e, _, t, none = frames(spark, EXTRACT, (), [*TARGET, (99, 5)])
    state = R.without_gone(R.initial_load(e, t))
    assert cycle.size_mismatch(state).first().target_only == 1
    _, s, t, _ = frames(spark, (), [(1, 111111111)], [(1, 101010101)])
    raw = R.incremental(state, s, t, none)
    assert sorted(r.pk for r in R.gone(raw).collect()) == [2, 3, 99]
    assert [r.pk for r in R.without_gone(raw).collect()] == [1]


def test_repeated_source_keys_give_the_same_in_both_engines(spark):
    e, s, t, c = frames(spark, [(1, 10, 5), (1, 3, 90), (2, 7, None), (2, 7, 8), (3, None, 4)], [(1, 10), (1, 3), (2, 7)], [(1, 5), (2, 8), (4, 6)], [(1, 10, 5)])
    rows = lambda df: sorted(map(str, df.collect()))
    first = {g: R.initial_load(e, t, g) for g in ENGINES}
    assert rows(first["union"]) == rows(first["joins"])
    pairs = {r.pk: (r.source_signature, r.incremental_target_signature) for r in first["union"].collect()}
    assert pairs[1] == (10, 5) and pairs[2] == (7, 8)  # a pair that one row has
    assert rows(R.incremental(first["union"], s, t, c, "union")) == rows(R.incremental(first["union"], s, t, c, "joins"))
    assert {(r.pk, r.n) for r in R.duplicate_source_rows(e).collect()} == {(1, 2), (2, 2)}
    with pytest.raises(ValueError, match="no such engine"):
        R.initial_load(e, t, "other")


def test_a_failing_initial_load_keeps_the_old_state(spark, tmp_path):
    e, _, t, _ = frames(spark, EXTRACT, [], TARGET)
    store = StateStore(spark, str(tmp_path / "state"))
    cycle.run_cycle(store, cycle.DataSet(target_scan=t, source_extract=e), True)
    broken = e.selectExpr("pk", "raise_error('no more') + source_hash AS source_hash", "target_hash")
    with pytest.raises(Exception, match="no more"):
        cycle.run_cycle(store, cycle.DataSet(target_scan=t, source_extract=broken), True)
    assert store.current() == 0 and store.read().count() == 3
    out = cycle.run_cycle(store, cycle.DataSet(target_scan=t.limit(2), source_extract=e.limit(2)), True)
    assert store.versions() == [out.version] and store.first() == out.version and store.read().count() == 2
