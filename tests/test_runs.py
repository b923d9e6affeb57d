"""Scans, change records, streams, drill-down and the command line."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.functions import mappers
from tidemark.functions.hashing import pg_hash, row_signature, xxh3
from tidemark.functions.mappers import mapper
from tidemark.operators import changes, diagnose, reconcile, scans
from tidemark.plans.cycle import DataSet, run_cycle
from tidemark.plans.observe import Observer, source_hash, target_hash
from tidemark.plans.state import StateStore
from tidemark.sources import sinks, tables
from tidemark.sources.spec import ColumnMapping, TableSpec, database_of, jdbc_options, parse_config, quote, schema_and_table
from tidemark.streaming import change_stream

SPEC = TableSpec("shop.items", "id", (ColumnMapping("id", "integer", "Int64"), ColumnMapping("name", "text", "String"), ColumnMapping("old", "text", ""), ColumnMapping("new", "", "String")))
ROWS = [(1, "one", "a"), (2, None, "b"), (3, "th\nree", "c")]


def items(spark):
    return spark.createDataFrame(ROWS, "id bigint, name string, old string")


def test_scans_read_only_what_they_need(spark, tmp_path):
    items(spark).withColumn("unused", F.lit("x" * 100)).write.parquet(f"{tmp_path}/items.parquet")
    df = tables.Files(f"{tmp_path}/items.parquet").rows(spark, SPEC)
    scan = scans.source_scan(df, SPEC)
    assert scan.columns == ["pk", "source_hash"] and scan.count() == 3
    plan = scans.inspect_source(df, SPEC, [1, 3])._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan and "PushedFilters: [In(id, [1,3])]" in plan and "Exchange" not in plan
    assert tables.bytes_of(df) > 0
    got = {r.pk: r.source_text for r in scans.inspect_source(df, SPEC, [2, 3]).collect()}
    assert got == {2: "2👻b", 3: "3th\\nreec"}
    hashes = {r.pk: r.source_hash for r in scan.collect()}
    assert {r.pk: r.source_hash for r in scans.inspect_extract(df, SPEC, [1, 2, 3], mappers.mapper("generic")).collect()} == hashes
    assert {r.pk: r.source_hash for r in scans.extract_scan(df, SPEC, mappers.mapper("generic")).collect()} == hashes


def test_latest_versions(spark):
    df = spark.createDataFrame([(1, 1, 0, "a", "n"), (1, 3, 0, "b", "n"), (2, 5, 1, "c", "n"), (2, 4, 0, "d", "n"), (3, 1, 0, "e", "n"), (3, 1, 0, "f", "n")], "id bigint, v int, gone int, name string, new string")
    assert sorted(r.name for r in scans.final(df, "id", "v", "gone").collect()) == ["b", "f"]
    assert sorted(r.pk for r in scans.target_scan(df, SPEC, version="v", deleted="gone").collect()) == [1, 3]
    assert [r.target_text for r in scans.inspect_target(df, SPEC, [1], version="v", deleted="gone").collect()] == ["1bn"]


def test_scan_files_round_trip(spark, tmp_path):
    big = spark.createDataFrame([(1, 2**63 - 1, "18446744073709551615", 'a "q", b')], "pk bigint, source_hash bigint, t string, source_text string").selectExpr("pk", "source_hash", "cast(t as decimal(20,0)) target_hash", "source_text", "source_text target_text")
    sinks.write_scan(big, f"{tmp_path}/scan")
    (row,) = tables.read_scan(spark, f"{tmp_path}/scan", tables.EXTRACT_INSPECT).collect()
    assert (row.source_hash, int(row.target_hash), row.source_text) == (2**63 - 1, 2**64 - 1, 'a "q", b')
    sinks.write_scan(big, f"{tmp_path}/scan.parquet", "parquet")
    assert tables.read_scan(spark, f"{tmp_path}/scan.parquet", tables.EXTRACT_INSPECT).count() == 1


def test_change_records(spark):
    log = spark.createDataFrame(
        [(1, "I", "1", "a", "o"), (5, "U", "1", "c", "o"), (3, "U", "1", "b", "o"), (9, "D", "1", None, None), (2, "I", None, "x", "o"), (4, "T", "2", "x", "o"), (6, "I", "2", "z", None)],
        "lsn bigint, op string, id string, name string, old string",
    )
    made = changes.newest_changes(changes.hashed(log, SPEC, mappers.mapper("generic")))
    want = scans.extract_scan(spark.createDataFrame([(1, "c", "o"), (2, "z", None)], "id bigint, name string, old string"), SPEC, mappers.mapper("generic"))
    assert sorted(made.collect()) == sorted(want.collect())
    tup = spark.createDataFrame([(["t", "n", "u", "b", "x"], ["1", "2", "3", "4", "5"])], "kinds array<string>, values array<string>")
    assert list(changes.decode_tuple(tup, list("abcde")).select(*"abcde").first()) == ["1", None, None, "4", None]
    tagged = log.withColumns({"schema": F.lit("shop"), "table": F.when(F.col("lsn") < 4, "items").otherwise("other")})
    assert changes.of_table(tagged, SPEC).count() == 3


def test_streams(spark, tmp_path):
    schema = "lsn bigint, op string, id string, name string, old string"
    log, how = f"{tmp_path}/log", mappers.mapper("generic")
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)
    put([(1, "I", "1", "one", "a")])
    put([(2, "I", "2", None, "b"), (3, "I", "3", "old", "c")])
    stream = lambda: change_stream.read_log(spark, log, schema, 1)
    run = lambda: change_stream.consume(stream(), SPEC, how, f"{tmp_path}/map", f"{tmp_path}/offsets")
    assert run().count() == 3
    put([(4, "U", "3", "th\nree", "c")])
    made = run()
    assert sorted(made.collect()) == sorted(scans.extract_scan(items(spark), SPEC, how).collect())
    assert sorted(run().collect()) == sorted(made.collect())  # nothing new
    assert change_stream.change_map(spark, f"{tmp_path}/nothing").count() == 0
    # one cycle for each batch: rows of the log that the first cycles haven't met are no errors once they have
    target = spark.createDataFrame([(1, "one", "n")], "id bigint, name string, new string")
    store = StateStore(spark, f"{tmp_path}/state", keep=9)
    store.write(reconcile.empty_state(spark), 0)
    change_stream.run_on_batches(stream(), store, scans.source_scan(items(spark), SPEC), scans.target_scan(target, SPEC), SPEC, how, f"{tmp_path}/offsets2").awaitTermination()
    assert store.current() == 3 and store.read().count() == 3
    change_stream.stop_all(spark)


def test_drill_down(spark):
    errors = spark.createDataFrame([(1, 5, 5), (2, 5, None), (3, None, 5), (4, None, None)], "pk bigint, source_signature bigint, target_signature bigint")
    assert {r.pk: r.error_class for r in diagnose.classify_errors(errors).collect()} == {1: "drifted", 2: "source-only", 3: "target-only"}
    assert tuple(diagnose.error_counts(errors).first()) == (1, 1, 1, 3)
    s = spark.createDataFrame([(1, 1.0, '{"a":1,"b":2}', "x" * 150, None), (2, 1.0, "{}", "", None)], "id bigint, f double, j string, t string, n string")
    t = spark.createDataFrame([(1, 1.0 + 1e-12, '{"b": 2, "a": 1}', "x" * 150 + "y", None), (2, 1.1, "[]", "", "v")], "id bigint, f double, j string, t string, n string")
    got = {(r.pk, r.field): (r.verdict, r.source_value) for r in diagnose.field_diff(s, t, "id", ("j",)).collect()}
    assert [got[1, c][0] for c in "fjtn"] == ["equal", "equal", "differs", "equal"] and [got[2, c][0] for c in "fjtn"] == ["differs", "differs", "equal", "differs"]
    assert got[1, "t"][1] == "x" * 100 + "..."
    assert {r.pk for r in diagnose.drifted_diff(errors, s, t, "id").collect()} == {1}
    a = spark.createDataFrame([(1, 7, "line\n" * 40), (2, 8, "same")], "pk bigint, target_hash bigint, target_text string")
    b = spark.createDataFrame([(1, 7, "line\n" * 39 + "other"), (3, 8, "same")], "pk bigint, target_hash bigint, target_text string")
    out = {(r.pk, r.field): r for r in diagnose.inspect_diff(a, b, diffs=True).collect()}
    assert out[1, "target_hash"].verdict == "equal" and out[1, "target_text"].verdict == "differs" and "+other" in out[1, "target_text"]["diff"]
    assert (out[2, "pk"].verdict, out[3, "pk"].verdict) == ("only left", "only right")
    named = spark.range(1).select(diagnose.files_named_in(F.lit('wrote file="/tmp/a-1.csv" and b.parquet; no c.txt'))).first()[0]
    assert named == ["/tmp/a-1.csv", "b.parquet"]
    row = spark.range(1).select(*[diagnose.common_prefix(F.lit(x), F.lit(y)).alias(f"c{i}") for i, (x, y) in enumerate([("abc", "abd"), ("ab", "abc"), ("", "x"), ("q", "x")])]).first()
    assert list(row) == [2, 2, 0, 0]


def test_config_and_statements():
    data = {"source_connection_string": "postgresql://u@h/db", "target_connection_string": "clickhouse://h/db", "row_mapper_name": "family", "table_name": "shop.items", "primary_key_name": "id", "columns": [{"name": "id", "source_type": "integer", "target_type": "Int64"}, {"name": "new", "target_type": "String"}], "environment": {"A_THREADS": "3", "B": "x"}}
    env = {"B": "kept"}
    c = parse_config(data, env)
    assert env == {"A_THREADS": "3", "B": "kept"} and c.table.target_name == "shop.items" and c.slot == "tidemark_slot"
    for gone in ("source_connection_string", "row_mapper_name", "columns"):
        with pytest.raises(ValueError, match="required"):
            parse_config({k: v for k, v in data.items() if k != gone}, {})
    with pytest.raises(ValueError, match="can't be a source"):
        parse_config(data | {"source_connection_string": "clickhouse://x"}, {})
    assert [database_of(x) for x in ("mysql://x", "jdbc:postgresql://x", "/tmp/x.parquet", "viewfs://a/b")] == ["mysql", "postgres", "files", "files"]
    assert quote('a.b"c', '"') == '"a"."b""c"' and schema_and_table("t") == ("public", "t") and schema_and_table("s.t") == ("s", "t")
    pg, ch, my = tables.Database("postgres://h/d"), tables.Database("clickhouse://h/d"), tables.Database("mysql://h/d")
    assert pg.hash_query(c.table, "source", [1, 2]) == """SELECT "id" AS pk, hashtextextended(concat(COALESCE("id"::text, '👻')), 1337) AS source_hash FROM "shop"."items" WHERE "id" IN (1, 2)"""
    assert "FINAL WHERE _peerdb_is_deleted = 0" in ch.hash_query(c.table, "target") and "18446744073709551616" in pg.hash_query(c.table, "target")
    with pytest.raises(ValueError, match="does not hash"):
        my.hash_query(c.table, "source")
    with pytest.raises(NotImplementedError):
        my.changes(None, c.table)
    assert SPEC.narrowed(["name"]).source_columns == ["id", "name"]
    with pytest.raises(ValueError, match="no such columns"):
        SPEC.narrowed(["nope"])


def test_threads(monkeypatch):
    monkeypatch.delenv("N_THREADS", raising=False)
    assert tables.threads("N_THREADS", 4) == 4
    monkeypatch.setenv("TIDEMARK_READ_PARTITIONS", "8")
    assert tables.open_table("postgres://h/d").partitions == 8
    monkeypatch.setenv("N_THREADS", "8")
    assert tables.threads("N_THREADS", 4) == 8
    monkeypatch.setenv("N_THREADS", "0")
    with pytest.raises(ValueError, match="positive"):
        tables.threads("N_THREADS", 4)


def test_reports(spark):
    text = sinks.metrics_text({"source_size": 1234567, "target_size": 0, "valid_count": 12, "pending_count": 1, "error_count": 0})
    assert "1,234,567" in text and text.startswith("--- Validation Metrics ---")
    assert sinks.throughput(100, 2, 1 << 21, 1 << 20) == {"rows_per_s": 50, "mb_per_s": 1, "transfer_pct": 50}
    assert sinks.volume_text(1 << 30).endswith("1.00 GB")
    assert tuple(sinks.scan_stats(spark.createDataFrame([(1, 22)], "pk bigint, source_hash bigint"), "source").first()) == (1, 5)


def test_command_line(spark, tmp_path, capsys):
    yaml = pytest.importorskip("yaml")
    items(spark).write.parquet(f"{tmp_path}/source.parquet")
    items(spark).withColumn("new", F.lit("n")).where("id < 3").write.parquet(f"{tmp_path}/target.parquet")
    columns = [{"name": "id", "source_type": "integer", "target_type": "Int64"}, {"name": "name", "source_type": "text", "target_type": "String"}]
    config = {"source_connection_string": f"{tmp_path}/source.parquet", "target_connection_string": f"{tmp_path}/target.parquet", "row_mapper_name": "generic", "table_name": "items", "primary_key_name": "id", "columns": columns, "state_path": f"{tmp_path}/state"}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(config))
    call = lambda *a: cli.main(list(a), spark)
    at = f"{tmp_path}/c.yaml"
    assert call("run", "-c", at, "--initial-load") == 0
    assert "Pending Rows                               1" in capsys.readouterr().out
    assert call("run", "-c", at, "--errors", f"{tmp_path}/errors") == 0
    assert "Error Rows                                 1" in capsys.readouterr().out
    (line,) = [x for f in (tmp_path / "errors").glob("*.json") for x in f.read_text().splitlines()]
    assert json.loads(line)["pk"] == 3 and json.loads(line)["target_signature"] is None
    assert call("fetch", "-c", at, "--out", f"{tmp_path}/scans", "--initial-load") == 0
    assert call("fetch", "-c", at, "--out", f"{tmp_path}/scans") == 0
    files = ["--target-scan", f"{tmp_path}/scans/target_scan", "--shadow-path", f"{tmp_path}/state2"]
    assert call("shadow", *files, "--source-extract-scan", f"{tmp_path}/scans/source_extract", "--initial-load") == 0
    more = ["--source-scan", f"{tmp_path}/scans/source_scan", "--source-changes", f"{tmp_path}/scans/source_changes"]
    assert call("shadow", *files, *more, "--explain") == 0 and call("shadow", *files, *more) == 0
    out = capsys.readouterr().out
    assert "Physical Plan" in out and "Error Rows                                 1" in out
    assert call("shadow", *files) == 2 and "--source-scan" in capsys.readouterr().err
    for scan in ("source-scan", "source-extract-scan", "target-scan"):
        assert call("benchmark", scan, "-c", at) == 0
    assert "rows_per_s" in capsys.readouterr().out
    assert call("inspect", "-c", at, "--pks", "1,3", "--cols", "name") == 0
    assert "only right" in capsys.readouterr().out


def test_run_cycle_keeps_going_after_a_broken_initial_load(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/s")
    (tmp_path / "s" / "v000000000000").mkdir(parents=True)
    target = items(spark).withColumn("new", F.lit("n"))
    data = DataSet(target_scan=scans.target_scan(target, SPEC), source_extract=scans.extract_scan(items(spark), SPEC, mappers.mapper("generic")))
    assert run_cycle(store, data, initial=True).version == 0


def test_connection_strings():
    assert jdbc_options("postgres://u%40x:p%2Fw@h:5433/db?sslmode=require") == {"url": "jdbc:postgresql://h:5433/db?sslmode=require", "user": "u@x", "password": "p/w"}
    assert jdbc_options("mysql://root@h/shop") == {"url": "jdbc:mysql://h/shop", "user": "root"}
    assert jdbc_options("clickhouse://h") == {"url": "jdbc:clickhouse://h/"} and jdbc_options("jdbc:mysql://h/d") == {"url": "jdbc:mysql://h/d"}


def test_databases_hash_their_own_rows(spark):
    """A reader that records what it is asked for stands in for the databases."""
    asked = []

    def load(session, options):
        asked.append(options)
        sql = options.get("query") or options["dbtable"]
        if "min(" in sql:
            return session.createDataFrame([(5, 900)], "low bigint, high bigint")
        side = "target" if "target_hash" in sql else "source"
        if f"{side}_hash" in sql:
            return session.createDataFrame([(1, "7")], f"pk int, {side}_hash string")
        return session.createDataFrame([(1, "x", 1.5, 0)], "id int, name string, price double, _peerdb_is_deleted int")

    spec = TableSpec("shop.items", "id", (ColumnMapping("id", "integer", "Int64"), ColumnMapping("name", "text", "String"), ColumnMapping("price", "", "Float64")), "copy")
    pg, ch = tables.Database("postgres://u:p@h/d", partitions=4, load=load), tables.Database("clickhouse://h/d", load=load)
    seen = Observer(spark, spec, pg, ch, mapper("generic"), deleted="gone")
    data = seen.data(False, spark.createDataFrame([], tables.EXTRACT))
    assert data.source_scan.dtypes == [("pk", "bigint"), ("source_hash", "bigint")] and data.target_scan.dtypes == [("pk", "bigint"), ("target_hash", "decimal(20,0)")]
    ranged = next(o for o in asked if "hashtextextended" in o.get("dbtable", ""))
    assert (ranged["partitionColumn"], ranged["lowerBound"], ranged["upperBound"], ranged["numPartitions"]) == ("pk", "5", "901", "4")
    pushed = next(o["query"] for o in asked if "xxh3" in o.get("query", ""))
    assert ranged["user"] == "u" and "`copy` FINAL WHERE `gone` = 0" in pushed
    # the extract is hashed here as the databases do it
    assert (source_hash(pg), target_hash(ch), source_hash(tables.Files("/x")), target_hash(tables.Files("/x"))) == (pg_hash, xxh3, row_signature, scans.unsigned_signature)
    assert seen.extract().first().asDict().keys() == {"pk", "source_hash", "target_hash"}
    # rows of either side are those of its own table and columns
    ch.rows(spark, spec, side="target", version="v", deleted="gone")
    assert asked[-1]["query"] == "SELECT `id`, `name`, `price`, `v`, `gone` FROM `copy`"
    my = tables.Database("mysql://h/d", load=load)
    assert my.rows(spark, spec).count() == 1 and asked[-1]["query"] == "SELECT `id`, `name` FROM `shop`.`items`"
    shown = replace(seen, target=pg).inspect([1, 2])
    assert set(shown) == {"source", "extract", "target"} and any("IN (1, 2)" in o.get("query", "") for o in asked)


def test_compacted_change_maps_say_the_same(spark, tmp_path):
    out = str(tmp_path / "map")
    batch = lambda n, rows: spark.createDataFrame(rows, "pk bigint, source_hash bigint, lsn bigint").selectExpr("pk", "source_hash", "cast(source_hash as decimal(20,0)) target_hash", "lsn").write.mode("overwrite").parquet(f"{out}/batch={n}")
    said = lambda: sorted((r.pk, r.source_hash) for r in change_stream.change_map(spark, out).collect())
    assert said() == []
    change_stream.compact(spark, out)
    batch(0, [(1, 10, 5), (2, 20, 6)])
    batch(1, [(1, 11, 3), (3, 30, 7)])
    before = said()
    change_stream.compact(spark, out)
    assert said() == before == [(1, 10), (2, 20), (3, 30)] and [p.name for p in (tmp_path / "map").iterdir()] == ["base=1"]
    batch(1, [(9, 9, 9)])  # a batch that is in the base already, run again
    batch(2, [(2, 21, 9)])
    assert said() == [(1, 10), (2, 21), (3, 30)]
    change_stream.compact(spark, out)
    assert said() == [(1, 10), (2, 21), (3, 30)] and [p.name for p in (tmp_path / "map").iterdir()] == ["base=2"]
