"""Replication messages, made here byte by byte, and streams that end when nothing comes."""

import struct

import pytest

from tidemark.operators import changes
from tidemark.functions import mappers
from tidemark.sources.spec import ColumnMapping, TableSpec
from tidemark.streaming import change_stream, pgoutput


def relation(number, schema, table, columns):
    head = b"R" + struct.pack(">I", number) + schema.encode() + b"\0" + table.encode() + b"\0d" + struct.pack(">H", len(columns))
    return head + b"".join(b"\1" + c.encode() + b"\0" + struct.pack(">Ii", 25, -1) for c in columns)


def row(values):
    def one(v):
        if v is None or v is ...:
            return b"n" if v is None else b"u"
        return b"t" + struct.pack(">I", len(v.encode())) + v.encode()

    return struct.pack(">H", len(values)) + b"".join(map(one, values))


def insert(number, values):
    return b"I" + struct.pack(">I", number) + b"N" + row(values)


def update(number, values, old=None, kind=b"O"):
    return b"U" + struct.pack(">I", number) + (kind + row(old) if old else b"") + b"N" + row(values)


def delete(number, key):
    return b"D" + struct.pack(">I", number) + b"K" + row(key)


LOG = [
    (10, b"B" + struct.pack(">qqI", 1, 2, 3)),
    (11, relation(7, "public", "items", ["id", "name"])),
    (12, relation(8, "", "other", ["x"])),
    (13, insert(7, ["1", "one"])),
    (14, update(7, ["1", "öne"], ["1", "one"])),
    (15, insert(8, ["y"])),
    (16, relation(7, "public", "items", ["id", "size", "name"])),
    (17, insert(7, ["2", "9", None])),
    (18, update(7, ["2", "10", ...], ["2", None, None], b"K")),
    (19, delete(7, ["1", None, None])),
    (20, b"T" + struct.pack(">IBI", 1, 0, 8)),
    (21, b"C" + struct.pack(">Bqqq", 0, 1, 2, 3)),
    (22, None),
]


def test_messages_become_records(spark):
    log = pgoutput.decoded(spark.createDataFrame(LOG, "lsn bigint, message binary").repartition(3))
    known = pgoutput.relations(log)
    assert [(r["from"], r["to"], r["schema"], r["columns"]) for r in known.where("relation = 7").orderBy("from").collect()] == [(11, 16, "public", ["id", "name"]), (16, None, "public", ["id", "size", "name"])]
    got = [tuple(r) for r in pgoutput.row_changes(log, known, ["id", "name", "size"]).orderBy("lsn").collect()]
    assert got == [
        (13, "I", "public", "items", "1", "one", None),
        (14, "U", "public", "items", "1", "öne", None),
        (15, "I", "pg_catalog", "other", None, None, None),
        (17, "I", "public", "items", "2", None, "9"),
        (18, "U", "public", "items", "2", None, "10"),
        (19, "D", "public", "items", "1", None, None),
    ]
    spec = TableSpec("items", "id", (ColumnMapping("id", "integer", "Int64"), ColumnMapping("name", "text", "String")))
    records = changes.of_table(pgoutput.row_changes(log, known, ["id", "name"]), spec)
    assert {r.pk for r in changes.newest_changes(changes.hashed(records, spec, mappers.mapper("generic"))).collect()} == {1, 2}


def test_broken_messages_are_errors():
    assert pgoutput.decode(b"") == pgoutput.decode(None) == (None,) * 7
    for bad in (b"I\0", insert(1, ["abc"])[:-6] , b"R" + b"x" * 9):
        with pytest.raises(ValueError, match="broken"):
            pgoutput.decode(bad)


def test_until_idle(spark, tmp_path):
    schema = "lsn bigint, op string, id string, name string"
    spark.createDataFrame([(1, "I", "1", "a"), (2, "U", "1", "b")], schema).write.parquet(f"{tmp_path}/log")
    spec = TableSpec("items", "id", (ColumnMapping("id", "integer", "Int64"), ColumnMapping("name", "text", "String")))
    log = change_stream.read_log(spark, f"{tmp_path}/log", schema)
    query = change_stream.start(log, spec, mappers.mapper("generic"), f"{tmp_path}/map", f"{tmp_path}/offsets", continuous="200 milliseconds")
    assert change_stream.until_idle(query, seconds=3) == 2 and not query.isActive
    assert change_stream.change_map(spark, f"{tmp_path}/map").count() == 1
