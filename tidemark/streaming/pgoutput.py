"""Logical replication messages of PostgreSQL (pgoutput, protocol version 1), as change records.

Input is a table or stream of captured messages: ``lsn`` and ``message``, the bytes after the replication header. Each message is
decoded for itself in Arrow batches. Row messages name their relation by a number; what it stood for when they were written is
looked up in the relation messages, of which there are few, so that log needs no order and no task holds a part of it.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECODED = "op string, relation bigint, schema string, table string, columns array<string>, kinds array<string>, values array<string>"


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, kind: str) -> int:
        size = struct.calcsize(kind)
        (x,) = struct.unpack_from(kind, self.data, self.at)
        self.at += size
        return x

    def letter(self) -> str:
        return chr(self.number(">B"))

    def name(self) -> str:
        end = self.data.index(b"\0", self.at)
        out, self.at = self.data[self.at : end].decode(), end + 1
        return out

    def tuple(self) -> tuple[list[str], list[str | None]]:
        kinds, values = [], []
        for _ in range(self.number(">H")):
            kinds.append(kind := self.letter())
            if kind in "tb":
                size = self.number(">I")
                values.append(self.data[self.at : self.at + size].decode(errors="replace"))
                self.at += size
            else:
                values.append(None)
        return kinds, values


def decode(message: bytes | None) -> tuple:
    """(op, relation, schema, table, columns, kinds, values). op is the message's letter; of updates and inserts the new row's values."""
    nothing = (None,) * 7
    if not message:
        return nothing
    r = _Reader(message)
    try:
        op = r.letter()
        if op == "R":
            relation, schema, table = r.number(">I"), r.name(), r.name()
            r.number(">B")
            columns = []
            for _ in range(r.number(">H")):
                r.number(">B")
                columns.append(r.name())
                r.number(">I"), r.number(">i")
            return op, relation, schema or "pg_catalog", table, columns, None, None
        if op in "IUD":
            relation, part = r.number(">I"), r.letter()
            kinds, values = r.tuple()
            if op == "U" and part in "KO":  # the old row or key came first
                r.letter()
                kinds, values = r.tuple()
            return op, relation, None, None, None, kinds, values
        return op, None, None, None, None, None, None
    except (struct.error, ValueError, IndexError) as e:
        raise ValueError(f"broken message {message[:40].hex()}") from e


def decoded(messages: DataFrame, message: str = "message") -> DataFrame:
    """messages with the columns of ``decode`` in place of the bytes; a projection, for batches and streams alike."""
    import pandas as pd

    @F.pandas_udf(DECODED)
    def run(data):  # noqa: ANN001, ANN202
        names = [part.split()[0] for part in DECODED.split(", ")]
        return pd.DataFrame([decode(None if x is None else bytes(x)) for x in data], columns=names)

    return messages.withColumn("__m", run(F.col(message))).select(*[c for c in messages.columns if c != message], "__m.*")


def relations(log: DataFrame, lsn: str = "lsn") -> DataFrame:
    """relation, from, to (positions, to without end null), schema, table, columns of decoded messages: one row for each relation message."""
    w = Window.partitionBy("relation").orderBy(lsn)
    found = log.where("op = 'R'").select("relation", lsn, "schema", "table", "columns").distinct()
    return found.select("relation", F.col(lsn).alias("from"), F.lead(lsn).over(w).alias("to"), "schema", "table", "columns")


def row_changes(log: DataFrame, known: DataFrame, columns: list[str], lsn: str = "lsn") -> DataFrame:
    """lsn, op, schema, table and the columns as text for each insert, update and delete of decoded messages. known: ``relations``.

    Nulls, unchanged values that were not sent, and columns that a relation hasn't got are null. A row message before the first message
    about its relation is an error of the log: it is left out, as nothing tells its columns.
    """
    rows = log.where("op IN ('I', 'U', 'D')").select(F.col(lsn).alias("__at"), "op", F.col("relation").alias("__r"), "values")
    there = (F.col("__r") == F.col("relation")) & (F.col("__at") >= F.col("from")) & (F.col("to").isNull() | (F.col("__at") < F.col("to")))
    met = rows.join(F.broadcast(known), there)

    def value(name: str) -> Column:
        return F.get("values", F.array_position("columns", name).cast("int") - 1).alias(name)

    return met.select(F.col("__at").alias(lsn), "op", "schema", "table", *[value(c) for c in columns])
