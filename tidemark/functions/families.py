"""Type families: what a column's declared database type means for its text."""

from __future__ import annotations

import re

FAMILIES = ("unknown", "integer", "float", "decimal", "string", "boolean", "date", "datetime", "binary", "uuid", "network", "geometric", "json", "xml", "array", "enum", "map", "tuple", "variant")

#: Names and aliases of each family's types, by database.
TYPES: dict[str, dict[str, tuple[str, ...]]] = {
    "postgres": {
        "integer": ("smallint", "int2", "integer", "int", "int4", "bigint", "int8"),
        "decimal": ("decimal", "numeric"),
        "float": ("real", "float4", "double precision", "float8"),
        "string": ("character varying", "varchar", "character", "char", "text"),
        "binary": ("bytea",),
        "date": ("date",),
        "datetime": ("timestamp without time zone", "timestamp", "timestamp with time zone", "timestamptz"),
        "boolean": ("boolean", "bool"),
        "uuid": ("uuid",),
        "json": ("json", "jsonb"),
    },
    "clickhouse": {
        "integer": ("Int8", "Int16", "Int32", "Int64", "UInt8", "UInt16", "UInt32", "UInt64"),
        "float": ("Float32", "Float64"),
        "decimal": ("Decimal", "Decimal32", "Decimal64", "Decimal128", "Decimal256"),
        "string": ("String", "FixedString"),
        "boolean": ("Boolean",),
        "date": ("Date", "Date32"),
        "datetime": ("DateTime", "DateTime64"),
        "uuid": ("UUID",),
    },
}

_SPARK = {"integer": "bigint", "float": "double", "decimal": "decimal(38,18)", "boolean": "boolean", "date": "date", "datetime": "timestamp", "binary": "binary"}


class Registry:
    """Case-insensitive lookup of a type's family; parameters in brackets are ignored, unknown types have none."""

    def __init__(self, types: dict[str, dict[str, tuple[str, ...]]] | None = None):
        self._by: dict[str, dict[str, str]] = {}
        for database, families in (TYPES if types is None else types).items():
            for family, names in families.items():
                for name in names:
                    self.add(database, name, family)

    def add(self, database: str, name: str, family: str) -> None:
        if family not in FAMILIES:
            raise ValueError(f"no such family: {family}")
        known = self._by.setdefault(database.lower(), {})
        if name.lower() in known:
            raise ValueError(f"{database} type {name} is there already")
        known[name.lower()] = family

    def family(self, database: str, declared: str | None) -> str | None:
        plain = re.sub(r"\(.*?\)", "", declared or "").strip().lower()
        return self._by.get(database.lower(), {}).get(re.sub(r"\s+", " ", plain))


REGISTRY = Registry()


def spark_type(family: str | None) -> str:
    """The Spark type that holds a family's values; text for all that are compared as text."""
    return _SPARK.get(family or "unknown", "string")
