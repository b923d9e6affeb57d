"""What is compared: a table on either side, its key and its columns; and the YAML file that says so."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit

from tidemark.functions.families import REGISTRY, Registry, spark_type


@dataclass(frozen=True)
class ColumnMapping:
    """One name on both sides; a blank type means that the side doesn't have the column."""

    name: str
    source_type: str = ""
    target_type: str = ""


@dataclass(frozen=True)
class TableSpec:
    table: str
    pk: str
    columns: tuple[ColumnMapping, ...]
    target_table: str = ""
    source_database: str = "postgres"
    target_database: str = "clickhouse"

    @property
    def target_name(self) -> str:
        return self.target_table or self.table

    @property
    def source_columns(self) -> list[str]:
        return [c.name for c in self.columns if c.source_type]

    @property
    def target_columns(self) -> list[str]:
        return [c.name for c in self.columns if c.target_type]

    def families(self, side: str, registry: Registry = REGISTRY) -> list[str | None]:
        """Families of the columns that go through a mapper (those of the source), as the side declares them."""
        if side == "source":
            return [registry.family(self.source_database, c.source_type) for c in self.columns if c.source_type]
        return [registry.family(self.target_database, c.target_type) for c in self.columns if c.source_type]

    def target_families(self, registry: Registry = REGISTRY) -> list[str | None]:
        """Families that the destination's columns are rendered by: those of the source, where it has the column."""
        return [registry.family(self.source_database, c.source_type) if c.source_type else registry.family(self.target_database, c.target_type) for c in self.columns if c.target_type]

    def narrowed(self, names: list[str]) -> TableSpec:
        """The same table with some of its columns; the key's column stays in any case."""
        if unknown := set(names) - {c.name for c in self.columns}:
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        kept = tuple(c for c in self.columns if c.name in names or c.name == self.pk)
        return TableSpec(self.table, self.pk, kept, self.target_table, self.source_database, self.target_database)

    def source_schema(self) -> str:
        """DDL of the source's columns as Spark holds them."""
        pairs = zip(self.source_columns, self.families("source"), strict=True)
        return ", ".join(f"{quote(n)} {spark_type(f)}" for n, f in pairs)


def quote(name: str, mark: str = "`") -> str:
    """An identifier in quotes; each part of schema.table alone."""
    return ".".join(mark + part.replace(mark, mark * 2) + mark for part in name.split("."))


def schema_and_table(name: str, default: str = "public") -> tuple[str, str]:
    head, dot, tail = name.partition(".")
    return (head, tail) if dot else (default, name)


@dataclass(frozen=True)
class Config:
    source: str
    target: str
    mapper: str
    table: TableSpec
    state_path: str = ""
    environment: dict[str, str] = field(default_factory=dict)
    slot: str = "tidemark_slot"
    publication: str = "tidemark_pub"


_DATABASES = {"postgres": "postgres", "postgresql": "postgres", "mysql": "mysql", "clickhouse": "clickhouse"}


def database_of(url: str) -> str:
    """The database that a connection string names: by its scheme, ``files`` for paths."""
    scheme = urlsplit(url.removeprefix("jdbc:")).scheme.lower()
    return _DATABASES.get(scheme, "files")


def jdbc_options(url: str) -> dict[str, str]:
    """What a JDBC reader needs from a connection string: its own kind of URL, and user and password apart. URLs that say jdbc: stay."""
    if url.startswith("jdbc:"):
        return {"url": url}
    parts = urlsplit(url)
    scheme = {"postgres": "postgresql"}.get(kind := _DATABASES[parts.scheme.lower()], kind)
    host, port = parts.hostname or "localhost", f":{parts.port}" if parts.port else ""
    out = {"url": f"jdbc:{scheme}://{f'[{host}]' if ':' in host else host}{port}{parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")}
    if parts.username is not None:
        out["user"] = unquote(parts.username)
    if parts.password is not None:
        out["password"] = unquote(parts.password)
    return out


def parse_config(data: dict, environ: dict[str, str] | None = None) -> Config:
    """A config from the file's mapping. Its environment settings are put into ``environ`` where nothing is set yet."""
    environ = os.environ if environ is None else environ
    for key in ("source_connection_string", "target_connection_string", "row_mapper_name", "table_name", "primary_key_name"):
        if not data.get(key):
            raise ValueError(f"{key} is required")
    if not data.get("columns"):
        raise ValueError("at least one column mapping is required")
    settings = {str(k): str(v) for k, v in (data.get("environment") or {}).items()}
    for k, v in settings.items():
        if not environ.get(k):
            environ[k] = v
    source, target = data["source_connection_string"], data["target_connection_string"]
    if database_of(source) == "clickhouse":
        raise ValueError("clickhouse can't be a source")
    if database_of(target) == "mysql":
        raise ValueError("mysql can't be a target")
    columns = tuple(ColumnMapping(c["name"], c.get("source_type") or "", c.get("target_type") or "") for c in data["columns"])
    known = lambda url, other: other if database_of(url) == "files" else database_of(url)
    table = TableSpec(data["table_name"], data["primary_key_name"], columns, data.get("target_table_name") or "", known(source, "postgres"), known(target, "clickhouse"))
    replication = data.get("replication") or {}
    return Config(source, target, data["row_mapper_name"], table, data.get("state_path") or "", settings, replication.get("slot_name") or Config.slot, replication.get("publication_name") or Config.publication)


def load_config(path: str) -> Config:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading a config file needs PyYAML") from e
    with open(path, encoding="utf-8") as f:
        return parse_config(yaml.safe_load(f) or {})
