"""Row mappers: from a source row to the text that the destination's row is expected to have.

A mapper gets the families of the columns and gives a Column for either side. ``GenericMapper`` expects an unchanged row.
``FamilyMapper`` renders each family as a columnar destination prints it. ``FunctionMapper`` runs any Python function over
batches of rows. New ones are registered by name.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.canonical import row_text

MAX_COLUMNS = 64
MAX_JSON_BYTES = 1 << 20
MAPPER_NULL = "0"


class RowMapper(Protocol):
    name: str

    def set_schema(self, source: Sequence[str | None], target: Sequence[str | None]) -> None: ...

    def source_text(self, cols: Sequence[Column]) -> Column: ...

    def target_text(self, cols: Sequence[Column]) -> Column: ...


def _same_length(cols: Sequence[Column], families: Sequence[str | None]) -> None:
    if len(cols) != len(families):
        raise ValueError(f"row has {len(cols)} columns, schema has {len(families)}")


class GenericMapper:
    """The destination holds the source's row as it is."""

    name = "generic"

    def set_schema(self, source: Sequence[str | None], target: Sequence[str | None]) -> None:
        self.families = list(source)

    def source_text(self, cols: Sequence[Column]) -> Column:
        return row_text(list(cols))

    target_text = source_text


def float_text(text: Column) -> Column:
    """Infinity and NaN in short lower case, exponents without a plus sign."""
    short = F.when(text == "Infinity", "inf").when(text == "-Infinity", "-inf").when(text == "NaN", "nan")
    return short.otherwise(F.replace(text, F.lit("e+"), F.lit("e")))


def decimal_text(text: Column) -> Column:
    """Without trailing zeros after the point, and without a point that nothing follows."""
    return F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)


def datetime_text(text: Column) -> Column:
    """Whole seconds get six decimals."""
    whole = (F.octet_length(text) == 19) & text.rlike("^.{4}-.{2}-.{2} .{2}:.{2}:.{2}$")
    return F.when(whole, F.concat(text, F.lit(".000000"))).otherwise(text)


def canonical_json(text: str | None) -> str | None:
    """Keys in order of their bytes, no spaces, numbers as written; what isn't JSON, or is over 1 MiB, as it is."""
    if text is None or len(text.encode()) > MAX_JSON_BYTES:
        return text

    class Raw(float):
        def __new__(cls, written: str) -> Raw:
            made = super().__new__(cls, written)
            made.written = written
            return made

        def __repr__(self) -> str:
            return self.written

    def put(x: object) -> str:
        if isinstance(x, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{put(x[k])}" for k in sorted(x, key=str.encode)) + "}"
        if isinstance(x, list):
            return "[" + ",".join(map(put, x)) + "]"
        return repr(x) if isinstance(x, Raw) else json.dumps(x, ensure_ascii=False)

    def refuse(_: str) -> None:
        raise ValueError

    try:
        return put(json.loads(text, parse_float=Raw, parse_int=Raw, parse_constant=refuse))
    except (ValueError, RecursionError):
        return text


_PRINTED_ANEW = r"[0-9][.eE]|[0-9]{16}|-0|[\\\x00-\x1F\x7F]|[\x{10000}-\x{10FFFF}]"


def json_text(text: Column) -> Column:
    """Canonical JSON, built in: keys sorted at all depths, no spaces; invalid JSON as it is. Numbers are printed anew (1.50
    as 1.5); ``exact_json_text`` keeps them as written."""
    return F.when(F.octet_length(text) > MAX_JSON_BYTES, text).otherwise(F.coalesce(F.to_json(F.try_parse_json(text)), text))


def exact_json_text(text: Column) -> Column:
    """Canonical JSON with numbers as written. Texts with numbers that would be printed anew, escapes, or characters that sort in another
    way, and whatever the built-in parser refuses, go through Arrow batches; all others are built in."""
    plain = F.when((F.octet_length(text) <= MAX_JSON_BYTES) & ~text.rlike(_PRINTED_ANEW), F.to_json(F.try_parse_json(text)))

    @F.pandas_udf(StringType())
    def run(values):  # noqa: ANN001, ANN202
        return values.map(canonical_json, na_action="ignore")

    return F.coalesce(plain, run(F.when(plain.isNull(), text)))


class FamilyMapper:
    """Texts by type family; null is 0 on both sides."""

    name = "family"

    def __init__(self, exact_json: bool = True):
        self._json = exact_json_text if exact_json else json_text

    def set_schema(self, source: Sequence[str | None], target: Sequence[str | None]) -> None:
        if max(len(source), len(target)) > MAX_COLUMNS:
            raise ValueError(f"more than {MAX_COLUMNS} columns")
        self.source = [f or "unknown" for f in source]
        self.target = [f or "unknown" for f in target]

    def source_text(self, cols: Sequence[Column]) -> Column:
        _same_length(cols, self.source)
        return self.rendered(cols, self.source)

    def rendered(self, cols: Sequence[Column], families: Sequence[str | None]) -> Column:
        """Columns as a columnar destination prints them, from either side's rows."""
        rules: dict[str, Callable[[Column], Column]] = {"float": float_text, "decimal": decimal_text, "datetime": datetime_text, "json": self._json}
        return row_text([rules.get(f, lambda c: c)(c.cast("string")) for f, c in zip(families, cols, strict=True)], null=MAPPER_NULL)

    def target_text(self, cols: Sequence[Column]) -> Column:
        _same_length(cols, self.target)
        _same_length(cols, self.source)

        def one(source: str, target: str, c: Column) -> Column:
            if source == "json":
                return self._json(c.cast("string"))
            if target in ("float", "decimal"):
                return F.when(c.isNotNull(), F.format_string("%.6f", c.cast("double")))
            if target == "integer":
                return c.cast("bigint").cast("string")
            return c.cast("string")

        return row_text([one(s, t, c) for s, t, c in zip(self.source, self.target, cols, strict=True)], null=MAPPER_NULL)


class FunctionMapper:
    """Any Python functions from a row's texts (None for null) to one text, called over Arrow batches."""

    def __init__(self, name: str, source: Callable[[list[str | None]], str], target: Callable[[list[str | None]], str] | None = None):
        self.name, self._source, self._target = name, source, target or source

    def set_schema(self, source: Sequence[str | None], target: Sequence[str | None]) -> None:
        self.families = list(source)

    @staticmethod
    def _text(function: Callable[[list[str | None]], str], cols: Sequence[Column]) -> Column:
        @F.pandas_udf(StringType())
        def run(rows):  # noqa: ANN001, ANN202
            return rows.map(lambda r: function(list(r)))

        return run(F.array(*[c.cast("string") for c in cols]))

    def source_text(self, cols: Sequence[Column]) -> Column:
        return self._text(self._source, cols)

    def target_text(self, cols: Sequence[Column]) -> Column:
        return self._text(self._target, cols)


_MAPPERS: dict[str, Callable[[], RowMapper]] = {"generic": GenericMapper, "family": FamilyMapper}


def register_mapper(name: str, make: Callable[[], RowMapper]) -> None:
    """Add a mapper; it must have the three functions of the protocol."""
    made = make()
    if missing := [f for f in ("set_schema", "source_text", "target_text") if not callable(getattr(made, f, None))]:
        raise TypeError(f"mapper {name} lacks {', '.join(missing)}")
    _MAPPERS[name] = make


def mapper(name: str) -> RowMapper:
    if name not in _MAPPERS:
        raise ValueError(f"no mapper named {name}; there are {', '.join(sorted(_MAPPERS))}")
    return _MAPPERS[name]()
