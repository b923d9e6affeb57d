"""Canonical row texts: what is hashed.

A row's text is its columns' texts one after the other, null as a mark. The default has no separator, as databases that hash on
their side do it; ("1", "23") and ("12", "3") then have one text. Give a separator where both sides are hashed here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the text that stands for null.
NULL_MARK = "👻"


def column_text(col: Column | str, null: str = NULL_MARK) -> Column:
    """One column's text: booleans are true and false, timestamps in the session's time zone."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(null))


def row_text(cols: Sequence[Column | str], separator: str = "", null: str = NULL_MARK) -> Column:
    """The canonical text of a row; never null."""
    parts = [column_text(c, null) for c in cols]
    return F.concat_ws(separator, *parts) if separator else F.concat(*parts) if parts else F.lit("")


def visible(text: Column | str) -> Column:
    """Line ends written out, for texts that are shown in one line."""
    return F.replace(F.replace(F.col(text) if isinstance(text, str) else text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
