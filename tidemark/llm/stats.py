"""Statistics of a text as built-in column expressions. Null counts as empty; words are parted by ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import whole, words


def _share(part: Column, of: Column) -> Column:
    return F.when(of > 0, part / of).otherwise(F.lit(0.0))


def _chars(text: Column, pattern: str) -> Column:
    """How many code points match a class; texts without any are only scanned."""
    return F.when(text.rlike(pattern), F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).otherwise(0)


#: Names of the statistics that ``with_shape`` adds.
SHAPE = (
    "log_words",
    "word_length",
    "symbol_share",
    "exclaim_share",
    "bar_share",
    "upper_share",
    "digit_share",
    "stop_share",
    "distinct_share",
    "echo_share",
    "dup_line_share",
    "words_per_line",
)


def with_shape(docs: DataFrame, text_col: str = "text", prefix: str = "__s_") -> DataFrame:
    """docs with the statistics of SHAPE, each name after ``prefix``; all are finite doubles, 0 for empty texts.

    Shares are of characters in words (symbols, exclamation marks, bars, capitals, digits, full stops and commas), of words
    (distinct ones, and those equal to the word before) and of lines with words (equal to an earlier one).
    """
    p = prefix
    text = whole(text_col)
    base = docs.withColumns({f"{p}w": words(text_col), f"{p}l": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    w, lines = F.col(f"{p}w"), F.col(f"{p}l")
    base = base.withColumns({f"{p}n": F.size(w), f"{p}c": F.length(F.array_join(w, "")), f"{p}nl": F.size(lines)})
    n, c, nl = F.col(f"{p}n"), F.col(f"{p}c"), F.col(f"{p}nl")
    echo = F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(n, F.lit(1))), lambda a, b: a == b), lambda x: x))
    made = {
        "log_words": F.log1p(n.cast("double")),
        "word_length": _share(c, n),
        "symbol_share": _share(_chars(text, r"[#*$%&<>]"), c),
        "exclaim_share": _share(_chars(text, "!"), c),
        "bar_share": _share(_chars(text, r"\|"), c),
        "upper_share": _share(_chars(text, r"\p{Lu}"), c),
        "digit_share": _share(_chars(text, "[0-9]"), c),
        "stop_share": _share(_chars(text, "[.,]"), c),
        "distinct_share": _share(F.size(F.array_distinct(w)), n),
        "echo_share": _share(echo, n),
        "dup_line_share": _share(nl - F.size(F.array_distinct(lines)), nl),
        "words_per_line": _share(n, nl),
    }
    return base.withColumns({p + k: made[k].cast("double") for k in SHAPE}).drop(f"{p}w", f"{p}l", f"{p}n", f"{p}c", f"{p}nl")
