"""URL filters: longest-match rules, then a cascade of Bloom filters over listed hosts.

A plain Bloom filter answers "listed?" with false positives. The cascade removes them for every key that can be asked
about: level 1 encodes the listed keys, level 2 those unlisted keys of the universe that level 1 takes for listed, level 3
those listed keys that level 2 takes for unlisted, and so on until a level errs on no key. The first level that does not
hold a key decides: an odd one says "not listed", an even one "listed". Over its universe the answer is exact, and asking
costs some hashes and array reads, with no join and no shuffle of the rows.

Filters are arrays of 64-bit words made by bit_or aggregates, and reach the tasks as scalar subqueries. A level of over ``segment_bits``
bits is dealt by key hash to as many arrays as it needs, so no task gathers more than one array of that size; asking takes the
one array of the key. A task holds all arrays: some nine bits for each listed key, 1.1 GB for a billion of them.

Cases: null URLs and URLs without ``://`` have an empty host and path, and are allowed unless '' is listed; very long URLs are
read whole; rules of equal length go in alphabetical order; repeated rows are judged each, and repeated or null keys of the lists
don't matter; other columns stay, but for those named host, path, rule and verdict, which are replaced; an empty table gives an
empty table, an empty list allows all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for URLs of ``host`` and its subdomains whose path starts with ``path`` (that starts with a slash)."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; '' for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (null: none); ties go to the alphabetically first."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


@dataclass(frozen=True)
class Level:
    bits: int  # of each segment
    hashes: int
    segments: int
    words: DataFrame  # segment, words array<bigint>


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(bits)) for i in range(hashes)]


def _segment(key: Column, level: int, segments: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-level), key), F.lit(segments))


def _build(keys: DataFrame, level: int, n: int, rate: float, segment_bits: int) -> Level:
    """A Bloom filter of the one column of ``keys``, sized for n keys at this rate of false positives."""
    all_bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    segments = math.ceil(all_bits / segment_bits)
    bits = 64 * math.ceil(all_bits / segments / 64)
    hashes = max(1, round(bits * segments / max(n, 1) * math.log(2))) if n else 1
    hashes = min(hashes, 16)
    key, each = F.col(keys.columns[0]), bits // 64
    at = keys.select(_segment(key, level, segments).alias("s"), F.explode(F.array(*_positions(key, level, bits, hashes))).alias("p"))
    held = at.select((F.col("s") * each + (F.col("p") / 64).cast("bigint")).alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
    blank = keys.sparkSession.range(segments * each).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
    rows = held.unionByName(blank).groupBy("w").agg(F.bit_or("b").alias("b"))
    arrays = rows.groupBy((F.col("w") / each).cast("bigint").alias("segment")).agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))
    return Level(bits, hashes, segments, cut(arrays))


def _holds(level: Level, number: int, key: Column) -> Column:
    positions = _positions(key, number, level.bits, level.hashes)
    out = F.lit(False)
    for segment in range(level.segments):
        words, there = level.words.where(F.col("segment") == segment).select("words").scalar(), F.lit(True)
        for p in positions:
            there = there & (F.getbit(F.get(words, (p / 64).cast("int")), (p % 64).cast("int")) == 1)
        out = there if level.segments == 1 else F.when(_segment(key, number, level.segments) == segment, there).otherwise(out)
    return out


@dataclass(frozen=True)
class Cascade:
    """Exact membership over the universe that it was built for."""

    levels: list[Level] = field(default_factory=list)

    def flag(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """df with the boolean column ``name``: whether the key is listed. A null key is not."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            verdict = F.when(_holds(self.levels[number - 1], number, key), verdict).otherwise(F.lit(number % 2 == 0))
        return df.withColumn(name, F.coalesce(key.isNotNull() & verdict, F.lit(False)))


def build_cascade(listed: DataFrame, universe: DataFrame, first_rate: float = 0.02, rate: float = 0.3, segment_bits: int = 1 << 26) -> Cascade:
    """Cascade over the first columns of both tables, as strings. Nulls and repeated keys don't matter; empty tables may be.

    The levels shrink geometrically, so the loop below runs some ten times whatever the size; each turn is one aggregate
    over keys that still err. Keys listed but outside of the universe are answered rightly too: they join it.
    """
    name = lambda df: df.select(F.col(df.columns[0]).cast("string").alias("key")).where(F.col("key").isNotNull())
    both = name(listed).select("key", F.lit(True).alias("listed")).unionByName(name(universe).select("key", F.lit(False).alias("listed")))
    keys = cut(both.groupBy("key").agg(F.max("listed").alias("listed")))
    inside, outside = keys.where("listed").select("key"), keys.where("not listed").select("key")
    n, levels = inside.count(), []
    while n:
        level = _build(inside, len(levels) + 1, n, first_rate if not levels else rate, segment_bits)
        levels.append(level)
        wrong = cut(outside.where(_holds(level, len(levels), F.col("key"))))
        inside, outside, n = wrong, inside, wrong.count()
    return Cascade(levels)


def judge(pages: DataFrame, cascade: Cascade, rules: tuple[Rule, ...] = RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict: the longest rule's, else block for hosts that the cascade lists, else allow.

    Columns of pages that bear these names are replaced; all others stay. Null URLs have an empty host and are allowed
    unless '' is listed.
    """
    base = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    base = cascade.flag(base.withColumns({"rule": text, "verdict": verdict}), F.col("host"), "__listed")
    return base.withColumn("verdict", F.coalesce("verdict", F.when(F.col("__listed"), "block").otherwise("allow"))).drop("__listed")


def listed_hosts(pages: DataFrame) -> DataFrame:
    """Stands in for a published blocklist: the hosts whose MD5 starts with 0 or 1, an eighth of all."""
    hosts = pages.select(host_of(F.col("url")).alias("key"))
    return hosts.where((F.col("key") != "") & (F.substring(F.md5("key"), 1, 1) < "2")).distinct()


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(host_of(F.col("url")).alias("key")).distinct()
    return judge(pages, build_cascade(listed_hosts(pages), hosts)).select("page_id", "host", "path", "rule", "verdict")


_FITS = "CASE " + " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {{{i}}}"
    for i, r in sorted(enumerate(RULES), key=lambda x: (-len(x[1].text), x[1].text))
) + " END"

QUERIES = {"op8_url_filter": op8_url_filter}
ORACLES = {
    "op8_url_filter": f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages)
SELECT page_id, host, path,
  {_FITS.format(*(f"'{r.text}'" for r in RULES))} AS rule,
  coalesce({_FITS.format(*(f"'{r.verdict}'" for r in RULES))},
           CASE WHEN host <> '' AND md5(host) < '2' THEN 'block' ELSE 'allow' END) AS verdict
FROM parts"""
}
