"""Queries of the change-validation operators, each over whole tables, and the same in DuckDB SQL.

Observations are made from ``orders`` by arithmetic on the key, so that every kind of fault is there: rows missing in the
destination (key % 97 = 0), duplicated (% 89), corrupted (% 83), phantom (% 79, key + 10 million), updated in the first cycle (% 10),
of these not replicated (% 20), deleted (% 53), of these not replicated (% 106).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import canonical, hashing, mappers
from tidemark.functions import state_machine as sm
from tidemark.operators import changes, diagnose, reconcile, scans
from tidemark.sources import sinks
from tidemark.sources.spec import ColumnMapping, TableSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- observations ------------------------------------------------------------------------------------------------

SIG = hashing.md5_signature


def _usig(text: Column) -> Column:
    return SIG(text).cast(hashing.UNSIGNED)


def _divides(n: int) -> Column:
    return F.col("pk") % n == 0


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("pk"), canonical.row_text(["o_orderkey", "o_orderstatus", "o_orderpriority"]).alias("t"))


def source_at(spark: SparkSession, sf_dir: str, cycle: int) -> DataFrame:
    b = base(spark, sf_dir)
    if cycle:
        b = b.where(~_divides(53)).withColumn("t", F.when(_divides(10), F.concat("t", F.lit("u"))).otherwise(F.col("t")))
    return b.select("pk", SIG(F.col("t")).alias("source_hash"), _usig(F.concat("t", F.lit("|t"))).alias("target_hash"))


def target_at(spark: SparkSession, sf_dir: str, cycle: int) -> DataFrame:
    b = base(spark, sf_dir)
    ghosts = b.where(_divides(79)).select((F.col("pk") + 10_000_000).alias("pk"), F.lit(1).cast(hashing.UNSIGNED).alias("target_hash"))
    b = b.where(~_divides(97))
    text = F.col("t")
    if cycle:
        b = b.where(~_divides(53) | _divides(106))
        text = F.when(_divides(10) & ~_divides(20), F.concat(text, F.lit("u"))).otherwise(text)
    text = F.concat(F.when(_divides(83), F.concat(text, F.lit("X"))).otherwise(text), F.lit("|t"))
    twice = F.explode(F.when(_divides(89), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    rows = b.select("pk", _usig(text).alias("target_hash"), twice.alias("copy")).drop("copy")
    return rows.unionByName(ghosts)


def changes_at(spark: SparkSession, sf_dir: str, cycle: int) -> DataFrame:
    b = base(spark, sf_dir).where(_divides(10) if cycle == 1 else F.lit(False)).withColumn("t", F.concat("t", F.lit("u")))
    return b.select("pk", SIG(F.col("t")).alias("source_hash"), _usig(F.concat("t", F.lit("|t"))).alias("target_hash"))


def states(spark: SparkSession, sf_dir: str, cycles: int, engine: str = "union", tidy: bool = True) -> DataFrame:
    """The state after the initial load and some cycles; ``tidy``: the last one without gone rows, as all others are."""
    state = reconcile.initial_load(source_at(spark, sf_dir, 0), target_at(spark, sf_dir, 0), engine)
    for c in range(1, cycles + 1):
        state = reconcile.incremental(reconcile.without_gone(state), source_at(spark, sf_dir, c).drop("target_hash"), target_at(spark, sf_dir, c), changes_at(spark, sf_dir, c), engine)
    return reconcile.without_gone(state) if tidy else state


def _wide(df: DataFrame) -> DataFrame:
    """Codes as bigint, for comparison."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("tinyint", "int", "smallint") else F.col(c) for c, t in df.dtypes])


def _sig(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 15))::BIGINT"


def _usig_sql(x: str) -> str:
    return f"{_sig(x)}::DECIMAL(20,0)"


_BASE = "base AS (SELECT o_orderkey AS pk, coalesce(o_orderkey::VARCHAR, '👻') || coalesce(o_orderstatus, '👻') || coalesce(o_orderpriority, '👻') AS t FROM orders)"


def _source_sql(c: int) -> str:
    t = "t" if c == 0 else "CASE WHEN pk % 10 = 0 THEN t || 'u' ELSE t END"
    where = "" if c == 0 else " WHERE pk % 53 <> 0"
    return f"s{c} AS (SELECT pk, {_sig('x')} AS source_hash, {_usig_sql("x || '|t'")} AS target_hash FROM (SELECT pk, {t} AS x FROM base{where}))"


def _target_sql(c: int) -> str:
    u = "''" if c == 0 else "CASE WHEN pk % 10 = 0 AND pk % 20 <> 0 THEN 'u' ELSE '' END"
    where = "" if c == 0 else " AND (pk % 53 <> 0 OR pk % 106 = 0)"
    x = f"t || {u} || CASE WHEN pk % 83 = 0 THEN 'X' ELSE '' END || '|t'"
    rows = f"SELECT pk, {_usig_sql(x)} AS target_hash FROM base WHERE pk % 97 <> 0{where}"
    return f"t{c} AS ({rows} UNION ALL {rows} AND pk % 89 = 0 UNION ALL SELECT pk + 10000000, 1::DECIMAL(20,0) FROM base WHERE pk % 79 = 0)"


def _changes_sql(c: int) -> str:
    where = "pk % 10 = 0" if c == 1 else "false"
    return f"c{c} AS (SELECT pk, {_sig("t || 'u'")} AS source_hash, {_usig_sql("t || 'u|t'")} AS target_hash FROM base WHERE {where})"


_COUNTED = "SELECT pk, min(target_hash) AS ts, count(*) AS tc FROM {t} GROUP BY pk"
_OP = "CASE WHEN {a} IS NULL AND {b} IS NULL THEN 1 WHEN {b} IS NULL THEN 3 WHEN {a} IS NULL THEN 5 WHEN {a} <> {b} THEN 4 ELSE 2 END::BIGINT"
_VERIFIED = "({is_} IS NULL OR {it} IS NULL OR (coalesce({is_} = {s}, false) AND coalesce({it} = {t}, false)))"
_RULES = """((pso NOT IN (2, 1, 5) AND pdo IN (2, 1) AND do_ IN (2, 1) AND so IN (2, 1)) OR (pso = 5 AND do_ = 2)
  OR (so IN (2, 4) AND pso IN (2, 4, 3) AND do_ = 1) OR (so = 1 AND pso = 1 AND do_ = 2)
  OR (so = 2 AND pso = 2 AND do_ <> 2 AND NOT ex) OR (ex AND so IN (2, 1) AND do_ IN (2, 1)))"""
_NULL = "so IS NULL OR pso IS NULL OR do_ IS NULL OR pdo IS NULL OR ex IS NULL"
_STATE_VERIFIED = _VERIFIED.format(is_="incremental_source_signature", it="incremental_target_signature", s="source_signature", t="target_signature")
_STATUS = """CASE WHEN {err} THEN 2 WHEN ({so} NOT IN (2, 1) AND {do} IN (2, 1)) OR (NOT coalesce({ok}, false) AND {so} NOT IN (1, 5))
  OR ({so} IN (1, 5) AND {do} NOT IN (1, 5)) THEN 1 WHEN {so} IN (1, 5) AND {do} IN (1, 5) THEN 3 WHEN {n} > 1 THEN 2 ELSE 0 END::BIGINT"""
_STATE_STATUS = _STATUS.format(err="validation_error", so="source_operation", do="target_operation", ok=_STATE_VERIFIED, n="target_count")


def _state_sql(cycles: int) -> str:
    """CTEs up to raw{cycles} (all rows) and state{cycles} (without gone ones)."""
    parts = [_BASE, _source_sql(0), _target_sql(0)]
    parts.append(
        f"""raw0 AS (SELECT pk, s.source_hash AS source_signature, ts AS target_signature, s.source_hash AS incremental_source_signature,
  s.target_hash AS incremental_target_signature, 3::BIGINT AS source_operation, CASE WHEN ts IS NULL THEN 1 ELSE 3 END::BIGINT AS target_operation,
  false AS validation_error, tc AS target_count FROM s0 s FULL JOIN ({_COUNTED.format(t="t0")}) t USING (pk))"""
    )
    parts.append(f"state0 AS (SELECT * FROM raw0 WHERE {_STATE_STATUS} <> 3)")
    for c in range(1, cycles + 1):
        parts += [_source_sql(c), _target_sql(c), _changes_sql(c)]
        parts.append(
            f"""j{c} AS (SELECT pk, s.source_hash AS ss, ts, tc, coalesce(i.source_hash, p.incremental_source_signature) AS is_,
  coalesce(i.target_hash, p.incremental_target_signature) AS it, {_OP.format(a="s.source_hash", b="p.source_signature")} AS so,
  {_OP.format(a="ts", b="p.target_signature")} AS do_, p.source_operation AS pso, p.target_operation AS pdo, coalesce(p.validation_error, false) AS ex
  FROM s{c} s FULL JOIN state{c - 1} p USING (pk) FULL JOIN ({_COUNTED.format(t=f"t{c}")}) t USING (pk) FULL JOIN c{c} i USING (pk))"""
        )
        parts.append(
            f"""raw{c} AS (SELECT pk, ss AS source_signature, ts AS target_signature, is_ AS incremental_source_signature, it AS incremental_target_signature,
  so AS source_operation, do_ AS target_operation, CASE WHEN {_NULL} THEN NULL ELSE {_RULES} OR (so = 2 AND NOT {_VERIFIED.format(is_="is_", it="it", s="ss", t="ts")}) END AS validation_error,
  tc AS target_count FROM j{c})"""
        )
        parts.append(f"state{c} AS (SELECT * FROM raw{c} WHERE {_STATE_STATUS} <> 3)")
    return "WITH " + ",\n".join(parts) + "\n"


_METRICS = f"""SELECT count(source_signature) AS source_size, count(target_signature) AS target_size, count(*) AS total_size,
  count(*) FILTER (st = 0) AS valid_count, count(*) FILTER (st = 1) AS pending_count, count(*) FILTER (st = 2) AS error_count
  FROM (SELECT *, {_STATE_STATUS} AS st FROM {{t}})"""

# ---- scans -------------------------------------------------------------------------------------------------------

ORDERS = TableSpec(
    "orders",
    "o_orderkey",
    (
        ColumnMapping("o_orderkey", "bigint", "Int64"),
        ColumnMapping("o_custkey", "bigint", "Int64"),
        ColumnMapping("o_orderstatus", "text", "String"),
        ColumnMapping("o_orderdate", "timestamp", "DateTime"),
        ColumnMapping("o_orderpriority", "text", "String"),
    ),
)
_TEXT = "coalesce(o_orderkey::VARCHAR, '👻') || coalesce(o_custkey::VARCHAR, '👻') || coalesce(o_orderstatus, '👻') || coalesce(o_orderdate::TIMESTAMP::VARCHAR, '👻') || coalesce(o_orderpriority, '👻')"
_FAMILY_TEXT = "coalesce(o_orderkey::VARCHAR, '0') || coalesce(o_custkey::VARCHAR, '0') || coalesce(o_orderstatus, '0') || coalesce(CASE WHEN length(o_orderdate::TIMESTAMP::VARCHAR) = 19 THEN o_orderdate::TIMESTAMP::VARCHAR || '.000000' ELSE o_orderdate::TIMESTAMP::VARCHAR END, '0') || coalesce(o_orderpriority, '0')"


@query(f"SELECT o_orderkey AS pk, {_sig(_TEXT)} AS source_hash FROM orders")
def source_hash_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.source_scan(_table(spark, sf_dir, "orders"), ORDERS, SIG)


@query(f"SELECT o_orderkey AS pk, {_usig_sql(_TEXT)} AS target_hash FROM orders")
def target_hash_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.target_scan(_table(spark, sf_dir, "orders"), ORDERS, _usig)


@query(f"SELECT o_orderkey AS pk, {_sig(_TEXT)} AS source_hash, {_usig_sql(_FAMILY_TEXT)} AS target_hash FROM orders")
def extract_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.extract_scan(_table(spark, sf_dir, "orders"), ORDERS, mappers.mapper("family"), SIG, _usig)


@query(f"SELECT o_orderkey AS pk, {_sig(_TEXT)} AS source_hash, {_TEXT} AS source_text FROM orders WHERE o_orderkey IN (1, 7, 32, 1000, 5000)")
def inspect_pks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.inspect_source(_table(spark, sf_dir, "orders"), ORDERS, [1, 7, 32, 1000, 5000], SIG)


@query(f"SELECT o_orderkey AS pk, {_usig_sql(_TEXT)} AS target_hash, {_TEXT} AS target_text FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def inspect_target_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select("l_orderkey")
    return scans.inspect_target(_table(spark, sf_dir, "orders"), ORDERS, keys, _usig)


_VERSIONED = "SELECT user_id AS pk, event_id AS version, event_type AS kind, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS deleted FROM events"


def _versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("pk"), F.col("event_id").alias("version"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 7 == 0, 1).otherwise(0).alias("deleted"))


@query(f"SELECT pk, version, kind, deleted FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY version DESC) AS r FROM ({_VERSIONED})) WHERE r = 1")
def target_final_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.latest_versions(_versioned(spark, sf_dir), "pk", "version")


@query(f"SELECT pk, version, kind, deleted FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY version DESC) AS r FROM ({_VERSIONED})) WHERE r = 1 AND deleted = 0")
def soft_delete_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.final(_versioned(spark, sf_dir), "pk", "version", "deleted")


@query(f"WITH {_BASE}, {_target_sql(0)} SELECT pk, ts AS target_signature, tc AS target_count FROM ({_COUNTED.format(t='t0')})")
def duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.count_duplicates(target_at(spark, sf_dir, 0))


@query(f"SELECT count(*) AS rows, sum(length(o_orderkey::VARCHAR) + length({_sig(_TEXT)}::VARCHAR) + 2)::BIGINT AS output_bytes FROM orders")
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.scan_stats(source_hash_scan(spark, sf_dir), "source")


@query(f"SELECT sum(length({_TEXT}))::BIGINT AS source_bytes, sum(length(o_orderkey::VARCHAR) + length({_sig(_TEXT)}::VARCHAR) + 2)::BIGINT AS output_bytes, sum(length(o_orderkey::VARCHAR) + length({_sig(_TEXT)}::VARCHAR) + 2) * 100.0::DOUBLE / sum(length({_TEXT})) AS transfer_pct FROM orders")
def transfer_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = canonical.row_text(ORDERS.source_columns)
    o = _table(spark, sf_dir, "orders").select(F.length(text).alias("n"), F.length(F.col("o_orderkey").cast("string")).alias("k"), F.length(SIG(text).cast("string")).alias("h"))
    sums = o.agg(F.sum("n").alias("source_bytes"), F.sum(F.col("k") + F.col("h") + 2).alias("output_bytes"))
    return sums.withColumn("transfer_pct", F.col("output_bytes") * 100.0 / F.col("source_bytes"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100")
def subset_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.first_keys(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 100)


@query(f"WITH {_BASE}, {_source_sql(1)}, {_target_sql(1)}, {_changes_sql(1)} SELECT pk FROM s1 UNION SELECT pk FROM t1 UNION SELECT pk FROM c1")
def pk_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.key_union(source_at(spark, sf_dir, 1), target_at(spark, sf_dir, 1), changes_at(spark, sf_dir, 1))


# ---- functions ---------------------------------------------------------------------------------------------------

_PAIR = "SELECT o_orderkey AS pk, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {v} END AS now_, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN {w} ELSE {v} END AS before_ FROM orders"


def _source_operation_query(name: str, kind: str, sql_kind: str) -> None:
    v, w = f"o_custkey::{sql_kind}", f"(o_custkey + 1)::{sql_kind}"

    @query(f"SELECT pk, {_OP.format(a='now_', b='before_')} AS operation FROM ({_PAIR.format(v=v, w=w)})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o, k = _table(spark, sf_dir, "orders"), F.col("o_orderkey")
        a, b = F.col("o_custkey").cast(kind), (F.col("o_custkey") + 1).cast(kind)
        now, before = F.when(k % 5 != 0, a), F.when(k % 3 == 0, F.lit(None)).when(k % 4 == 0, b).otherwise(a)
        return o.select(k.alias("pk"), sm.source_operation(now, before).cast("bigint").alias("operation"))

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


for _n, _k, _s in (("int", "bigint", "BIGINT"), ("uint", "decimal(20,0)", "DECIMAL(20,0)"), ("varchar", "string", "VARCHAR")):
    _source_operation_query(f"determine_source_operation_{_n}", _k, _s)

_FLAG = "CASE WHEN o_orderkey % {m} = 0 THEN NULL ELSE (o_orderkey // {d}) % 2 = 1 END"


@query(
    f"""SELECT pk, CASE WHEN e IS NULL OR u IS NULL OR b IS NULL THEN NULL WHEN e AND u AND b THEN 4 WHEN e AND u THEN 6 WHEN e AND b THEN 2
  WHEN e THEN 3 WHEN u AND b THEN 7 WHEN u THEN 8 WHEN b THEN 5 ELSE 1 END::BIGINT AS operation
  FROM (SELECT o_orderkey AS pk, {_FLAG.format(m=11, d=1)} AS e, {_FLAG.format(m=13, d=2)} AS u, {_FLAG.format(m=17, d=4)} AS b FROM orders)"""
)
def determine_destination_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    flag = lambda m, d: F.when(k % m != 0, F.floor(k / d) % 2 == 1)
    return _table(spark, sf_dir, "orders").select(k.alias("pk"), sm.destination_operation(flag(11, 1), flag(13, 2), flag(17, 4)).cast("bigint").alias("operation"))


_KINDS = {"varchar": ("string", "VARCHAR"), "int": ("bigint", "BIGINT"), "uint": ("decimal(20,0)", "DECIMAL(20,0)")}


def _integrity_query(name: str, left: str, right: str) -> None:
    (lk, ls), (rk, rs) = _KINDS[left], _KINDS[right]
    inner = f"SELECT o_orderkey AS pk, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END::{ls} AS a, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey + 1 END::{rs} AS b, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END END::{ls} AS c, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey + 1 END::{rs} AS d FROM orders"

    @query(f"SELECT pk, {_VERIFIED.format(is_='a', it='b', s='c', t='d')} AS verified FROM ({inner})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        k, v = F.col("o_orderkey"), F.col("o_custkey")
        a, b = F.when(k % 7 != 0, v).cast(lk), F.when(k % 11 != 0, v + 1).cast(rk)
        c, d = F.when(k % 5 != 0, v + F.when(k % 3 == 0, 1).otherwise(0)).cast(lk), F.when(k % 13 != 0, v + 1).cast(rk)
        return _table(spark, sf_dir, "orders").select(k.alias("pk"), sm.row_integrity(a, b, c, d).alias("verified"))

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


for _a in _KINDS:
    for _b in _KINDS:
        _integrity_query(f"verify_row_integrity_{_a}" if _a == _b else f"verify_row_integrity_{_a[0]}_{_b[0]}", _a, _b)

# all operations on both sides, now and before, with each flag true, false or null: 8^4 * 3 * 3 rows
_ALL = "SELECT i AS id, i % 8 + 1 AS so, i // 8 % 8 + 1 AS pso, i // 64 % 8 + 1 AS do_, CASE WHEN i // 512 % 9 = 8 THEN NULL ELSE i // 512 % 9 + 1 END AS pdo, CASE i // 4608 % 3 WHEN 0 THEN false WHEN 1 THEN true END AS ex, CASE i // 13824 % 3 WHEN 0 THEN false WHEN 1 THEN true END AS ok FROM range(41472) r(i)"


def _all_cases(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    at = lambda d, m: F.floor(i / d) % m
    flag = lambda d: F.when(at(d, 3) == 0, False).when(at(d, 3) == 1, True)
    return spark.range(41472).select("id", (i % 8 + 1).alias("so"), (at(8, 8) + 1).alias("pso"), (at(64, 8) + 1).alias("do"), F.when(at(512, 9) < 8, at(512, 9) + 1).alias("pdo"), flag(4608).alias("ex"), flag(13824).alias("ok"))


@query(f"SELECT id, CASE WHEN {_NULL} THEN NULL ELSE {_RULES} END AS error FROM ({_ALL})")
def check_validation_error_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_cases(spark).select("id", sm.validation_error("so", "pso", "do", "pdo", "ex").alias("error"))


@query(f"SELECT id, CASE WHEN {_NULL} OR ok IS NULL THEN NULL ELSE {_RULES} OR (so = 2 AND NOT ok) END AS error FROM ({_ALL})")
def check_validation_error_with_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_cases(spark).select("id", sm.validation_error_with_integrity("so", "pso", "do", "pdo", "ex", "ok").alias("error"))


@query(f"SELECT id, {_STATUS.format(err='ex', so='so', do='do_', ok='ok', n='pso')} AS status FROM ({_ALL})")
def status_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_cases(spark).select("id", sm.validation_status("ex", "so", "do", "ok", "pso").cast("bigint").alias("status"))


@query(f"{_state_sql(1)} SELECT pk, {_STATE_STATUS} AS status FROM raw1")
def validation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(reconcile.with_status(states(spark, sf_dir, 1, tidy=False)).select("pk", "status"))


@query("SELECT i AS code, CASE i WHEN 1 THEN 'DOES_NOT_EXIST' WHEN 2 THEN 'NOOP' WHEN 3 THEN 'INSERT' WHEN 4 THEN 'UPDATE' WHEN 5 THEN 'DELETE' WHEN 6 THEN 'INSERT_AND_UPDATE' WHEN 7 THEN 'UPDATE_AND_DELETE' WHEN 8 THEN 'TRANSIENT_UPDATE' END AS name, CASE WHEN i BETWEEN 1 AND 8 THEN i END::BIGINT AS back FROM range(0, 11) r(i)")
def operation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = spark.range(11).select(F.col("id").alias("code"), sm.operation_name("id").alias("name"))
    return named.withColumn("back", sm.operation_code("name").cast("bigint"))


@query("SELECT c_custkey AS pk, len(list_distinct(regexp_extract_all(c_name || c_mktsegment, '.')))::BIGINT AS n FROM customer")
def count_distinct_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pk"), sm.count_distinct_characters(F.concat("c_name", "c_mktsegment")).cast("bigint").alias("n"))


@query("SELECT doc_id AS pk, coalesce(replace(replace(text, chr(10), '\\n'), chr(13), '\\r'), '') AS shown FROM documents")
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pk"), F.coalesce(canonical.visible("text"), F.lit("")).alias("shown"))


@query(f"SELECT o_orderkey AS pk, {_TEXT} AS text FROM orders")
def generic_mapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mappers.mapper("generic")
    m.set_schema(ORDERS.families("source"), ORDERS.families("target"))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pk"), m.source_text([F.col(c) for c in ORDERS.source_columns]).alias("text"))


COPIES = TableSpec("copies", "id", (ColumnMapping("id", "bigint", "Int64"), ColumnMapping("price", "numeric(12,2)", "Decimal"), ColumnMapping("ratio", "double precision", "Float64"), ColumnMapping("props", "jsonb", "String")))


@query(
    """WITH t AS (SELECT count(*) AS n, count(*) FILTER (event_id % 997 = 0) AS gone, count(*) FILTER (event_id % 1000 = 7 AND event_id % 7 <> 0 AND event_id % 997 <> 0) AS other FROM events)
SELECT n AS source_size, n - gone AS target_size, n AS total_size, n - gone - other AS valid_count, gone + other AS pending_count, 0::BIGINT AS error_count FROM t"""
)
def family_mapper_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy in files, read here: decimals that end in zeros, nulls, NaN, infinity and JSON are valid, rows that are changed or gone are found."""
    from tidemark.plans import cycle

    i = F.col("event_id")
    ratio = F.when(i % 5 == 0, F.lit("NaN").cast("double")).when(i % 5 == 1, F.lit("-Infinity").cast("double")).otherwise(F.col("value") / 3)
    price = F.when(i % 7 != 0, F.round("value").cast("decimal(12,2)"))
    source = _table(spark, sf_dir, "events").select(i.alias("id"), price.alias("price"), ratio.alias("ratio"), "props")
    changed = F.when(F.col("id") % 1000 == 7, F.col("price") + 1).otherwise(F.col("price")).cast("decimal(12,2)")
    target = source.where("id % 997 <> 0").withColumn("price", changed)
    data = cycle.fetch(source, target, COPIES, mappers.mapper("family"), True)
    return reconcile.metrics(cycle.next_state(data, None, True))


@query("SELECT event_id AS pk, CASE event_id % 5 WHEN 0 THEN 'inf' WHEN 1 THEN '-inf' WHEN 2 THEN 'nan' ELSE (event_id % 90 + 10)::VARCHAR || CASE event_id % 2 WHEN 0 THEN 'e38' ELSE 'e-7' END END AS text FROM events")
def family_mapper_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    raw = F.when(i % 5 == 0, "Infinity").when(i % 5 == 1, "-Infinity").when(i % 5 == 2, "NaN").otherwise(F.concat((i % 90 + 10).cast("string"), F.when(i % 2 == 0, "e+38").otherwise("e-7")))
    return _table(spark, sf_dir, "events").select(i.alias("pk"), mappers.float_text(raw).alias("text"))


@query("SELECT event_id AS pk, CASE WHEN contains(v, '.') THEN rtrim(rtrim(v, '0'), '.') ELSE v END AS text FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN (event_id * 10)::VARCHAR ELSE value::DECIMAL(18,2)::VARCHAR || '00' END AS v FROM events)")
def family_mapper_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, (i * 10).cast("string")).otherwise(F.concat(F.col("value").cast("decimal(18,2)").cast("string"), F.lit("00")))
    return _table(spark, sf_dir, "events").select(i.alias("pk"), mappers.decimal_text(raw).alias("text"))


@query("SELECT event_id AS pk, CASE WHEN event_id % 2 = 0 THEN strftime(ts::TIMESTAMP, '%Y-%m-%d %H:%M:%S') || '.000000' ELSE strftime(ts::TIMESTAMP, '%Y-%m-%d %H:%M:%S.%f') END AS text FROM events")
def family_mapper_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("pk"), mappers.datetime_text(ts).alias("text"))


@query("SELECT event_id AS pk, CASE WHEN event_id % 9 = 0 THEN '{\"z\": oops' ELSE '{\"a\":{\"c\":[3,\"x\",null],\"d\":true},\"b\":' || event_id || '}' END AS text FROM events")
def json_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    raw = F.when(i % 9 == 0, F.lit('{"z": oops')).otherwise(F.concat(F.lit('{"b" : '), i.cast("string"), F.lit(', "a": {"d": true, "c": [3, "x", null]}}')))
    return _table(spark, sf_dir, "events").select(i.alias("pk"), mappers.json_text(raw).alias("text"))


@query("SELECT event_id AS pk, '{\"a\":1.50,\"b\":' || event_id || '}' AS text FROM events")
def json_canonical_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('{"b" : '), F.col("event_id").cast("string"), F.lit(', "a":1.50}'))
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("pk"), mappers.exact_json_text(raw).alias("text"))


@query("SELECT p_partkey AS pk, p_partkey::VARCHAR || p_name || printf('%.6f', p_retailprice) || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END AS text FROM part")
def family_mapper_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mappers.mapper("family")
    m.set_schema(["integer", "string", "float", "boolean"], ["integer", "string", "float", "boolean"])
    cols = [F.col("p_partkey"), F.col("p_name"), F.col("p_retailprice"), F.col("p_size") % 2 == 0]
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), m.target_text(cols).alias("text"))


@query(None)
def hashtextextended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.source_scan(_table(spark, sf_dir, "orders"), ORDERS, hashing.pg_hash)


@query(None)
def xxh3_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.target_scan(_table(spark, sf_dir, "orders"), ORDERS, hashing.xxh3)


@query("SELECT pk, u AS unsigned_value, v AS signed_value FROM (SELECT o_orderkey AS pk, CASE WHEN o_orderkey % 2 = 0 THEN -o_orderkey ELSE o_orderkey END AS v, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey > 0 THEN 18446744073709551616::DECIMAL(38,0) - o_orderkey ELSE o_orderkey END::DECIMAL(20,0) AS u FROM orders)")
def unsigned_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    made = _table(spark, sf_dir, "orders").select(k.alias("pk"), hashing.unsigned(F.when(k % 2 == 0, -k).otherwise(k)).alias("unsigned_value"))
    return made.withColumn("signed_value", hashing.signed(F.col("unsigned_value")))


# ---- reconciliation ----------------------------------------------------------------------------------------------


@query(f"{_state_sql(0)} SELECT * FROM raw0")
def shadow_initial_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(states(spark, sf_dir, 0, tidy=False))


@query(f"{_state_sql(1)} SELECT * FROM raw1")
def shadow_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(states(spark, sf_dir, 1, tidy=False))


@query(f"{_state_sql(1)} SELECT * FROM raw1")
def shadow_incremental_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(states(spark, sf_dir, 1, "joins", tidy=False))


@query(f"{_state_sql(3)} SELECT * FROM state3")
def shadow_three_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(states(spark, sf_dir, 3))


@query(f"{_state_sql(2)} SELECT * FROM raw2 WHERE {_STATE_STATUS} = 3")
def gone_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(reconcile.gone(states(spark, sf_dir, 2, tidy=False)))


@query(f"{_state_sql(2)} {_METRICS.format(t='state2')}")
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.metrics(states(spark, sf_dir, 2))


@query(
    " UNION ALL ".join(
        f"SELECT {c}::BIGINT AS cycle, * FROM ({_state_sql(c)} {_METRICS.format(t=f'state{c}')})" for c in range(4)
    )
)
def metrics_by_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for c in range(4):
        one = reconcile.metrics(states(spark, sf_dir, c)).select(F.lit(c).cast("bigint").alias("cycle"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{_state_sql(1)} SELECT string_agg(pk::VARCHAR, ';' ORDER BY pk) AS error_pks, count(*) AS n_errors FROM state1 WHERE {_STATE_STATUS} = 2")
def error_pk_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.error_list(states(spark, sf_dir, 1)).select("error_pks", "n_errors")


_JSON = """'{"pk":' || pk || ',"source_signature":' || coalesce(source_signature::VARCHAR, 'null') || ',"target_signature":' || coalesce(target_signature::VARCHAR, 'null') || '}'"""


@query(f"{_state_sql(1)} SELECT '[' || string_agg({_JSON}, ',' ORDER BY pk) || ']' AS error_pks_json FROM state1 WHERE {_STATE_STATUS} = 2")
def error_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.error_list(states(spark, sf_dir, 1)).select("error_pks_json")


@query(f"{_state_sql(1)} SELECT pk, source_signature, target_signature FROM state1 WHERE {_STATE_STATUS} = 2")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.errors(states(spark, sf_dir, 1)).select("pk", "source_signature", "target_signature")


def _view(name: str, f: Callable[[DataFrame], DataFrame], where: str) -> None:
    @query(f"{_state_sql(1)} SELECT pk, source_signature, target_signature FROM state1 WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(states(spark, sf_dir, 1)).select("pk", "source_signature", "target_signature")

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


_view("missing_rows", reconcile.missing_rows, "source_signature IS NOT NULL AND target_signature IS NULL")
_view("phantom_rows", reconcile.phantom_rows, "source_signature IS NULL AND target_signature IS NOT NULL")
_view("corrupted_rows", reconcile.corrupted_rows, f"source_signature IS NOT NULL AND target_signature IS NOT NULL AND NOT {_STATE_VERIFIED}")
_view("duplicate_rows", reconcile.duplicate_rows, "target_count > 1")

# ---- change log --------------------------------------------------------------------------------------------------

EVENTS = TableSpec("events", "user_id", (ColumnMapping("user_id", "bigint", "Int64"), ColumnMapping("event_type", "text", "String"), ColumnMapping("props", "json", "String")))
_LOG_OP = "CASE WHEN event_id % 11 = 0 THEN 'D' WHEN event_id % 2 = 0 THEN 'U' ELSE 'I' END"
_EVENT_TEXT = "user_id::VARCHAR || event_type || props"


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return _table(spark, sf_dir, "events").select(i.alias("lsn"), F.when(i % 11 == 0, "D").when(i % 2 == 0, "U").otherwise("I").alias("op"), F.when(i % 13 != 0, F.col("user_id")).alias("user_id"), "event_type", "props")


_LWW = f"SELECT user_id AS pk, {_sig(_EVENT_TEXT)} AS source_hash, {_usig_sql(_EVENT_TEXT)} AS target_hash FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE {_LOG_OP} IN ('I', 'U') AND event_id % 13 <> 0) WHERE r = 1"


@query(_LWW)
def change_log_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = changes.hashed(event_log(spark, sf_dir), EVENTS, mappers.mapper("generic"), SIG, _usig)
    return changes.newest_changes(made)


@query(f"WITH {_BASE}, {_source_sql(0)}, {_changes_sql(1)} SELECT pk, coalesce(c.source_hash, s.source_hash) AS source_hash, coalesce(c.target_hash, s.target_hash) AS target_hash FROM (SELECT * FROM s0 WHERE pk % 30 <> 0) s FULL JOIN c1 c USING (pk)")
def ht_map_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.upsert_map(source_at(spark, sf_dir, 0).where("pk % 30 <> 0"), changes_at(spark, sf_dir, 1))


_TUPLES = "SELECT event_id AS lsn, ['t', CASE event_id % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'u' WHEN 2 THEN 'b' ELSE 't' END] AS kinds, [user_id::VARCHAR, event_type] AS vals FROM events"


@query(f"SELECT lsn, vals[1] AS user_id, CASE WHEN kinds[2] IN ('t', 'b') THEN vals[2] END AS event_type FROM ({_TUPLES})")
def decode_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.when(i % 4 == 0, "n").when(i % 4 == 1, "u").when(i % 4 == 2, "b").otherwise("t")
    log = _table(spark, sf_dir, "events").select(i.alias("lsn"), F.array(F.lit("t"), kind).alias("kinds"), F.array(F.col("user_id").cast("string"), "event_type").alias("values"))
    return changes.decode_tuple(log, ["user_id", "event_type"]).select("lsn", "user_id", "event_type")


@query("SELECT event_id AS lsn FROM events WHERE event_id % 3 = 1 AND event_id % 2 = 0")
def change_log_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    log = _table(spark, sf_dir, "events").select(i.alias("lsn"), F.when(i % 2 == 0, "public").otherwise("other").alias("schema"), F.when(i % 3 == 1, "events").otherwise("orders").alias("table"))
    return changes.of_table(log, EVENTS).select("lsn")


def _stream(spark: SparkSession, sf_dir: str, batches: int = 3) -> tuple[str, DataFrame]:
    """The event log as a folder of files in the shared folder, oldest first, and a streaming reader of it."""
    import tempfile
    import uuid

    from tidemark.streaming import change_stream

    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-stream-")
    folder = f"{root}/tidemark-stream-{uuid.uuid4()}"
    log = event_log(spark, sf_dir)
    for k in range(batches):
        log.where(F.pmod("lsn", F.lit(batches)) == k).write.mode("append").parquet(f"{folder}/log")
    return folder, change_stream.read_log(spark, f"{folder}/log", log.schema, 4)


@query(_LWW)
def streaming_change_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream of several batches, in no order of the positions: the last write of each key decides all the same."""
    from tidemark.streaming import change_stream

    folder, log = _stream(spark, sf_dir)
    out = f"{folder}/map"
    hashed = changes.hashed(log, EVENTS, mappers.mapper("generic"), SIG, _usig)

    def write(batch: DataFrame, number: int) -> None:
        changes.last_write(batch, "pk").write.mode("overwrite").parquet(f"{out}/batch={number}")

    hashed.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    return change_stream.change_map(spark, out)


@query("SELECT n AS source_size, n AS target_size, n AS total_size, n AS valid_count, 0::BIGINT AS pending_count, 0::BIGINT AS error_count FROM (SELECT count(DISTINCT user_id) AS n FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0)")
def streaming_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles driven by a stream: events are consumed to their end into a change map, and one cycle reconciles it with the last
    event of each user on both sides. All keys come out valid."""
    from tidemark.plans.cycle import DataSet, run_cycle
    from tidemark.plans.state import StateStore
    from tidemark.streaming import change_stream

    folder, log = _stream(spark, sf_dir)
    how = mappers.mapper("generic")
    made = change_stream.consume(log, EVENTS, how, f"{folder}/map", f"{folder}/offsets")
    last = changes.last_write(changes.row_records(event_log(spark, sf_dir), "user_id"), "user_id")
    source, target = scans.source_scan(last, EVENTS), scans.target_scan(last, EVENTS)
    store = StateStore(spark, f"{folder}/state")
    store.write(reconcile.empty_state(spark), 0)
    run_cycle(store, DataSet(target_scan=target, source_scan=source, source_changes=made), version=1)
    run_cycle(store, DataSet(target_scan=target, source_scan=source, source_changes=made.limit(0)), version=2)
    return reconcile.metrics(store.read())


# ---- drill-down --------------------------------------------------------------------------------------------------

_ERRORS = f"{_state_sql(1)} SELECT pk, source_signature, target_signature FROM state1 WHERE {_STATE_STATUS} IN (1, 2)"


def _not_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.with_status(states(spark, sf_dir, 1)).where(F.col("status").isin(sm.PENDING, sm.ERROR)).select("pk", "source_signature", "target_signature")


@query(f"SELECT *, CASE WHEN source_signature IS NULL THEN 'target-only' WHEN target_signature IS NULL THEN 'source-only' ELSE 'drifted' END AS error_class FROM ({_ERRORS}) WHERE source_signature IS NOT NULL OR target_signature IS NOT NULL")
def classify_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.classify_errors(_not_valid(spark, sf_dir))


@query(f"SELECT count(*) FILTER (target_signature IS NULL) AS source_only, count(*) FILTER (source_signature IS NULL) AS target_only, count(*) FILTER (source_signature IS NOT NULL AND target_signature IS NOT NULL) AS drifted, count(*) AS total FROM ({_ERRORS}) WHERE source_signature IS NOT NULL OR target_signature IS NOT NULL")
def error_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.error_counts(_not_valid(spark, sf_dir))


_CUSTOMERS = "SELECT c_custkey AS pk, c_name, c_nationkey::BIGINT AS c_nationkey, c_mktsegment FROM customer"


def _customers(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    c, k = _table(spark, sf_dir, "customer"), F.col("c_custkey")
    if side == "source":
        return c.select(k.alias("pk"), "c_name", F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "c_mktsegment")
    name = F.when(k % 31 == 0, F.concat("c_name", F.lit("?"))).otherwise(F.col("c_name"))
    nation = F.when(k % 17 != 0, F.col("c_nationkey")).cast("bigint")
    return c.where(k % 29 != 0).select(k.alias("pk"), name.alias("c_name"), nation.alias("c_nationkey"), F.lit("x").alias("extra"))


_COPY = "SELECT c_custkey AS pk, CASE WHEN c_custkey % 31 = 0 THEN c_name || '?' ELSE c_name END AS c_name, CASE WHEN c_custkey % 17 <> 0 THEN c_nationkey END::BIGINT AS c_nationkey, 'x' AS extra FROM customer WHERE c_custkey % 29 <> 0"
_EQUAL = "CASE WHEN {a} IS NOT DISTINCT FROM {b} THEN 'equal' ELSE 'differs' END"


@query(
    f"""WITH s AS ({_CUSTOMERS}), t AS ({_COPY}), j AS (SELECT s.pk, s.c_name AS sn, t.c_name AS tn, s.c_nationkey::VARCHAR AS sk, t.c_nationkey::VARCHAR AS tk, c_mktsegment, extra FROM s JOIN t USING (pk))
SELECT pk, 'c_name' AS field, {_EQUAL.format(a="sn", b="tn")} AS verdict, sn AS source_value, tn AS target_value FROM j
UNION ALL SELECT pk, 'c_nationkey', {_EQUAL.format(a="sk", b="tk")}, sk, tk FROM j
UNION ALL SELECT pk, 'c_mktsegment', 'missing in target', c_mktsegment, NULL FROM j
UNION ALL SELECT pk, 'extra', 'missing in source', NULL, extra FROM j"""
)
def field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.field_diff(_customers(spark, sf_dir, "source"), _customers(spark, sf_dir, "target"), "pk")


@query(
    f"""WITH s AS ({_CUSTOMERS}), t AS ({_COPY}), j AS (SELECT coalesce(s.pk, t.pk) AS pk, s.pk AS l, t.pk AS r, s.c_name AS sn, t.c_name AS tn, s.c_nationkey::VARCHAR AS sk, t.c_nationkey::VARCHAR AS tk FROM s FULL JOIN t ON s.pk = t.pk)
SELECT pk, 'c_name' AS field, {_EQUAL.format(a="sn", b="tn")} AS verdict, sn AS left_value, tn AS right_value FROM j WHERE l IS NOT NULL AND r IS NOT NULL
UNION ALL SELECT pk, 'c_nationkey', {_EQUAL.format(a="sk", b="tk")}, sk, tk FROM j WHERE l IS NOT NULL AND r IS NOT NULL
UNION ALL SELECT pk, 'pk', CASE WHEN r IS NULL THEN 'only left' ELSE 'only right' END, NULL, NULL FROM j WHERE l IS NULL OR r IS NULL"""
)
def inspect_scan_vs_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.inspect_diff(_customers(spark, sf_dir, "source"), _customers(spark, sf_dir, "target"))


@query(f"WITH keys AS (SELECT pk FROM ({_ERRORS}) WHERE source_signature IS NOT NULL AND target_signature IS NOT NULL) SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT pk FROM keys)")
def drifted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = diagnose.classify_errors(_not_valid(spark, sf_dir)).where("error_class = 'drifted'").select("pk")
    return diagnose.rows_of(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", keys)


# ---- SQL functions, type families, hash vectors -------------------------------------------------------------------


@query(f"{_state_sql(1)} SELECT pk, {_STATE_STATUS} AS status FROM state1")
def sql_functions_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine by its SQL functions."""
    sm.register(spark)
    verified = "verify_row_integrity_int(incremental_source_signature, CAST(incremental_target_signature AS BIGINT), source_signature, CAST(target_signature AS BIGINT))"
    return states(spark, sf_dir, 1).selectExpr("pk", f"CAST(validation_status(validation_error, source_operation, target_operation, {verified}, target_count) AS BIGINT) AS status")


@query(f"SELECT o_orderkey AS pk, {_sig(_TEXT)} AS source_hash, {_usig_sql(_TEXT)} AS target_hash, {_TEXT} AS source_text, {_TEXT} AS target_text FROM orders WHERE o_orderkey % 100 = 1")
def inspect_extract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return scans.inspect_extract(orders, ORDERS, orders.where("o_orderkey % 100 = 1").select("o_orderkey"), mappers.mapper("generic"), SIG, _usig)


@query("SELECT o_orderkey AS pk, o_orderkey::VARCHAR || o_orderstatus AS source_text FROM orders WHERE o_orderkey % 50 = 1")
def inspect_some_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    shown = scans.inspect_source(orders, ORDERS.narrowed(["o_orderstatus"]), orders.where("o_orderkey % 50 = 1").select("o_orderkey"))
    return shown.select("pk", "source_text")


@query(f"{_state_sql(1)} SELECT pk, count(*) AS n FROM (SELECT pk FROM s1 UNION ALL SELECT pk FROM s1 WHERE pk % 3 = 0) GROUP BY pk HAVING count(*) > 1")
def duplicate_source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = source_at(spark, sf_dir, 1)
    return reconcile.duplicate_source_rows(source.unionByName(source.where("pk % 3 = 0")))


@query("SELECT event_id AS pk, 'wrote /tmp/part-' || event_id || '.csv' AS line, '/tmp/part-' || event_id || '.csv|' || event_type || '.parquet' AS files FROM events")
def files_named_in_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("/tmp/part-"), F.col("event_id"), F.lit(".csv"))
    line = F.concat(F.lit('level=info file="'), name, F.lit('" also '), F.col("event_type"), F.lit(".parquet; not "), F.col("event_type"), F.lit(".txt"))
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("pk"), F.concat(F.lit("wrote "), name).alias("line"), F.array_join(diagnose.files_named_in(line), "|").alias("files"))


# Published results of both hashes.
PG_VECTORS = (("a", 42, 6942402718208252407), ("a", 0, 3591986179850072241), ("abcdef", 0, 290958262752763840), ("-32768-922337203685477580800", 0, -8057992206014907360), ("-32768-922337203685477580800", 73, -7881728486066286847), ("-32768-922337203685477580800", 1337, -5664590189151205022), ("👻👻👻👻", 1337, -1361447163658550079))
XXH3_VECTORS = (("a", 16629034431890738719), ("", 3244421341483603138), ("0000", 14525862213172519373))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {seed}::BIGINT, {h}::BIGINT)" for t, seed, h in PG_VECTORS) + ") v(text, seed, hash)")
def hashtextextended_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(t, s) for t, s, _ in PG_VECTORS], "text string, seed bigint")
    made = None
    for seed in dict.fromkeys(s for _, s, _ in PG_VECTORS):
        one = rows.where(F.col("seed") == seed).select("text", "seed", hashing.pg_hash(F.col("text"), seed).alias("hash"))
        made = one if made is None else made.unionByName(one)
    return made


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {h}::DECIMAL(20,0))" for t, h in XXH3_VECTORS) + ") v(text, hash)")
def xxh3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t, _ in XXH3_VECTORS], "text string").select("text", hashing.xxh3(F.col("text")).alias("hash"))
