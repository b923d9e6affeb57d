import pytest
from pyspark.sql import functions as F

from tidemark.functions import canonical, families, mappers
from tidemark.sources.spec import ColumnMapping, TableSpec

COLUMNS = [("id", "integer", "Int64"), ("place", "text", "String"), ("depth", "real", "Float32"), ("cost", "decimal", "Decimal"), ("open", "boolean", "Boolean"), ("seen_at", "timestamp without time zone", "DateTime"), ("built", "date", "Date"), ("notes", "jsonb", "String"), ("slope", "double precision", "Float64"), ("kind", "character", "String")]
SOURCE = [
    ("7", "river", "2.5e+1", "12.3400", "true", "2019-02-03 04:05:06", "2001-09-08", '{"z":1,"a":{"y":[2],"b":null}}', "Infinity", "x"),
    ("8", None, "NaN", "500", "false", "2019-02-03 04:05:06.25", None, "not json", "-1e-07", ""),
    ("9", "a\nb", "0", "-0.10", None, "soon", "2020-02-29", '{"é":"ü","B":true}', "1e+300", "y"),
]
SOURCE_TEXTS = [
    '7river2.5e112.34true2019-02-03 04:05:06.0000002001-09-08{"a":{"b":null,"y":[2]},"z":1}infx',
    "80nan500false2019-02-03 04:05:06.250not json-1e-07",
    '9a\nb0-0.10soon2020-02-29{"B":true,"é":"ü"}1e300y',
]
TARGET = [(7, "river", 25.0, 12.34, True, "2019-02-03 04:05:06 +0000 UTC", "2001-09-08", '{"z":1,"a":2}', 0.5, "x"), (8, None, 0.0, None, False, None, "2020-02-29", "not json", -3.0, "")]
TARGET_TEXTS = [
    '7river25.00000012.340000true2019-02-03 04:05:06 +0000 UTC2001-09-08{"a":2,"z":1}0.500000x',
    "800.0000000false02020-02-29not json-3.000000",
]


def spec():
    return TableSpec("t", "id", tuple(ColumnMapping(*c) for c in COLUMNS))


@pytest.mark.parametrize("exact", [True, False])
def test_family_mapper(spark, exact):
    m = mappers.FamilyMapper(exact)
    m.set_schema(spec().families("source"), spec().families("target"))
    names = [c[0] for c in COLUMNS]
    df = spark.createDataFrame(SOURCE, ", ".join(f"{n} string" for n in names))
    assert [r[0] for r in df.select(m.source_text([F.col(n) for n in names])).collect()] == SOURCE_TEXTS
    kinds = ["bigint", "string", "double", "double", "boolean", "string", "string", "string", "double", "string"]
    df = spark.createDataFrame(TARGET, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    assert [r[0] for r in df.select(m.target_text([F.col(n) for n in names])).collect()] == TARGET_TEXTS
    with pytest.raises(ValueError, match="schema has"):
        m.source_text([F.lit("1")])
    with pytest.raises(ValueError, match="more than"):
        m.set_schema(["string"] * 65, ["string"] * 65)


def values(spark, function, texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(function(F.col("t"))).collect()]


def test_single_rules(spark):
    assert values(spark, mappers.float_text, ["Infinity", "-Infinity", "NaN", "1e+10", "1e-5", None]) == ["inf", "-inf", "nan", "1e10", "1e-5", None]
    assert values(spark, mappers.decimal_text, ["1.500", "100", "0.000", "12.", "-3.10"]) == ["1.5", "100", "0", "12", "-3.1"]
    assert values(spark, mappers.datetime_text, ["2024-01-15 12:34:56", "2024-01-15 12:34:56.5", "2024-01-15", "xxxx-xx-xx xx:xx:xx", "2024/01/15 12:34:56"]) == ["2024-01-15 12:34:56.000000", "2024-01-15 12:34:56.5", "2024-01-15", "xxxx-xx-xx xx:xx:xx.000000", "2024/01/15 12:34:56"]


def test_json(spark):
    odd = ['{"b":1.50,"a":{"d":[1e3,2],"c":null}}', "[ 1 , true ]", "not json", '{"é":"ü","Z":0}', None, '{"a":NaN}', '"x"']
    want = ['{"a":{"c":null,"d":[1e3,2]},"b":1.50}', "[1,true]", "not json", '{"Z":0,"é":"ü"}', None, '{"a":NaN}', '"x"']
    assert values(spark, mappers.exact_json_text, odd) == want
    assert values(spark, mappers.json_text, odd[1:5]) == want[1:5]
    big = '{"b":"' + "x" * mappers.MAX_JSON_BYTES + '","a":1}'
    assert mappers.canonical_json(big) == big and values(spark, mappers.json_text, [big]) == [big]


def test_generic_and_function_mapper_and_registry(spark):
    df = spark.createDataFrame([("1", None, "x")], "a string, b string, c string")
    cols = [F.col(c) for c in "abc"]
    assert df.select(mappers.mapper("generic").source_text(cols)).first()[0] == "1👻x"
    mappers.register_mapper("joined", lambda: mappers.FunctionMapper("joined", lambda row: "|".join(x or "-" for x in row)))
    assert df.select(mappers.mapper("joined").source_text(cols)).first()[0] == "1|-|x"
    with pytest.raises(ValueError, match="no mapper"):
        mappers.mapper("nothing")
    with pytest.raises(TypeError, match="lacks"):
        mappers.register_mapper("bad", object)


def test_canonical_text(spark):
    df = spark.createDataFrame([("1", "23", None, True), ("12", "3", "", False)], "a string, b string, c string, d boolean")
    assert [r[0] for r in df.select(canonical.row_text(["a", "b", "c", "d"])).collect()] == ["123👻true", "123false"]
    assert [r[0] for r in df.select(canonical.row_text(["a", "b"], "|")).collect()] == ["1|23", "12|3"]
    assert df.select(canonical.row_text([])).first()[0] == ""
    assert spark.range(1).select(canonical.visible(F.lit("a\nb\rc"))).first()[0] == "a\\nb\\rc"


def test_families():
    r = families.Registry()
    assert [r.family("postgres", t) for t in ("INT4", " numeric(10,2) ", "timestamp(6) without time zone", "jsonb", "point", None)] == ["integer", "decimal", "datetime", "json", None, None]
    assert [r.family("clickhouse", t) for t in ("UInt64", "DateTime64(6, 'UTC')", "FixedString(3)")] == ["integer", "datetime", "string"]
    assert r.family("mysql", "int") is None
    with pytest.raises(ValueError, match="there already"):
        r.add("postgres", "INT", "integer")
    with pytest.raises(ValueError, match="no such family"):
        r.add("postgres", "new", "other")
    assert families.spark_type("decimal") == "decimal(38,18)" and families.spark_type(None) == "string"


def test_json_built_in_and_exact_give_the_same(spark):
    texts = ['{"b":1,"a":[1,2,{"d":null,"c":true}]}', '{"n":-12,"m":1234567890123456789}', '{"x":0.10}', '{"k":"a\\nb"}', '{"k":"\\u00e9"}', '{"a":1,"a":2}', " {} ", "[]", "", "12", "-0", '{"😀":1,"z":2}', '{"é":"/","e":"<&>"}', '{"a":"' + "x" * 2000 + '"}']
    assert values(spark, mappers.exact_json_text, texts) == [mappers.canonical_json(t) for t in texts]
