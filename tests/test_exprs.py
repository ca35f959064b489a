import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.functions.schema import Array, Float, Int, Map, Object, Optional, Ref, Schema, String, default, parse_schema


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_numbers(spark):
    vs = [0, 1, -1, 63, -64, 64, 127, 128, 16383, 16384, -(2**31), 2**40]
    df = spark.createDataFrame([(v,) for v in vs], "v long").select("v", X.zigzag(F.col("v")).alias("z"), X.signed_size(F.col("v")).alias("n"), X.varint_size(F.abs("v")).alias("u"))
    from tidemark.functions import wire

    for r in df.collect():
        assert r.z == wire.zigzag(r.v) and r.n == len(wire.uvarint(r.z)) and r.u == len(wire.uvarint(abs(r.v)))
    q = spark.createDataFrame([(0.05,), (-0.05,), (0.15,), (123.456,)], "v double").select(X.quantum(F.col("v"), 0.1).alias("q"))
    assert [r.q for r in q.collect()] == [1, 0, 1, 1235]


def test_close(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 1.0009), (1.0, 1.0011), (nan, nan), (None, None), (None, 1.0)], "a double, b double")
    assert [r.e for r in df.select(X.both_or(F.col("a"), F.col("b"), X.close(F.col("a"), F.col("b"))).alias("e")).collect()] == [True, False, False, True, False]


def test_equals(spark):
    s = parse_schema("In: {x: float, tags: 'string?[]'}\nUp: {v: int}\nAny: [In, Up]\nOut: {m: '<string, int?>', i: In, u: 'Any?', l: 'float(precision=0.5)[]'}")
    from tidemark.functions.schema import to_spark

    kind = to_spark(s, Ref("Out"))
    base = {"m": {"a": 1, "b": None}, "i": {"x": 1.0, "tags": ["p", None]}, "u": {"_type": "Up", "In": None, "Up": {"v": 3}}, "l": [0.5, 1.0]}

    def changed(**k):
        return base | k

    others = [
        (base, True), (changed(m={"b": None, "a": 1}), True), (changed(m={"a": 1, "c": None}), False), (changed(m={"a": 1}), False), (changed(m={"a": None, "b": None}), False),
        (changed(i={"x": 1.0005, "tags": ["p", None]}), True), (changed(i={"x": 1.0, "tags": ["p", "q"]}), False), (changed(u=None), False), (changed(u={"_type": "Up", "In": None, "Up": {"v": 4}}), False),
        (changed(u={"_type": "In", "In": {"x": 0.0, "tags": []}, "Up": None}), False), (changed(l=[0.6, 1.1]), True), (changed(l=[0.5]), False),
    ]
    df = spark.createDataFrame([(i, base, o) for i, (o, _) in enumerate(others)], f"i int, a {kind.simpleString()}, b {kind.simpleString()}")
    got = {r.i: r.e for r in df.select("i", X.equals(s, Ref("Out"), F.col("a"), F.col("b")).alias("e")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(others)}


@pytest.mark.parametrize(("text", "want"), [("7", 7), ("", 0), ("4.0", 4), ("4.5", None), ("x", None), ("-3", -3), (None, None), ("9007199254740993", 9007199254740993)])
def test_parse_int(spark, text, want):
    assert one(spark, X.parse_int(F.lit(text).cast("string"), strict=False).alias("v")).v == want


def test_bounds_raise(spark):
    with pytest.raises(PySparkException, match="below minimum 5"):
        one(spark, X.parse_int(F.lit("4"), 5, 9))
    with pytest.raises(PySparkException, match="above maximum 9"):
        one(spark, X.parse_int(F.lit("10"), 5, 9))


def test_parse_others(spark):
    r = one(spark, *[X.parse_boolean(F.lit(v), strict=False).alias(f"b{i}") for i, v in enumerate(["TRUE", "1", "false", "0", "2"])])
    assert list(r) == [True, True, False, False, None]
    r = one(spark, *[X.parse_enum(F.lit(v), ["RED", "blue"], strict=False).alias(f"e{i}") for i, v in enumerate(["RED", "red", "BLUE", "1", "2", "x"])])
    assert list(r) == ["RED", "RED", "blue", "blue", None, None]
    r = one(spark, *[X.parse_float(F.lit(v), strict=False).alias(f"f{i}") for i, v in enumerate(["1.5", "NaN", "Infinity", "x"])], X.parse_float(F.lit("1.26"), precision=0.5).alias("q"))
    assert list(r) == [1.5, None, None, None, 1.5]


def test_literal_matches_default(spark):
    s = parse_schema("E: [A, B]\nP: {n: int}\nQ: {m: string}\nU: [P, Q]\nR: {e: E, i: int(min=3), f: float, b: boolean, l: 'int[]', o: 'int?', u: U, p: P}")
    row = one(spark, X.literal(s, Ref("R")).alias("r")).r.asDict(recursive=True)
    want = default(s, Ref("R"))
    assert row == want | {"u": want["u"] | {"Q": None}}


def test_run_cost(spark):
    r = one(spark, *[X.run_cost(F.lit(n)).alias(f"c{n}") for n in (1, 3, 5, 13, 269, 270)])
    assert list(r) == [1, 3, 4, 7, 12, None]


def test_validate_names_the_path(spark):
    t = Object((("a", Int()), ("b", Array(Optional(Float()))), ("c", Map(String(), Int(0, 5)))))
    df = spark.sql("select named_struct('a', '1', 'b', array('1.5', '', null), 'c', map('k', '3')) as v")
    r = df.select(X.validate(Schema({}), t, F.col("v")).alias("v")).first().v
    assert r.a == 1 and r.b == [1.5, None, None] and r.c == {"k": 3}
    bad = spark.sql("select named_struct('a', '1', 'b', array('1.5'), 'c', map('k', '9')) as v")
    with pytest.raises(PySparkException, match=r"\$\.c\{\}: above maximum 5"):
        bad.select(X.validate(Schema({}), t, F.col("v")).alias("v")).collect()
    assert math.isclose(r.b[0], 1.5)
