import math
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.functions.flat import FlatCodec
from tidemark.functions.schema import Array, Boolean, Enum, Float, Int, Map, Object, Optional, Ref, Schema, String, to_spark
from tidemark.functions.wire import Codec
from tidemark.sources.codec import loosened

VALUES = {
    String(): st.text(max_size=70), Int(): st.integers(-(2**60), 2**60) | st.integers(-200, 200), Int(5): st.integers(5, 2**60) | st.integers(5, 300), Float(): st.floats(width=32, allow_nan=False, allow_infinity=False), Float(0.01): st.floats(-1e9, 1e9),
    Boolean(): st.booleans(), Enum(("a",)): st.just("a"), Enum(("a", "b", "c")): st.sampled_from("abc"), Enum(tuple("abcdefghi")): st.sampled_from("abcdefghi"),
}


def kinds(draw_string=True):
    return [t for t in VALUES if draw_string or t != String()]


@st.composite
def flat_states(draw):
    """A flat schema and pairs of states; the second often repeats values of the first."""
    types = draw(st.lists(st.tuples(st.sampled_from(kinds(False)), st.booleans()), min_size=0, max_size=5))
    if draw(st.booleans()) or not types:
        types.insert(draw(st.integers(0, len(types))), (String(), draw(st.booleans())))
    fields = tuple((f"f{i}", Optional(t) if o else t) for i, (t, o) in enumerate(types))
    one = st.fixed_dictionaries({f"f{i}": st.none() | VALUES[t] if o else VALUES[t] for i, (t, o) in enumerate(types)})
    rows = []
    for _ in range(draw(st.integers(1, 8))):
        a, b = draw(one), draw(one)
        for k in a:
            if draw(st.booleans()):
                b[k] = a[k]
        rows.append((a, b))
    return Schema({"T": Object(fields)}), rows


@given(flat_states(), st.integers(0, 2))
@settings(max_examples=400, deadline=None)
def test_bytes_and_values_are_those_of_the_plain_codec(made, hole):
    schema, rows = made
    plain, flat = Codec(schema, "T"), FlatCodec.of(schema, "T")
    kind = to_arrow_type(loosened(to_spark(schema, Ref("T"), 3)))
    states = [a for a, _ in rows] + [None] * hole
    news = [b for _, b in rows] + [None] * hole
    a, b = pa.array(states, kind), pa.array(news, kind)
    a_py, b_py = a.to_pylist(), b.to_pylist()

    def each(fn, *columns):
        return [None if any(v is None for v in x) else fn(*x) for x in zip(*columns, strict=True)]

    assert flat.encode(a).to_pylist() == each(plain.encode, a_py)
    data = flat.encode_diff(a, b)
    assert data.to_pylist() == each(plain.encode_diff, a_py, b_py)
    want = pa.array(each(plain.decode, each(plain.encode, a_py)), kind).to_pylist()
    assert flat.decode(flat.encode(a), kind).to_pylist() == want
    want = pa.array(each(plain.decode_diff, a_py, data.to_pylist()), kind).to_pylist()
    assert flat.decode_diff(a, data, kind).to_pylist() == want
    if len(rows) > 1:  # slices of a batch
        assert flat.encode(a[1:]).to_pylist() == each(plain.encode, a_py[1:])
        assert flat.decode_diff(a[1:], data[1:], kind).to_pylist() == want[1:]


SCHEMA = Schema({"T": Object((("n", Int(0)), ("s", String()), ("f", Float(0.1)), ("g", Float()), ("e", Enum(("x", "y", "z"))), ("b", Boolean())))})
GOOD = {"n": 1, "s": "a", "f": 0.5, "g": 1.5, "e": "x", "b": True}


@pytest.mark.parametrize("change", [{"n": -1}, {"n": 2**62}, {"f": math.inf}, {"f": 1e30}, {"e": "w"}, {"s": None}, {"b": None}, {"g": 1e300}])
def test_what_is_left_to_the_plain_codec(change):
    kind = pa.struct([("n", pa.int64()), ("s", pa.string()), ("f", pa.float64()), ("g", pa.float64()), ("e", pa.string()), ("b", pa.bool_())])
    flat = FlatCodec.of(SCHEMA, "T")
    assert flat.encode(pa.array([GOOD, GOOD | change], kind)) is None and flat.encode(pa.array([GOOD], kind)) is not None


def test_damaged_bytes_are_left_to_the_plain_codec():
    kind = pa.struct([("n", pa.int64()), ("s", pa.string()), ("f", pa.float64()), ("g", pa.float64()), ("e", pa.string()), ("b", pa.bool_())])
    flat, plain = FlatCodec.of(SCHEMA, "T"), Codec(SCHEMA, "T")
    good = plain.encode(GOOD)
    rng = np.random.default_rng(3)
    for _ in range(500):
        bad = bytearray(good)
        bad[rng.integers(len(bad))] = rng.integers(256)
        bad = bytes(bad[: rng.integers(len(bad) + 1)]) if rng.random() < 0.3 else bytes(bad)
        got = flat.decode(pa.array([good, bad], pa.binary()), kind)
        if got is not None:
            assert repr(got.to_pylist()[1]) == repr(pa.array([plain.decode(bad)], kind).to_pylist()[0])


@pytest.mark.parametrize("t", [Array(Int()), Map(String(), Int()), Object((("x", Int()),)), Optional(Array(Int()))])
def test_other_schemas_are_not_flat(t):
    assert FlatCodec.of(Schema({"T": Object((("a", t),))}), "T") is None
    assert FlatCodec.of(Schema({"T": Object((("a", String()), ("b", String())))}), "T") is None


def test_rate():
    """A million five-field states a second on a few cores needs some hundred thousand on one."""
    kind = pa.struct([("n", pa.int64()), ("s", pa.string()), ("f", pa.float64()), ("g", pa.float32()), ("e", pa.string()), ("b", pa.bool_())])
    n = 10_000
    a = pa.array([{"n": i * 7, "s": f"name {i % 50}", "f": i / 3, "g": float(i), "e": "xyz"[i % 3], "b": i % 2 == 0} for i in range(n)], kind)
    flat = FlatCodec.of(SCHEMA, "T")
    flat.encode(a)
    began = time.perf_counter()
    for _ in range(5):
        flat.decode(flat.encode(a), kind)
    print(5 * n / (time.perf_counter() - began), "round trips a second")
    assert 5 * n / (time.perf_counter() - began) > 100_000
