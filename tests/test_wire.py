import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import wire
from tidemark.functions.schema import Ref, parse_schema

PRIMITIVES = parse_schema("Primitives: {stringField: string, signedIntField: int, unsignedIntField: uint, floatField: float, booleanField: boolean}")
WORLD = parse_schema(
    """
Color: [RED, BLUE, GREEN]
Move: {x: int, y: int}
Say: {text: string, loud: "boolean?"}
Action: [Move, Say]
Player: {name: string, score: int, active: boolean, color: "Color?", partner: "Player?"}
World:
  players: <string, Player>
  flags: boolean[]
  grid: int[][]
  round: int(min=10)
  heat: float(precision=0.1)
  speed: float
  last: Action
  maybe: Action?
  names: string[]
  wishes: "<int, int>?"
"""
)


def world(r: random.Random) -> dict:
    def player(depth=0):
        return {"name": r.choice(["", "a", "b", "zoë", "😀"]), "score": r.randint(-(2**40), 2**40), "active": r.random() < 0.5, "color": r.choice([None, "RED", "BLUE"]), "partner": player(depth + 1) if depth < 2 and r.random() < 0.3 else None}

    def action():
        return {"_type": "Move", "Move": {"x": r.randint(-9, 9), "y": 0}} if r.random() < 0.5 else {"_type": "Say", "Say": {"text": r.choice(["hi", "ho"]), "loud": r.choice([None, True, False])}}

    return {
        "players": {k: player() for k in r.sample("abcdef", r.randint(0, 4))}, "flags": [r.random() < 0.5 for _ in range(r.randint(0, 9))], "grid": [[r.randint(0, 3) for _ in range(r.randint(0, 3))] for _ in range(r.randint(0, 3))],
        "round": r.randint(10, 10**6), "heat": r.randint(-50, 50) / 10, "speed": r.choice([0.0, 0.5, -2.25]), "last": action(), "maybe": r.choice([None, action()]), "names": [r.choice("xyz") for _ in range(r.randint(0, 5))], "wishes": r.choice([None, {}, {1: 2}, {1: 3, 5: 6}]),
    }


def test_published_sizes():
    c = wire.Codec(PRIMITIVES, "Primitives")
    names = ("stringField", "signedIntField", "unsignedIntField", "floatField", "booleanField")
    a = dict(zip(names, ("example string", -42, 42, 3.14, True), strict=True))
    b = dict(zip(names, ("updated string", -43, 43, 3.15, False), strict=True))
    assert len(c.encode(a)) == 23 and len(c.encode_diff(a, b)) == 23
    assert c.equals(c.decode_diff(a, c.encode_diff(a, b)), b)


@given(st.integers(0, 10**9))
@settings(max_examples=150, deadline=None)
def test_round_trips(seed):
    r = random.Random(seed)
    c = wire.Codec(WORLD, "World")
    a, b = world(r), world(r)
    assert c.equals(c.decode(c.encode(a)), a)
    assert c.equals(c.decode_diff(a, c.encode_diff(a, b)), b)
    assert len(c.encode_diff(a, a)) == 2
    assert c.encode(a) == c.encode({k: dict(reversed(v.items())) if isinstance(v, dict) and k == "players" else v for k, v in a.items()})


@given(st.lists(st.booleans(), max_size=600))
def test_bits(bits):
    bits = [int(b) for b in bits]
    runs, n = [], 0
    for i, b in enumerate(bits):
        n = n + 1 if i and b == bits[i - 1] else 1
        runs.append(n)
    if max(runs, default=0) > wire.LONGEST_RUN:
        with pytest.raises(wire.WireError):
            wire.pack_bits(bits)
    else:
        assert wire.unpack_bits(wire.pack_bits(bits)) == (tuple(bits), 0)


def test_run_limits():
    assert wire.pack_bits([]) == b"\0"
    assert [len(wire.run_code(n)) for n in (1, 2, 3, 4, 5, 6, 13, 14, 269)] == [1, 3, 3, 4, 4, 7, 7, 12, 12]
    with pytest.raises(wire.WireError):
        wire.run_code(270)


@pytest.mark.parametrize(("v", "p", "q"), [(0.05, 0.1, 1), (0.04, 0.1, 0), (0.15, 0.1, 1), (-0.05, 0.1, 0), (-0.04, 0.1, 0), (0.051, 0.1, 1), (0.049, 0.1, 0)])
def test_quantum(v, p, q):
    assert wire.quantum(v, p) == q


@pytest.mark.parametrize(("v", "z"), [(0, 0), (-1, 1), (1, 2), (-2, 3), (2**31 - 1, 2**32 - 2), (-(2**31), 2**32 - 1)])
def test_zigzag(v, z):
    assert wire.zigzag(v) == z


def test_strings_are_sent_once():
    s = parse_schema("A: {names: 'string[]'}")
    c = wire.Codec(s, "A")
    assert c.encode({"names": ["abc", "abc", "", "x", "abc"]})[:9] == bytes([5, 6]) + b"abc" + bytes([1, 0, 2]) + b"x"


def test_sparse_array():
    s = parse_schema("A: {v: 'int[]'}")
    c = wire.Codec(s, "A")
    a = {"v": list(range(1000))}
    b = {"v": [x + 5 if x in (3, 900) else x for x in range(1000)]}
    assert len(c.encode_diff(a, b)) < 30 and len(c.encode_diff(a, a)) < 3


def test_epsilon_keeps_the_old_value():
    s = parse_schema("A: {x: float, y: int}")
    c = wire.Codec(s, "A")
    a = {"x": 1.0, "y": 1}
    assert c.decode_diff(a, c.encode_diff(a, {"x": 1.0005, "y": 2})) == {"x": 1.0, "y": 2}


def test_union_root():
    c = wire.Codec(WORLD, "Action")
    a, b = {"_type": "Move", "Move": {"x": 1, "y": 2}}, {"_type": "Say", "Say": {"text": "hi", "loud": None}}
    for x in (a, b):
        for y in (a, b):
            assert c.decode_diff(x, c.encode_diff(x, y)) == y


@given(st.binary(max_size=40))
def test_bad_bytes_raise(data):
    c = wire.Codec(WORLD, "World")
    try:
        c.decode(data)
    except (wire.WireError, UnicodeDecodeError):
        pass


def test_cut_short():
    c = wire.Codec(WORLD, "World")
    data = c.encode(world(random.Random(5)))
    for n in range(len(data) - 1):
        try:
            c.decode(data[:n])
        except (wire.WireError, UnicodeDecodeError):
            pass
    assert Ref("World") == c.type


def test_many_strings_decode_in_linear_time():
    import time

    from tidemark.functions.schema import parse_schema
    from tidemark.functions.wire import Codec

    codec = Codec(parse_schema("Names:\n  held: string[]"), "Names")
    old, new = {"held": [f"a{i}" for i in range(20_000)]}, {"held": [f"b{i // 2}" for i in range(20_000)]}
    data = codec.encode_diff(old, new)
    began = time.perf_counter()
    assert codec.decode_diff(old, data) == new and codec.decode(codec.encode(new)) == new
    assert time.perf_counter() - began < 3
