from __future__ import annotations

import dataclasses
import typing

import pytest
from pyspark.sql import functions as F

from tidemark.functions import schema as S
from tidemark.functions.binding import TypedCodec
from tidemark.operators import mutators as M
from tidemark.operators.snapshots import SnapshotStore


@dataclasses.dataclass
class Walk:
    steps: int


@dataclasses.dataclass
class Say:
    text: str


@dataclasses.dataclass
class Hero:
    name: str
    health: typing.Annotated[int, S.Range(0, 100)]
    speed: typing.Annotated[float, S.Precision(0.1)]
    action: Walk | Say | None
    bag: dict[str, int]
    friends: list[Hero]
    cache: typing.Annotated[int, S.Ignored] = 5


def test_typed_codec():
    c = TypedCodec(Hero)
    a = Hero("x", 10, 1.5, Walk(3), {"coin": 2}, [Hero("y", 1, 0.0, None, {}, [])], cache=9)
    b = dataclasses.replace(a, health=11, action=Say("hi"), friends=[])
    assert c.equals(c.decode(c.encode(a)), a) and c.decode(c.encode(a)).cache == 5
    assert c.equals(c.decode_diff(a, c.encode_diff(a, b)), b)
    copy = c.clone(a)
    copy.friends[0].name = "z"
    assert a.friends[0].name == "y" and not c.equals(a, copy)
    made = TypedCodec(Hero, make=lambda cls: cls.__new__(cls)).decode(c.encode(a))
    assert made.name == "x" and not hasattr(made, "cache") or made.cache == 5


@pytest.mark.parametrize("v", [[], [1], [1, 2, 3, 4, 5, 6], [3, 3, 1, None]])
def test_mutators(spark, v):
    a = F.col("a")
    df = spark.createDataFrame([(v,)], "a array<int>")

    def do(column):
        return df.select(column.alias("r")).first().r

    def spliced(at, n, *new):
        at = min(max(at, 0), len(v))
        return v[:at] + list(new) + v[at + max(0, min(n, len(v) - at)) :]

    assert do(M.push(a, F.lit(8), F.lit(9))) == [*v, 8, 9] and do(M.unshift(a, F.lit(8))) == [8, *v]
    assert do(M.pop(a)) == v[:-1] and do(M.shift(a)) == v[1:] and do(M.reverse(a)) == v[::-1]
    for at, n in ((0, 0), (1, 2), (3, 9), (9, 1), (-2, 1)):
        assert do(M.splice(a, F.lit(at), F.lit(n), F.lit(7))) == spliced(at, n, 7) and do(M.splice(a, F.lit(at), F.lit(n))) == spliced(at, n)
    assert do(M.set_length(a, F.lit(2))) == v[:2] and do(M.set_length(a, F.lit(0))) == []
    assert do(M.put(a, F.lit(0), F.lit(5))) == ([5, *v[1:]] if v else [])
    assert do(M.fill(a, F.lit(0), F.lit(1), F.lit(3))) == [0 if 1 <= i < 3 else x for i, x in enumerate(v)]
    copied = v[:]
    copied[1 : 1 + len(v[2:4])] = v[2:4]
    assert do(M.copy_within(a, F.lit(1), F.lit(2), F.lit(4))) == copied[: len(v)]
    assert do(M.touched(a, M.push(a, F.lit(1)))) == [len(v)]


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.versions() == [] and store.oldest() is None and store.as_of(3) is None
    assert store.save(spark.range(3)) == 1 and store.save(spark.range(5), 4) == 4
    with pytest.raises(ValueError, match="isn't above"):
        store.save(spark.range(1), 4)
    assert store.load(1).count() == 3 and store.as_of(3).count() == 3 and store.as_of(9).first().version == 4
    store.release(1)
    assert store.versions() == [4] and store.oldest() == 4
    with pytest.raises(KeyError):
        store.load(1)
