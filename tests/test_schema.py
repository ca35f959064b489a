from __future__ import annotations

import dataclasses
import typing

import pytest
from pyspark.sql import types as T

from tidemark.functions import schema as S

TEXT = """
UserId: string
Hair: [BROWN, BLACK, GREY]
Email: {address: string}
Phone: {number: string, extension: "uint?"}
Contact: [Email, Phone]
User:
  id: UserId
  age: uint
  height: float(precision=0.5)
  score: int(min=-5, max=100)
  hair: Hair?
  friends: User[]
  notes: "<string, int>[]?"
  nested: "<string, <string, int>>"
  contact: Contact?
"""


def test_parse():
    s = S.parse_schema(TEXT)
    user = dict(s.named["User"].fields)
    assert s.resolve(user["id"]) == S.String()
    assert user["age"] == S.Int(0, None)
    assert user["height"] == S.Float(0.5)
    assert user["score"] == S.Int(-5, 100)
    assert user["hair"] == S.Optional(S.Ref("Hair"))
    assert user["notes"] == S.Optional(S.Array(S.Map(S.String(), S.Int())))
    assert user["nested"] == S.Map(S.String(), S.Map(S.String(), S.Int()))
    assert isinstance(s.named["Hair"], S.Enum) and isinstance(s.named["Contact"], S.Union)
    assert s.is_scalar(S.Ref("Hair")) and not s.is_scalar(S.Ref("User"))


@pytest.mark.parametrize("text", ["a: {x: int}", "A: {x: nope}", "A: {x: Missing}", "A: {x: int(min=3, max=1)}", "A: {x: float(precision=0)}", "A: {x: int(step=2)}", "A: {_type: int}", "A: {x: '<float, int>'}", "A: {x: '<string>'}", "A: B\nB: A\nC: {x: A}\nD: [C, A]", "A: []", "A: [x, x]", "- a"])
def test_refused(text):
    with pytest.raises(S.SchemaError):
        S.parse_schema(text)


def test_names_stay_text():
    s = S.parse_schema("Switch: [on, off, 1]\nA: {on: boolean, no: Switch}")
    assert s.named["Switch"] == S.Enum(("on", "off", "1")) and [n for n, _ in s.named["A"].fields] == ["on", "no"]


def test_roots():
    s = S.parse_schema(TEXT)
    assert isinstance(s.root("Contact"), S.Union)
    for name in ("UserId", "Hair", "Nobody"):
        with pytest.raises(S.SchemaError):
            s.root(name)
    assert isinstance(s.root("Hair", enums=True), S.Enum)


def test_spark_type():
    s = S.parse_schema(TEXT)
    t = S.to_spark(s, S.Ref("User"), depth=2)
    assert t["age"].dataType == T.LongType() and not t["age"].nullable and t["age"].metadata == {"min": 0}
    assert t["hair"].nullable and t["hair"].metadata["options"] == ["BROWN", "BLACK", "GREY"]
    inner = t["friends"].dataType.elementType
    assert "friends" not in inner.names
    assert t["contact"].dataType.names == ["_type", "Email", "Phone"]
    assert S.too_deep(s, S.Ref("User"), {"friends": [{"friends": [{}]}]}, depth=2)
    assert not S.too_deep(s, S.Ref("User"), {"friends": [{"friends": []}]}, depth=2)


def test_defaults():
    s = S.parse_schema(TEXT)
    v = S.default(s, S.Ref("User"))
    assert v["id"] == "" and v["score"] == 0 and v["hair"] is None and v["friends"] == [] and v["nested"] == {}
    assert S.default(s, S.Ref("Contact")) == {"_type": "Email", "Email": {"address": ""}}
    assert S.default(s, S.Int(5, 9)) == 5 and S.default(s, S.Ref("Hair")) == "BROWN"


@pytest.mark.parametrize(("n", "bits"), [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (8, 3), (9, 4)])
def test_option_bits(n, bits):
    assert S.option_bits(n) == bits


@dataclasses.dataclass
class Cat:
    name: str


@dataclasses.dataclass
class Dog:
    name: str
    age: typing.Annotated[int, S.Range(0, 30)]


@dataclasses.dataclass
class Home:
    pet: Cat | Dog
    size: typing.Annotated[float, S.Precision(0.1)]
    mood: typing.Literal["calm", "wild"] | None
    rooms: list[int]
    bills: dict[str, float]
    cache: typing.Annotated[int, S.Ignored]


def test_from_dataclass():
    s = S.from_dataclass(Home)
    home = dict(s.named["Home"].fields)
    assert s.named["HomePet"] == S.Union(("Cat", "Dog")) and home["size"] == S.Float(0.1)
    assert home["mood"] == S.Optional(S.Ref("HomeMood")) and "cache" not in home
    assert dict(s.named["Dog"].fields)["age"] == S.Int(0, 30)
