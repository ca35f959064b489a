"""States as instances of annotated dataclasses."""

from __future__ import annotations

import dataclasses
import types
import typing
from collections.abc import Callable

from tidemark.functions.schema import Ignored, Ref, from_dataclass
from tidemark.functions.wire import EPSILON, Codec


def _plain(hint):
    """A hint without its annotations; None for an ignored field."""
    if typing.get_origin(hint) is typing.Annotated:
        args = typing.get_args(hint)
        return None if any(x is Ignored or isinstance(x, Ignored) for x in args[1:]) else args[0]
    return hint


def _members(hint) -> list:
    return [a for a in typing.get_args(hint) if a is not type(None)] if typing.get_origin(hint) in (typing.Union, types.UnionType) else [hint]


def to_state(value, hint):
    """An instance as a state."""
    hint = _plain(hint)
    if value is None:
        return None
    members = _members(hint)
    if len(members) > 1:
        return {"_type": type(value).__name__, type(value).__name__: to_state(value, type(value))}
    hint = members[0]
    if dataclasses.is_dataclass(hint):
        hints = typing.get_type_hints(hint, include_extras=True)
        return {f.name: to_state(getattr(value, f.name), hints[f.name]) for f in dataclasses.fields(hint) if _plain(hints[f.name]) is not None}
    args = typing.get_args(hint)
    if typing.get_origin(hint) is list:
        return [to_state(v, args[0]) for v in value]
    if typing.get_origin(hint) is dict:
        return {k: to_state(v, args[1]) for k, v in value.items()}
    return value


def to_instance(state, hint, make: Callable[[type], object] | None = None):
    """A state as an instance; `make` builds the empty instances, for classes whose constructor needs more than the fields."""
    hint = _plain(hint)
    if state is None:
        return None
    members = _members(hint)
    if len(members) > 1:
        cls = next(m for m in members if m.__name__ == state["_type"])
        return to_instance(state[state["_type"]], cls, make)
    hint = members[0]
    if dataclasses.is_dataclass(hint):
        hints = typing.get_type_hints(hint, include_extras=True)
        values = {f.name: to_instance(state[f.name], hints[f.name], make) for f in dataclasses.fields(hint) if f.name in state}
        if make is None:
            return hint(**values)
        out = make(hint)
        for name, v in values.items():
            setattr(out, name, v)
        return out
    args = typing.get_args(hint)
    if typing.get_origin(hint) is list:
        return [to_instance(v, args[0], make) for v in state]
    if typing.get_origin(hint) is dict:
        return {k: to_instance(v, args[1], make) for k, v in state.items()}
    return state


class TypedCodec:
    """The binary codec over instances of a dataclass; a union of dataclasses may be the root too."""

    def __init__(self, cls: type, make: Callable[[type], object] | None = None, epsilon: float = EPSILON):
        self.cls, self.make = cls, make
        self.schema = from_dataclass(cls)
        self.codec = Codec(self.schema, cls.__name__, epsilon)
        self.root = Ref(cls.__name__)

    def encode(self, value) -> bytes:
        return self.codec.encode(to_state(value, self.cls))

    def decode(self, data: bytes):
        return to_instance(self.codec.decode(data), self.cls, self.make)

    def encode_diff(self, old, new) -> bytes:
        return self.codec.encode_diff(to_state(old, self.cls), to_state(new, self.cls))

    def decode_diff(self, old, data: bytes):
        return to_instance(self.codec.decode_diff(to_state(old, self.cls), data), self.cls, self.make)

    def equals(self, a, b) -> bool:
        return self.codec.equals(to_state(a, self.cls), to_state(b, self.cls))

    def clone(self, value):
        return to_instance(to_state(value, self.cls), self.cls, self.make)
