"""Schema language for versioned state: types, the YAML form, and their Spark equivalents.

A schema is a set of named types.  In YAML a mapping is an object, a list whose entries are all declared types is a
union, any other list an enum, and a string an alias.  Type strings are string, int, uint, float, boolean or a name, with
bounds such as int(min=0, max=9) or float(precision=0.1), followed by [] (array) or ? (optional), or <K, V> (map).
"""

from __future__ import annotations

import dataclasses
import math
import re
import types
import typing
from collections.abc import Iterator

import yaml
from pyspark.sql import types as T


class SchemaError(ValueError):
    """A schema that breaks a rule."""


@dataclasses.dataclass(frozen=True)
class Type:
    """Base of all types."""


@dataclasses.dataclass(frozen=True)
class String(Type):
    pass


@dataclasses.dataclass(frozen=True)
class Boolean(Type):
    pass


@dataclasses.dataclass(frozen=True)
class Int(Type):
    low: int | None = None
    high: int | None = None

    def __post_init__(self):
        if self.low is not None and self.high is not None and self.low > self.high:
            raise SchemaError(f"int: min {self.low} is above max {self.high}")


def UInt(high: int | None = None) -> Int:  # noqa: N802
    return Int(0, high)


@dataclasses.dataclass(frozen=True)
class Float(Type):
    precision: float | None = None

    def __post_init__(self):
        if self.precision is not None and self.precision <= 0:
            raise SchemaError("float: precision must be positive")


@dataclasses.dataclass(frozen=True)
class Array(Type):
    item: Type


@dataclasses.dataclass(frozen=True)
class Optional(Type):
    inner: Type


@dataclasses.dataclass(frozen=True)
class Map(Type):
    key: Type
    value: Type

    def __post_init__(self):
        if not isinstance(self.key, String | Int):
            raise SchemaError("map keys are strings or integers")


@dataclasses.dataclass(frozen=True)
class Ref(Type):
    """A named type, itself included; resolved by the schema, so recursion needs no special type."""

    name: str


@dataclasses.dataclass(frozen=True)
class Enum(Type):
    options: tuple[str, ...]


@dataclasses.dataclass(frozen=True)
class Object(Type):
    fields: tuple[tuple[str, Type], ...]


@dataclasses.dataclass(frozen=True)
class Union(Type):
    options: tuple[str, ...]


TYPE_NAME, FIELD_NAME = re.compile(r"[A-Z][A-Za-z0-9_]*"), re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")


def option_bits(n: int) -> int:
    """Bits that an ordinal of n options takes."""
    return 1 if n <= 1 else math.ceil(math.log2(n))


class Schema:
    """Named types, checked: names well formed, references resolved, union options objects."""

    def __init__(self, named: dict[str, Type]):
        self.named = dict(named)
        for name, t in self.named.items():
            if not TYPE_NAME.fullmatch(name):
                raise SchemaError(f"bad type name {name!r}")
            if isinstance(t, Enum | Union) and (not t.options or len(set(t.options)) != len(t.options)):
                raise SchemaError(f"{name}: options must be there, and distinct")
            if isinstance(t, Object):
                for field, _ in t.fields:
                    if not FIELD_NAME.fullmatch(field) or field == "_type":
                        raise SchemaError(f"{name}: bad field name {field!r}")
            for ref in references(t):
                if ref not in self.named:
                    raise SchemaError(f"{name}: unknown type {ref}")
            if isinstance(t, Union) and not all(isinstance(self.resolve(Ref(o)), Object) for o in t.options):
                raise SchemaError(f"{name}: union options must be objects")

    def resolve(self, t: Type) -> Type:
        seen = set()
        while isinstance(t, Ref):
            if t.name in seen:
                raise SchemaError(f"alias {t.name} refers to itself")
            seen.add(t.name)
            t = self.named[t.name]
        return t

    def root(self, name: str, enums: bool = False) -> Type:
        """A type that may be the root of a state: an object or union, or an enum where asked for."""
        if name not in self.named:
            raise SchemaError(f"unknown type {name}")
        t = self.resolve(Ref(name))
        if not isinstance(t, (Object, Union, Enum) if enums else (Object, Union)):
            raise SchemaError(f"{name} can't be a root")
        return t

    def is_scalar(self, t: Type) -> bool:
        return isinstance(self.resolve(t), String | Int | Float | Boolean | Enum)


def references(t: Type) -> Iterator[str]:
    match t:
        case Ref(name):
            yield name
        case Array(x) | Optional(x):
            yield from references(x)
        case Map(k, v):
            yield from references(k)
            yield from references(v)
        case Object(fields):
            for _, x in fields:
                yield from references(x)
        case Union(options):
            yield from options


_PARAMS = re.compile(r"(string|int|uint|float|boolean)\s*(?:\((.*)\))?")


def parse_type(text: str) -> Type:
    """A type string; the suffix that stands last binds last."""
    text = text.strip()
    if text.endswith("[]"):
        return Array(parse_type(text[:-2]))
    if text.endswith("?"):
        return Optional(parse_type(text[:-1]))
    if text.startswith("<") and text.endswith(">"):
        key, comma, value = text[1:-1].partition(",")
        if not comma:
            raise SchemaError(f"map without a value type: {text}")
        return Map(parse_type(key), parse_type(value))
    found = _PARAMS.fullmatch(text)
    if not found:
        if not TYPE_NAME.fullmatch(text):
            raise SchemaError(f"can't read type {text!r}")
        return Ref(text)
    kind, given = found.groups()
    params = {}
    for part in (given or "").split(","):
        if part.strip():
            name, equals, value = part.partition("=")
            try:
                params[name.strip()] = float(value) if kind == "float" else int(value)
            except ValueError:
                raise SchemaError(f"{text}: {part.strip()} is no number") from None
    allowed = {"int": {"min", "max"}, "uint": {"max"}, "float": {"precision"}}.get(kind, set())
    if set(params) - allowed:
        raise SchemaError(f"{text}: unknown parameter")
    match kind:
        case "string":
            return String()
        case "boolean":
            return Boolean()
        case "int":
            return Int(params.get("min"), params.get("max"))
        case "uint":
            return UInt(params.get("max"))
        case _:
            return Float(params.get("precision"))


def parse_schema(text: str) -> Schema:
    """A schema from YAML."""
    raw = yaml.load(text, Loader=yaml.BaseLoader) or {}  # plain text throughout: `on` is a name, not a boolean
    if not isinstance(raw, dict):
        raise SchemaError("a schema is a mapping of type names")
    named: dict[str, Type] = {}
    for name, value in raw.items():
        if isinstance(value, list):
            options = tuple(str(v) for v in value)
            named[name] = Union(options) if options and all(o in raw for o in options) else Enum(options)
        elif isinstance(value, dict):
            named[name] = Object(tuple((str(k), parse_type(str(v))) for k, v in value.items()))
        else:
            named[name] = parse_type(str(value))
    return Schema(named)


def _field(name: str, kind: T.DataType, t: Type, nullable: bool) -> T.StructField:
    meta = {}
    match t:
        case Int(low, high):
            meta = {k: v for k, v in (("min", low), ("max", high)) if v is not None}
        case Float(precision) if precision:
            meta = {"precision": precision}
        case Enum(options):
            meta = {"options": list(options)}
    return T.StructField(name, kind, nullable, meta)


def to_spark(schema: Schema, t: Type, depth: int = 3, _within: tuple[str, ...] = ()) -> T.DataType:
    """The Spark type.  A named type may stand within itself `depth` times; below, the place is left out (see too_deep)."""
    if isinstance(t, Ref):
        return to_spark(schema, schema.named[t.name], depth, (*_within, t.name))
    match t:
        case String() | Enum():
            return T.StringType()
        case Int():
            return T.LongType()
        case Float(precision):
            return T.DoubleType() if precision else T.FloatType()
        case Boolean():
            return T.BooleanType()
        case Optional(inner):
            return to_spark(schema, inner, depth, _within)
        case Array(item):
            return T.ArrayType(to_spark(schema, item, depth, _within), isinstance(schema.resolve(item), Optional))
        case Map(key, value):
            return T.MapType(to_spark(schema, key), to_spark(schema, value, depth, _within), isinstance(schema.resolve(value), Optional))
        case Object(fields):
            out = []
            for name, x in fields:
                if not any(_within.count(r) >= depth for r in references(x)):
                    flat = schema.resolve(x)
                    inner = schema.resolve(flat.inner) if isinstance(flat, Optional) else flat
                    out.append(_field(name, to_spark(schema, x, depth, _within), inner, isinstance(flat, Optional)))
            return T.StructType(out)
        case Union(options):
            return T.StructType([T.StructField("_type", T.StringType(), False), *[T.StructField(o, to_spark(schema, Ref(o), depth, _within), True) for o in options]])
    raise SchemaError(f"no Spark type for {t}")


def too_deep(schema: Schema, t: Type, value, depth: int = 3, _within: tuple[str, ...] = ()) -> bool:
    """Whether a value nests a named type deeper than to_spark() has columns for, so that it can be refused, not cut."""
    if value is None:
        return False
    if isinstance(t, Ref):
        return too_deep(schema, schema.named[t.name], value, depth, (*_within, t.name))
    match t:
        case Optional(x):
            return too_deep(schema, x, value, depth, _within)
        case Array(x):
            return any(too_deep(schema, x, v, depth, _within) for v in value)
        case Map(_, x):
            return any(too_deep(schema, x, v, depth, _within) for v in value.values())
        case Object(fields):
            for name, x in fields:
                if any(_within.count(r) >= depth for r in references(x)):
                    if value.get(name):
                        return True
                elif too_deep(schema, x, value.get(name), depth, _within):
                    return True
            return False
        case Union():
            return too_deep(schema, Ref(value["_type"]), value[value["_type"]], depth, _within)
    return False


def to_ddl(schema: Schema, name: str, depth: int = 3) -> str:
    """Column definitions of an object type, for CREATE TABLE."""
    fields = to_spark(schema, Ref(name), depth).fields
    return ", ".join(f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in fields)


def default(schema: Schema, t: Type):
    """The value that a type starts from."""
    t = schema.resolve(t)
    match t:
        case String():
            return ""
        case Int(low, high):
            return low if low is not None and low > 0 else high if high is not None and high < 0 else 0
        case Float():
            return 0.0
        case Boolean():
            return False
        case Array():
            return []
        case Map():
            return {}
        case Enum(options):
            return options[0]
        case Object(fields):
            return {name: default(schema, x) for name, x in fields}
        case Union(options):
            return {"_type": options[0], options[0]: default(schema, Ref(options[0]))}
    return None


# ---- schemas from annotated classes


@dataclasses.dataclass(frozen=True)
class Range:
    """Annotation of an integer's bounds."""

    low: int | None = None
    high: int | None = None


@dataclasses.dataclass(frozen=True)
class Precision:
    """Annotation of a float's quantum."""

    step: float


class Ignored:
    """Annotation of a field that is no part of the state."""


def from_dataclass(*roots: type) -> Schema:
    """A schema from dataclasses: str, int, float, bool, list, dict, X | None, Literal (enum) and unions of dataclasses."""
    named: dict[str, Type] = {}

    def visit(cls: type) -> Ref:
        if cls.__name__ not in named:
            named[cls.__name__] = Object(())
            hints = typing.get_type_hints(cls, include_extras=True)
            fields = [(f.name, of(hints[f.name], f"{cls.__name__}{f.name[0].upper()}{f.name[1:]}")) for f in dataclasses.fields(cls)]
            named[cls.__name__] = Object(tuple((n, t) for n, t in fields if t is not None))
        return Ref(cls.__name__)

    def of(hint, name: str) -> Type | None:
        origin, args = typing.get_origin(hint), typing.get_args(hint)
        if origin is typing.Annotated:
            notes = args[1:]
            if Ignored in notes or any(isinstance(x, Ignored) for x in notes):
                return None
            for x in notes:
                if isinstance(x, Range):
                    return Int(x.low, x.high)
                if isinstance(x, Precision):
                    return Float(x.step)
            return of(args[0], name)
        if origin in (typing.Union, types.UnionType):
            rest = [a for a in args if a is not type(None)]
            inner = of(rest[0], name) if len(rest) == 1 else Ref(union(name, rest))
            return Optional(inner) if len(rest) < len(args) else inner
        if origin is typing.Literal:
            named[name] = Enum(tuple(args))
            return Ref(name)
        if origin is list:
            return Array(of(args[0], name))
        if origin is dict:
            return Map(of(args[0], name), of(args[1], name))
        if dataclasses.is_dataclass(hint):
            return visit(hint)
        plain = {str: String(), int: Int(), float: Float(), bool: Boolean()}
        if hint not in plain:
            raise SchemaError(f"{name}: no type for {hint}")
        return plain[hint]

    def union(name: str, members: list[type]) -> str:
        named[name] = Union(tuple(visit(m).name for m in members))
        return name

    for cls in roots:
        visit(cls)
    return Schema(named)
