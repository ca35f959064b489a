"""State columns to binary columns and back, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.functions.flat import FlatCodec
from tidemark.functions.schema import Array, Map, Object, Optional, Ref, Schema, Type, Union, to_spark, too_deep
from tidemark.functions.wire import EPSILON, Codec, WireError


def spread(scan: DataFrame) -> DataFrame:
    """A scan's rows dealt to all cores, where its files make fewer tasks than there are: the codec costs more than a shuffle of
    a few files.  A large input has more splits than cores and stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def to_state(schema: Schema, t: Type, v):
    """An Arrow value (maps as pair lists) as a state."""
    t = schema.resolve(t)
    if v is None:
        return None
    match t:
        case Optional(x):
            return to_state(schema, x, v)
        case Array(x):
            return [to_state(schema, x, i) for i in v]
        case Map(_, x):
            return {k: to_state(schema, x, i) for k, i in (v.items() if isinstance(v, dict) else v)}
        case Object(fields):
            return {name: to_state(schema, x, v.get(name)) for name, x in fields}
        case Union(options):
            held = [o for o in options if v.get(o) is not None]
            if held != [v["_type"]]:
                raise WireError(f"variant {v['_type']} with values of {held}")
            return {"_type": v["_type"], v["_type"]: to_state(schema, Ref(v["_type"]), v[v["_type"]])}
    return v


def from_state(schema: Schema, t: Type, v):
    t = schema.resolve(t)
    if v is None:
        return None
    match t:
        case Optional(x):
            return from_state(schema, x, v)
        case Array(x):
            return [from_state(schema, x, i) for i in v]
        case Map(_, x):
            return [(k, from_state(schema, x, i)) for k, i in v.items()]
        case Object(fields):
            return {name: from_state(schema, x, v.get(name)) for name, x in fields}
        case Union():
            return {"_type": v["_type"], v["_type"]: from_state(schema, Ref(v["_type"]), v[v["_type"]])}
    return v


def loosened(t: T.DataType) -> T.DataType:
    """The type without field metadata, everything nullable: what a Python function may return."""
    match t:
        case T.StructType():
            return T.StructType([T.StructField(f.name, loosened(f.dataType)) for f in t.fields])
        case T.ArrayType():
            return T.ArrayType(loosened(t.elementType))
        case T.MapType():
            return T.MapType(loosened(t.keyType), loosened(t.valueType))
    return t


def _reached(schema: Schema, t: Type, seen: set[str] | None = None) -> tuple[set[type], bool]:
    """The kinds of types below a type, and whether a named type stands within itself."""
    seen = set() if seen is None else seen
    kinds, recursive = {type(t)}, False
    inner: list[tuple[Type, set[str]]] = []
    match t:
        case Ref(name):
            if name in seen:
                return kinds, True
            inner = [(schema.named[name], seen | {name})]
        case Optional(x) | Array(x):
            inner = [(x, seen)]
        case Map(k, x):
            inner = [(k, seen), (x, seen)]
        case Object(fields):
            inner = [(x, seen) for _, x in fields]
        case Union(options):
            inner = [(Ref(o), seen) for o in options]
    for x, path in inner:
        more, again = _reached(schema, x, path)
        kinds |= more
        recursive |= again
    return kinds, recursive


class StateColumns:
    """Column functions for states of one root type.

    Null in, null out.  Bad bytes raise, unless `lenient`, which gives null.  States nested deeper than `depth` are refused.
    """

    def __init__(self, schema: Schema, root: str, depth: int = 3, epsilon: float = EPSILON, lenient: bool = False):
        self.schema, self.root, self.depth, self.lenient = schema, root, depth, lenient
        self.codec = Codec(schema, root, epsilon)
        kinds, self.recursive = _reached(schema, Ref(root))
        # without maps and unions, and within the depth, an Arrow value is a state as it is
        self.plain = not kinds & {Map, Union} and not self.recursive
        #: Batch by batch for flat states; what it leaves goes value by value.
        self.flat = FlatCodec.of(schema, root, epsilon)
        self.type: T.DataType = loosened(to_spark(schema, Ref(root), depth))

    def _states(self, column: pa.Array) -> list:
        values = column.to_pylist()
        return values if self.plain else [to_state(self.schema, Ref(self.root), v) for v in values]

    def _apply(self, fn: Callable, *rows: list) -> list:
        out = []
        for values in zip(*rows, strict=True):
            if any(v is None for v in values):
                out.append(None)
                continue
            try:
                out.append(fn(*values))
            except (WireError, UnicodeDecodeError):
                if not self.lenient:
                    raise
                out.append(None)
        return out

    def _column(self, states: list) -> pa.Array:
        if self.recursive and any(too_deep(self.schema, Ref(self.root), s, self.depth) for s in states):
            raise WireError(f"a state nests deeper than {self.depth}")
        return pa.array(states if self.plain else [from_state(self.schema, Ref(self.root), s) for s in states], to_arrow_type(self.type))

    def encode(self, state: Column) -> Column:
        @F.arrow_udf(T.BinaryType())
        def encode_state(a: pa.Array) -> pa.Array:
            out = self.flat.encode(a) if self.flat else None
            return out if out is not None else pa.array(self._apply(self.codec.encode, self._states(a)), pa.binary())

        return encode_state(state)

    def decode(self, data: Column) -> Column:
        @F.arrow_udf(self.type)
        def decode_state(a: pa.Array) -> pa.Array:
            out = self.flat.decode(a, to_arrow_type(self.type)) if self.flat else None
            return out if out is not None else self._column(self._apply(self.codec.decode, a.to_pylist()))

        return decode_state(data)

    def encode_diff(self, old: Column, new: Column) -> Column:
        @F.arrow_udf(T.BinaryType())
        def encode_difference(a: pa.Array, b: pa.Array) -> pa.Array:
            out = self.flat.encode_diff(a, b) if self.flat else None
            return out if out is not None else pa.array(self._apply(self.codec.encode_diff, self._states(a), self._states(b)), pa.binary())

        return encode_difference(old, new)

    def decode_diff(self, old: Column, data: Column) -> Column:
        @F.arrow_udf(self.type)
        def decode_difference(a: pa.Array, d: pa.Array) -> pa.Array:
            out = self.flat.decode_diff(a, d, to_arrow_type(self.type)) if self.flat else None
            return out if out is not None else self._column(self._apply(self.codec.decode_diff, self._states(a), d.to_pylist()))

        return decode_difference(old, data)
