"""State files: JSON lines and whole binary messages, as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import bind, validate
from tidemark.functions.schema import Array, Map, Object, Optional, Ref, Schema, Type, Union, references
from tidemark.sources.codec import StateColumns


def loose_type(schema: Schema, t: Type, depth: int = 3, _within: tuple[str, ...] = ()) -> T.DataType:
    """The shape of a type with text leaves, for from_json: coercion comes afterwards.  Places below the depth are raw text."""
    if isinstance(t, Ref):
        return loose_type(schema, schema.named[t.name], depth, (*_within, t.name))
    match t:
        case Optional(x):
            return loose_type(schema, x, depth, _within)
        case Array(x):
            return T.ArrayType(loose_type(schema, x, depth, _within))
        case Map(_, x):
            return T.MapType(T.StringType(), loose_type(schema, x, depth, _within))
        case Object(fields):
            return T.StructType([T.StructField(n, T.StringType() if any(_within.count(r) >= depth for r in references(x)) else loose_type(schema, x, depth, _within)) for n, x in fields])
        case Union(options):
            own = {"_type": T.StringType()} | {o: loose_type(schema, Ref(o), depth, _within) for o in options}
            for o in options:
                for f in own[o].fields:
                    own.setdefault(f.name, f.dataType)
            return T.StructType([T.StructField(n, k) for n, k in own.items()])
    return T.StringType()


def parse_json(schema: Schema, root: str, text: Column, strict: bool = True, depth: int = 3) -> Column:
    """A JSON text column as a column of the root type: coerced, checked, unknown fields ignored."""
    loose = F.from_json(text, loose_type(schema, Ref(root), depth))
    return bind(loose, lambda v: validate(schema, Ref(root), v, strict=strict, depth=depth))


def _has_union(schema: Schema, t: Type, seen: frozenset = frozenset()) -> bool:
    if isinstance(t, Ref):
        return t.name not in seen and _has_union(schema, schema.named[t.name], seen | {t.name})
    match t:
        case Union():
            return True
        case Optional(x) | Array(x) | Map(_, x):
            return _has_union(schema, x, seen)
        case Object(fields):
            return any(_has_union(schema, x, seen) for _, x in fields)
    return False


def render_json(schema: Schema, root: str, state: Column, depth: int = 3) -> Column:
    """JSON text: absent optionals left out, keys as text, a union as {variant: fields}."""
    return F.to_json(_plain(schema, Ref(root), state, depth))


def _plain(schema: Schema, t: Type, v: Column, depth: int, _within: tuple[str, ...] = ()) -> Column:
    if not _has_union(schema, t):
        return v
    if isinstance(t, Ref):
        return _plain(schema, schema.named[t.name], v, depth, (*_within, t.name))
    match t:
        case Union(options):
            return F.when(v.isNotNull(), F.struct(*[_plain(schema, Ref(o), v[o], depth, _within).alias(o) for o in options]))
        case Object(fields):
            open_ = [(n, x) for n, x in fields if not any(_within.count(r) >= depth for r in references(x))]
            return F.when(v.isNotNull(), F.struct(*[_plain(schema, x, v[n], depth, _within).alias(n) for n, x in open_]))
        case Optional(x):
            return _plain(schema, x, v, depth, _within)
        case Array(x):
            return F.transform(v, lambda i: _plain(schema, x, i, depth, _within))
        case Map(_, x):
            return F.transform_values(v, lambda _, i: _plain(schema, x, i, depth, _within))
    return v


def read_json(spark: SparkSession, path: str, schema: Schema, root: str, strict: bool = True) -> DataFrame:
    """One state for each line."""
    return spark.read.text(path).select(parse_json(schema, root, F.col("value"), strict).alias("state"))


def write_json(df: DataFrame, path: str, schema: Schema, root: str, state: str = "state") -> None:
    df.select(render_json(schema, root, F.col(state)).alias("value")).write.text(path)


def read_binary(spark: SparkSession, path: str, schema: Schema, root: str, depth: int = 3) -> DataFrame:
    """One state for each file: path, state."""
    columns = StateColumns(schema, root, depth)
    return spark.read.format("binaryFile").load(path).select("path", columns.decode(F.col("content")).alias("state"))
