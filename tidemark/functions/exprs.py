"""Column expressions generated from types: equality, sizes, coercion and validation, defaults.

All of them stay inside Catalyst; nothing here calls Python for a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.schema import Array, Boolean, Enum, Float, Int, Map, Object, Optional, Ref, Schema, String, Type, Union, option_bits, references, to_spark
from tidemark.functions.schema import default as default_value
from tidemark.functions.wire import EPSILON, RUN_CODES



def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """`fn` of a value that is computed once for a row, however often `fn` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


# ---- numbers


def quantum(v: Column, precision: float) -> Column:
    """The integer that a quantized float is stored as; halves go up."""
    return F.floor(v / F.lit(float(precision)) + F.lit(0.5)).cast("long")


def quantize(v: Column, precision: float) -> Column:
    return quantum(v, precision) * F.lit(float(precision))


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def varint_size(v: Column) -> Column:
    """Bytes of a varint of a long, taken as unsigned."""
    out = F.lit(9)
    for n in range(8, 0, -1):
        out = F.when(v < F.lit(1 << 7 * n), n).otherwise(out)
    return F.when(v < 0, 10).otherwise(out).cast("long")


def signed_size(v: Column) -> Column:
    return varint_size(zigzag(v))


def run_cost(n: Column) -> Column:
    """Bits of one run of equal flags; null for a run longer than the format allows."""
    out = F.lit(None).cast("long")
    for low, high, prefix, width in RUN_CODES:
        out = F.when(n.between(low, high), len(prefix) + width).otherwise(out)
    return out


def bits_of(options: Sequence[str]) -> int:
    return option_bits(len(options))


# ---- equality


def close(a: Column, b: Column, epsilon: float = EPSILON, exact: bool = False) -> Column:
    """Float equality within epsilon; NaN equals nothing.  With `exact`, plain equality."""
    if exact:
        return (a == b) & ~F.isnan(a)
    return (F.abs(a - b) < F.lit(epsilon)) & ~F.isnan(a) & ~F.isnan(b)


def same_quantum(a: Column, b: Column, precision: float) -> Column:
    return quantum(a, precision) == quantum(b, precision)


def both_or(a: Column, b: Column, equal: Column) -> Column:
    """Two nulls are equal, a null and a value aren't."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(equal)


def equals(schema: Schema, t: Type, a: Column, b: Column, epsilon: float = EPSILON, exact: bool = False, depth: int = 3, _within: tuple[str, ...] = ()) -> Column:
    """Equality of two columns of a type, null-safe; recursion goes as deep as to_spark() does."""
    if isinstance(t, Ref):
        return equals(schema, schema.named[t.name], a, b, epsilon, exact, depth, (*_within, t.name))

    def of(x: Type, p: Column, q: Column) -> Column:
        return equals(schema, x, p, q, epsilon, exact, depth, _within)

    def open_(x: Type) -> bool:
        return not any(_within.count(r) >= depth for r in references(x))

    match t:
        case Optional(x):
            return of(x, a, b)
        case Float(precision):
            return both_or(a, b, same_quantum(a, b, precision) if precision else close(a, b, epsilon, exact))
        case Array(x):
            return both_or(a, b, (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda p, q: of(x, p, q)), lambda ok: ok))
        case Map(_, x):
            # keys first: a missing key and a null value look alike to map_zip_with
            same_keys = (F.size(a) == F.size(b)) & (F.size(F.array_except(F.map_keys(a), F.map_keys(b))) == 0)
            return both_or(a, b, same_keys & F.forall(F.map_values(F.map_zip_with(a, b, lambda _, p, q: of(x, p, q))), lambda ok: ok))
        case Object(fields):
            out = F.lit(True)
            for name, x in fields:
                if open_(x):
                    out = out & of(x, a[name], b[name])
            return both_or(a, b, out)
        case Union(options):
            out = F.lit(False)
            for o in options:
                out = F.when(a["_type"] == o, of(Ref(o), a[o], b[o])).otherwise(out)
            return both_or(a, b, (a["_type"] == b["_type"]) & out)
    return a.eqNullSafe(b)


# ---- coercion and validation of loose values


def _fail(path: str, what: str, v: Column, kind: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{path}: {what}: "), F.coalesce(v.cast("string"), F.lit("null")))).cast(kind)


def parse_string(v: Column) -> Column:
    return v.cast("string")


def parse_int(v: Column, low: int | None = None, high: int | None = None, path: str = "value", strict: bool = True) -> Column:
    """Whole numbers, also as text (the empty text is 0); out of bounds or no number: an error, or null unless `strict`."""
    text = F.trim(v.cast("string"))
    number = F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))
    whole = F.when(number == F.floor(number), F.coalesce(text.try_cast("long"), F.when(text == "", 0).otherwise(number.try_cast("long"))))

    def bad(what: str) -> Column:
        return _fail(path, what, v, "long") if strict else F.lit(None).cast("long")

    out = F.when(whole.isNull(), bad("not a whole number"))
    if low is not None:
        out = out.when(whole < low, bad(f"below minimum {low}"))
    if high is not None:
        out = out.when(whole > high, bad(f"above maximum {high}"))
    return out.otherwise(whole)


def parse_float(v: Column, path: str = "value", strict: bool = True, precision: float | None = None) -> Column:
    """Finite numbers, also as text; quantized at once if a precision is given."""
    number = v.cast("string").try_cast("double")
    fine = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    out = quantize(number, precision) if precision else number
    return F.when(fine, out).otherwise(_fail(path, "not a finite number", v, "double") if strict else F.lit(None).cast("double"))


def parse_boolean(v: Column, path: str = "value", strict: bool = True) -> Column:
    text = F.lower(v.cast("string"))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False).otherwise(_fail(path, "not a boolean", v, "boolean") if strict else F.lit(None).cast("boolean"))


def parse_enum(v: Column, options: Sequence[str], path: str = "value", strict: bool = True) -> Column:
    """Exact, then without case, then by ordinal."""
    text = v.cast("string")
    exact = F.array(*[F.lit(o) for o in options])
    lower = F.array(*[F.lit(o.lower()) for o in options])
    at = F.nullif(F.array_position(lower, F.lower(text)), F.lit(0).cast("long"))
    number = F.when(F.rlike(text, F.lit(r"\A\d+\z")), text.try_cast("int"))
    ordinal = F.when((number >= 0) & (number < len(options)), F.try_element_at(exact, number + 1))
    out = F.coalesce(F.when(F.array_contains(exact, text), text), F.try_element_at(exact, at.cast("int")), ordinal)
    return F.when(out.isNotNull(), out).otherwise(_fail(path, "not an option", v, "string") if strict else F.lit(None).cast("string"))


def parse_optional(v: Column) -> Column:
    """Null and the empty text are absent."""
    return F.when(v.cast("string") == "", None).otherwise(v)


def ordinal(v: Column, options: Sequence[str]) -> Column:
    """Place of an option, from 0; null if it is none."""
    return F.nullif(F.array_position(F.array(*[F.lit(o) for o in options]), v), F.lit(0).cast("long")) - 1


def too_deep(v: Column, path: str) -> Column:
    """An error if a place below the columns' depth, kept as raw text, holds anything."""
    return F.when(v.isNotNull() & ~v.cast("string").isin("", "[]", "{}"), F.raise_error(F.lit(f"{path}: nested too deep")).cast("boolean")).otherwise(True)


def validate(schema: Schema, t: Type, v: Column, path: str = "$", strict: bool = True, depth: int = 3, _within: tuple[str, ...] = ()) -> Column:
    """A loosely typed column (as from_json gives it with text leaves) as a column of the type; errors name the path.

    A union comes as {variant: fields} or with its fields beside `_type`.  Recursion goes as deep as to_spark() does; what
    lies deeper is an error.
    """
    if isinstance(t, Ref):
        return validate(schema, schema.named[t.name], v, path, strict, depth, (*_within, t.name))

    def inner(x: Type, w: Column, where: str) -> Column:
        return validate(schema, x, w, where, strict, depth, _within)

    kind = to_spark(schema, t, depth, _within).simpleString()

    def required(out: Column) -> Column:
        return F.when(v.isNull(), _fail(path, "missing", F.lit(None), kind) if strict else F.lit(None).cast(kind)).otherwise(out)

    match t:
        case String():
            return required(parse_string(v))
        case Int(low, high):
            return required(parse_int(v, low, high, path, strict))
        case Float():
            return required(parse_float(v, path, strict).cast(kind))
        case Boolean():
            return required(parse_boolean(v, path, strict))
        case Enum(options):
            return required(parse_enum(v, options, path, strict))
        case Optional(x):
            return F.when((parse_optional(v) if schema.is_scalar(x) else v).isNotNull(), inner(x, v, path))
        case Array(x):
            return required(F.transform(v, lambda i: inner(x, i, f"{path}[]")))
        case Map(k, x):
            return required(F.transform_values(F.transform_keys(v, lambda key, _: inner(k, key, f"{path} key")), lambda _, i: inner(x, i, f"{path}{{}}")))
        case Object(fields):
            closed = [n for n, x in fields if any(_within.count(r) >= depth for r in references(x))]
            out = F.struct(*[inner(x, v[n], f"{path}.{n}").alias(n) for n, x in fields if n not in closed])
            for n in closed:
                out = F.when(too_deep(v[n], f"{path}.{n}"), out)
            return required(out)
        case Union(options):
            given = F.lower(v["_type"])
            name = F.lit(None).cast("string")
            for o in reversed(options):
                name = F.when(F.when(given.isNotNull(), given == o.lower()).otherwise(v[o].isNotNull()), F.lit(o)).otherwise(name)
            variants = []
            for o in options:
                flat = F.struct(*[v[n].alias(n) for n, _ in schema.resolve(Ref(o)).fields])
                variants.append(F.when(name == o, inner(Ref(o), F.when(v[o].isNotNull(), v[o]).otherwise(flat), f"{path}.{o}")).alias(o))
            bad = _fail(path, f"no variant of {', '.join(options)}", v["_type"], kind) if strict else F.lit(None).cast(kind)
            return required(F.when(name.isNull(), bad).otherwise(F.struct(name.alias("_type"), *variants)))
    raise TypeError(f"{path}: no validation for {t}")


def literal(schema: Schema, t: Type) -> Column:
    """The default of a type as a column."""
    kind = to_spark(schema, t)
    resolved = schema.resolve(t)
    match resolved:
        case Object(fields):
            return F.struct(*[literal(schema, x).alias(name) for name, x in fields if name in kind.names])
        case Array():
            return F.array().cast(kind)
        case Map():
            return F.create_map().cast(kind)
        case Union(options):
            return F.struct(F.lit(options[0]).alias("_type"), *[(literal(schema, Ref(o)) if o == options[0] else F.lit(None)).cast(to_spark(schema, Ref(o))).alias(o) for o in options])
    return F.lit(default_value(schema, t)).cast(kind)


def fill(v: Column, schema: Schema, t: Type) -> Column:
    """The column, or the type's default where it is null."""
    return F.coalesce(v, literal(schema, t))
