"""Loose JSON values to states and back, one value at a time (for the command line and small data)."""

from __future__ import annotations

import math

from tidemark.functions.schema import Array, Boolean, Enum, Float, Int, Map, Object, Optional, Ref, Schema, String, Type, Union


class ValueProblem(ValueError):
    """A value that doesn't fit its type; the message begins with the path."""


def _number(v, path: str) -> float:
    if isinstance(v, bool) or not isinstance(v, int | float | str):
        raise ValueProblem(f"{path}: no number: {v!r}")
    try:
        return v if not isinstance(v, str) else float(v.strip() or 0)
    except ValueError:
        raise ValueProblem(f"{path}: no number: {v!r}") from None


def parse(schema: Schema, t: Type, v, path: str = "$"):
    """Coerce and check: numbers may be text, booleans 0 and 1, options any case or an ordinal; unknown fields are ignored."""
    t = schema.resolve(t)
    if isinstance(t, Optional):
        return None if v is None or v == "" else parse(schema, t.inner, v, path)
    if v is None:
        raise ValueProblem(f"{path}: missing")
    match t:
        case String():
            if isinstance(v, bool):
                return "true" if v else "false"
            if isinstance(v, float) and v.is_integer():
                return str(int(v))
            if isinstance(v, str | int | float):
                return str(v)
            raise ValueProblem(f"{path}: no text: {v!r}")
        case Int(low, high):
            n = _number(v, path)
            if isinstance(v, str) and v.strip().lstrip("+-").isdigit():
                n = int(v)
            if isinstance(n, float):
                if not math.isfinite(n) or not n.is_integer():
                    raise ValueProblem(f"{path}: not a whole number: {v!r}")
                n = int(n)
            if low is not None and n < low:
                raise ValueProblem(f"{path}: {n} is below minimum {low}")
            if high is not None and n > high:
                raise ValueProblem(f"{path}: {n} is above maximum {high}")
            return n
        case Float():
            n = float(_number(v, path))
            if not math.isfinite(n):
                raise ValueProblem(f"{path}: not finite: {v!r}")
            return n
        case Boolean():
            text = str(v).lower() if isinstance(v, bool | int | str) else ""
            if text in ("true", "1"):
                return True
            if text in ("false", "0"):
                return False
            raise ValueProblem(f"{path}: no boolean: {v!r}")
        case Enum(options):
            if isinstance(v, str):
                if v in options:
                    return v
                for o in options:
                    if o.lower() == v.lower():
                        return o
            if not isinstance(v, bool) and str(v).isdigit() and int(v) < len(options):
                return options[int(v)]
            raise ValueProblem(f"{path}: not one of {', '.join(options)}: {v!r}")
        case Array(x):
            if not isinstance(v, list):
                raise ValueProblem(f"{path}: no array")
            return [parse(schema, x, item, f"{path}[{i}]") for i, item in enumerate(v)]
        case Map(k, x):
            if not isinstance(v, dict):
                raise ValueProblem(f"{path}: no map")
            return {parse(schema, k, key, f"{path} key"): parse(schema, x, item, f"{path}[{key!r}]") for key, item in v.items()}
        case Object(fields):
            if not isinstance(v, dict):
                raise ValueProblem(f"{path}: no object")
            return {name: parse(schema, x, v.get(name), f"{path}.{name}") for name, x in fields}
        case Union(options):
            if not isinstance(v, dict):
                raise ValueProblem(f"{path}: no variant")
            lower = {o.lower(): o for o in options}
            if "_type" in v:
                name, inner = lower.get(str(v["_type"]).lower()), v
                inner = v.get(name, v) if name and isinstance(v.get(name), dict) else v
            elif len(v) == 1:
                key = next(iter(v))
                name, inner = lower.get(key.lower()), v[key]
            else:
                name = None
            if not name:
                raise ValueProblem(f"{path}: no variant of {', '.join(options)}")
            return {"_type": name, name: parse(schema, Ref(name), inner, f"{path}.{name}")}
    raise ValueProblem(f"{path}: unknown type")


def render(schema: Schema, t: Type, v):
    """A state as JSON values: absent optionals left out, keys as text, a union as {variant: fields}."""
    t = schema.resolve(t)
    match t:
        case Optional(x):
            return None if v is None else render(schema, x, v)
        case Array(x):
            return [render(schema, x, item) for item in v]
        case Map(_, x):
            return {str(k): render(schema, x, item) for k, item in v.items()}
        case Object(fields):
            return {name: render(schema, x, v.get(name)) for name, x in fields if not (isinstance(schema.resolve(x), Optional) and v.get(name) is None)}
        case Union():
            return {v["_type"]: render(schema, Ref(v["_type"]), v[v["_type"]])}
    return v
