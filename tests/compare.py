"""Order-insensitive comparison of results."""

import math

import pandas as pd


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if type(v).__name__ in ("bool", "bool_", "int", "int32", "int64"):
        return str(int(v))
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() and abs(v) < 1e15 else f"{v:.9g}"
    return str(v)


def rows(frame: pd.DataFrame):
    names = sorted(frame.columns)
    return names, sorted(tuple(cell(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


def same(a: pd.DataFrame, b: pd.DataFrame):
    (n1, r1), (n2, r2) = rows(a), rows(b)
    assert n1 == n2
    assert len(r1) == len(r2)
    wrong = [(x, y) for x, y in zip(r1, r2, strict=True) if x != y]
    assert not wrong, wrong[:3]
