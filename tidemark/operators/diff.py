"""Differences of two states, as relations: keyed tables, arrays, maps, optionals and unions; and their application.

A keyed table is the map of the data model: rows whose key only the old state has are deletions, only the new one has
additions, and rows in both that differ are updates.  Keys must be unique (see require_unique).  Each diff is one
full-outer join on the key, hash partitioned; a side below the broadcast threshold still shuffles, as outer joins must.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Equal = Callable[[Column, Column], Column]


def null_safe(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`df`, which fails at run time where a key repeats; costs a window over the key, whose shuffle the diff's join reuses."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit("repeated key "), F.to_json(F.struct(*keys)))).cast("boolean")).otherwise(True)
    return df.withColumn("__unique", checked).where("__unique").drop("__unique")


def diff_tables(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Mapping[str, Equal] | Sequence[str], keep_same: bool = False) -> DataFrame:
    """Keys, op (add, del, upd, same), and for each field old_<f>, new_<f> and <f>_changed.

    `fields` may give each field its own equality; null-safe equality otherwise.  In additions and deletions every field
    counts as changed.  Unchanged rows are left out unless asked for.
    """
    equal = dict(fields) if isinstance(fields, Mapping) else dict.fromkeys(fields, null_safe)
    a = old.select(*keys, *[F.col(f).alias(f"old_{f}") for f in equal], F.lit(True).alias("__old"))
    b = new.select(*keys, *[F.col(f).alias(f"new_{f}") for f in equal], F.lit(True).alias("__new"))
    both = a.join(b, list(keys), "full_outer")
    present = F.col("__old").isNotNull() & F.col("__new").isNotNull()
    changed = {f: F.when(present, ~same(F.col(f"old_{f}"), F.col(f"new_{f}"))).otherwise(True) for f, same in equal.items()}
    any_changed = F.lit(False)
    for f in equal:
        any_changed = any_changed | F.col(f"{f}_changed")
    out = both.withColumns({f"{f}_changed": c for f, c in changed.items()})
    op = F.when(F.col("__old").isNull(), "add").when(F.col("__new").isNull(), "del").when(any_changed, "upd").otherwise("same")
    out = out.withColumn("op", op).drop("__old", "__new")
    out = out if keep_same else out.where("op <> 'same'")
    return out.select(*keys, "op", *[c for f in equal for c in (f"old_{f}", f"new_{f}", f"{f}_changed")])


def patch_table(old: DataFrame, diff: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The old state with a diff applied: deletions go, changed fields take the new value, unchanged ones keep the old, additions come.

    So a change too small for the field's equality leaves the old value, as it does for a receiver of the binary form.
    """
    d = diff.select(*keys, F.col("op").alias("__op"), *[F.col(f"new_{f}").alias(f"__n_{f}") for f in fields], *[F.col(f"{f}_changed").alias(f"__c_{f}") for f in fields])
    joined = old.select(*keys, *fields, F.lit(True).alias("__old")).join(d, list(keys), "full_outer").where("__op is null or __op <> 'del'")
    value = {f: F.when(F.col("__old").isNull() | F.coalesce(F.col(f"__c_{f}"), F.lit(False)), F.col(f"__n_{f}")).otherwise(F.col(f)) for f in fields}
    return joined.select(*keys, *[v.alias(f) for f, v in value.items()])


def deletions(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(new.select(*keys), list(keys), "left_anti")


def additions(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return new.join(old.select(*keys), list(keys), "left_anti")


# ---- arrays: by position; a shorter array is a truncation, a longer one has a tail


def array_updates(a: Column, b: Column, equal: Equal = null_safe) -> Column:
    """array<struct<pos, value>>: positions of both arrays whose items differ, with the new item."""
    both = F.least(F.size(a), F.size(b))
    pairs = F.transform(F.slice(b, F.lit(1), both), lambda v, i: F.struct(i.alias("pos"), v.alias("value"), equal(F.get(a, i), v).alias("same")))
    return F.transform(F.filter(pairs, lambda p: ~p["same"]), lambda p: F.struct(p["pos"].alias("pos"), p["value"].alias("value")))


def array_tail(a: Column, b: Column) -> Column:
    """Items of `b` beyond the length of `a`."""
    return F.when(F.size(b) > F.size(a), F.slice(b, F.size(a) + 1, F.greatest(F.size(b) - F.size(a), F.lit(1)))).otherwise(F.slice(b, 1, 0))


def array_patch(a: Column, size: Column, updates: Column, tail: Column) -> Column:
    """Truncate, update, append."""
    changed = F.map_from_entries(updates)
    kept = F.slice(a, F.lit(1), F.least(F.size(a), size))
    return F.concat(F.transform(kept, lambda v, i: F.when(F.map_contains_key(changed, i), F.element_at(changed, i)).otherwise(v)), tail)


def array_diff_rows(old: DataFrame, new: DataFrame, keys: Sequence[str], array: str, equal: Equal = null_safe) -> DataFrame:
    """Keys, pos, op (add, del, upd), old_value, new_value: arrays exploded on both sides and joined on position."""
    a = old.select(*keys, F.posexplode(array).alias("pos", "value"))
    b = new.select(*keys, F.posexplode(array).alias("pos", "value"))
    return diff_tables(a, b, [*keys, "pos"], {"value": equal}).drop("value_changed")


# ---- maps


def map_deletions(a: Column, b: Column) -> Column:
    return F.array_except(F.map_keys(a), F.map_keys(b))


def map_additions(a: Column, b: Column) -> Column:
    return F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k))


def map_updates(a: Column, b: Column, equal: Equal = null_safe) -> Column:
    """Entries of `b` whose key `a` has with another value."""
    return F.map_filter(b, lambda k, v: F.map_contains_key(a, k) & ~equal(F.try_element_at(a, k), v))


def map_patch(a: Column, gone: Column, updates: Column, new: Column) -> Column:
    kept = F.map_filter(a, lambda k, _: ~F.array_contains(gone, k) & ~F.map_contains_key(updates, k))
    return F.map_concat(kept, updates, new)


# ---- optionals and unions


def optional_transition(a: Column, b: Column, equal: Equal = null_safe) -> Column:
    """none, set, cleared, changed or kept."""
    return F.when(a.isNull() & b.isNull(), "none").when(a.isNull(), "set").when(b.isNull(), "cleared").when(equal(a, b), "kept").otherwise("changed")


def union_diff(a: Column, b: Column, same_value: Column) -> Column:
    """switch (another variant), update (the same one, changed) or same."""
    return F.when(~a.eqNullSafe(b), "switch").when(~same_value, "update").otherwise("same")
