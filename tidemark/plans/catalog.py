"""Registry of the library's queries and of the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions import exprs as X
from tidemark.functions.schema import Array, Float, Int, Map, Object, Optional, Ref, Schema, String, Union
from tidemark.operators import diff as D
from tidemark.operators import history as H
from tidemark.operators import mutators as M
from tidemark.operators import spatial as S
from tidemark.plans.inputs import AB_SQL, ARRAYS_SQL, EVENT_TYPES, LOG_SQL, MAPS_SQL, ORDER_SCHEMA, PLAYER_SCHEMA, PRIORITY, TICKS_SQL, event_log, orders_a, orders_b, scratch, table, ticks, user_arrays, user_maps
from tidemark.sources.codec import StateColumns, spread
from tidemark.sources.files import parse_json, render_json
from tidemark.streaming import clients

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


KEY = ["o_orderkey"]
FIELDS = {"o_custkey": D.null_safe, "o_orderstatus": D.null_safe, "o_totalprice": lambda a, b: X.both_or(a, b, X.close(a, b)), "o_orderpriority": D.null_safe}


def order_diff(spark: SparkSession, d: str, keep_same: bool = False) -> DataFrame:
    return D.diff_tables(orders_a(spark, d), orders_b(spark, d), KEY, FIELDS, keep_same)


# ---- differences of keyed tables


@query(f"WITH {AB_SQL} SELECT o_orderkey, op, status_a AS old_status, status_b AS new_status, price_a AS old_price, price_b AS new_price, priority_a AS old_priority, priority_b AS new_priority, status_c AS status_changed, price_c AS price_changed, priority_c AS priority_changed FROM o WHERE op <> 'same'")
def snapshot_diff_orders(spark, d):
    out = order_diff(spark, d)
    names = {"o_orderstatus": "status", "o_totalprice": "price", "o_orderpriority": "priority"}
    return out.select("o_orderkey", "op", *[F.col(f"{p}_{f}").alias(f"{p}_{n}") for f, n in names.items() for p in ("old", "new")], *[F.col(f"{f}_changed").alias(f"{n}_changed") for f, n in names.items()])


@query(f"WITH {AB_SQL} SELECT op, count(*) AS n FROM o GROUP BY op")
def snapshot_diff_counts(spark, d):
    return order_diff(spark, d, keep_same=True).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {AB_SQL} SELECT o_orderkey, status_c AS status_changed, price_c AS price_changed, priority_c AS priority_changed FROM o WHERE ina AND inb")
def field_change_flags(spark, d):
    out = order_diff(spark, d, keep_same=True).where("op in ('upd', 'same')")
    return out.select("o_orderkey", F.col("o_orderstatus_changed").alias("status_changed"), F.col("o_totalprice_changed").alias("price_changed"), F.col("o_orderpriority_changed").alias("priority_changed"))


@query(f"WITH {AB_SQL} SELECT op, count(*) AS n, CAST(sum(status_c::INT) AS BIGINT) AS status_n, CAST(sum(price_c::INT) AS BIGINT) AS price_n, CAST(sum(priority_c::INT) AS BIGINT) AS priority_n, round(avg(status_c::INT), 6) AS status_rate FROM o GROUP BY op")
def field_change_rates(spark, d):
    def n(f):
        return F.sum(F.col(f"{f}_changed").cast("long"))

    return order_diff(spark, d, keep_same=True).groupBy("op").agg(F.count(F.lit(1)).alias("n"), n("o_orderstatus").alias("status_n"), n("o_totalprice").alias("price_n"), n("o_orderpriority").alias("priority_n"), F.round(F.avg(F.col("o_orderstatus_changed").cast("int")), 6).alias("status_rate"))


@query(f"WITH {AB_SQL} SELECT o_orderkey, custkey_b AS o_custkey, status_b AS o_orderstatus, CASE WHEN ina AND abs(price_a - price_b) < 0.001 THEN price_a ELSE price_b END AS o_totalprice, priority_b AS o_orderpriority FROM j WHERE inb")
def patch_apply_orders(spark, d):
    return D.patch_table(orders_a(spark, d), order_diff(spark, d), KEY, list(FIELDS))


@query("SELECT 'changed' AS kind, 0::BIGINT AS n UNION ALL SELECT 'rows', count(*) FROM orders WHERE o_orderkey % 10 <> 3")
def patch_identity(spark, d):
    a = orders_a(spark, d)
    out = D.diff_tables(a, a, KEY, FIELDS, keep_same=True)
    return out.agg(F.sum((F.col("op") != "same").cast("long")).alias("changed"), F.count(F.lit(1)).alias("rows")).select(F.explode(F.map_from_arrays(F.array(F.lit("changed"), F.lit("rows")), F.array("changed", "rows"))).alias("kind", "n"))


@query(f"WITH {AB_SQL} SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.o_orderkey = a.o_orderkey)")
def map_deletions(spark, d):
    return D.deletions(orders_a(spark, d), orders_b(spark, d), KEY)


@query(f"WITH {AB_SQL} SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.o_orderkey = a.o_orderkey)")
def map_additions(spark, d):
    return D.additions(orders_a(spark, d), orders_b(spark, d), KEY)


@query(f"WITH {AB_SQL} SELECT o_orderkey, CASE WHEN status_c THEN status_b END AS new_status, CASE WHEN price_c THEN price_b END AS new_price, CASE WHEN priority_c THEN priority_b END AS new_priority FROM o WHERE op = 'upd'")
def map_updates(spark, d):
    out = order_diff(spark, d).where("op = 'upd'")

    def new(f):
        return F.when(F.col(f"{f}_changed"), F.col(f"new_{f}"))

    return out.select("o_orderkey", new("o_orderstatus").alias("new_status"), new("o_totalprice").alias("new_price"), new("o_orderpriority").alias("new_priority"))


@query(f"WITH {AB_SQL}, x AS (SELECT op, f.field, f.c FROM o, LATERAL (VALUES ('custkey', custkey_c), ('price', price_c), ('priority', priority_c), ('status', status_c)) f(field, c) WHERE op <> 'same') SELECT op, field, count(*) AS n, CAST(sum(c::INT) AS BIGINT) AS changed FROM x GROUP BY ROLLUP (op, field)")
def diff_stats_rollup(spark, d):
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"{f}_changed").alias("c")) for f, n in (("o_custkey", "custkey"), ("o_totalprice", "price"), ("o_orderpriority", "priority"), ("o_orderstatus", "status"))]))
    return order_diff(spark, d).select("op", long.alias("x")).select("op", "x.field", "x.c").rollup("op", "field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c").cast("long")).alias("changed"))


@query(f"WITH {AB_SQL} SELECT priority_a AS old_priority, CASE WHEN priority_a IS NULL AND priority_b IS NULL THEN 'none' WHEN priority_a IS NULL THEN 'set' WHEN priority_b IS NULL THEN 'cleared' WHEN priority_a = priority_b THEN 'kept' ELSE 'changed' END AS transition, count(*) AS n FROM j WHERE ina AND inb GROUP BY ALL")
def optional_transitions(spark, d):
    out = order_diff(spark, d, keep_same=True).where("op in ('upd', 'same')")
    t = D.optional_transition(F.col("old_o_orderpriority"), F.col("new_o_orderpriority"))
    return out.groupBy(F.col("old_o_orderpriority").alias("old_priority"), t.alias("transition")).agg(F.count(F.lit(1)).alias("n"))


# ---- arrays and maps


@query(f"WITH {ARRAYS_SQL} SELECT a.user_id, CAST(a.pos AS INT) AS pos, b.value FROM a JOIN b ON a.user_id = b.user_id AND a.pos = b.pos WHERE abs(a.value - b.value) >= 0.001")
def array_diff_sparse(spark, d):
    a, b = user_arrays(spark, d)
    both = a.join(b.withColumnRenamed("v", "w"), "user_id")
    return both.select("user_id", F.explode(D.array_updates(F.col("v"), F.col("w"), X.close)).alias("u")).select("user_id", "u.pos", "u.value")


@query(f"WITH {ARRAYS_SQL}, x AS (SELECT user_id, count(*) AS n FROM a GROUP BY 1), y AS (SELECT user_id, count(*) AS n FROM b GROUP BY 1) SELECT x.user_id, CAST(x.n AS INT) AS old_size, CAST(coalesce(y.n, 0) AS INT) AS new_size, CAST(greatest(x.n - coalesce(y.n, 0), 0) AS INT) AS truncated, CAST(greatest(coalesce(y.n, 0) - x.n, 0) AS INT) AS tail, coalesce(round((SELECT sum(value) FROM b WHERE b.user_id = x.user_id AND b.pos >= x.n), 6), 0) AS tail_sum FROM x LEFT JOIN y USING (user_id)")
def array_tail_and_truncate(spark, d):
    a, b = user_arrays(spark, d)
    both = a.join(b.withColumnRenamed("v", "w"), "user_id")
    tail = D.array_tail(F.col("v"), F.col("w"))
    return both.select("user_id", F.size("v").alias("old_size"), F.size("w").alias("new_size"), F.greatest(F.size("v") - F.size("w"), F.lit(0)).alias("truncated"), F.size(tail).alias("tail"), F.round(F.aggregate(tail, F.lit(0.0), lambda s, x: s + x), 6).alias("tail_sum"))


@query(f"WITH {ARRAYS_SQL} SELECT coalesce(a.user_id, b.user_id) AS user_id, CAST(coalesce(a.pos, b.pos) AS INT) AS pos, CASE WHEN a.pos IS NULL THEN 'add' WHEN b.pos IS NULL THEN 'del' ELSE 'upd' END AS op, a.value AS old_value, b.value AS new_value FROM a FULL JOIN b ON a.user_id = b.user_id AND a.pos = b.pos WHERE a.pos IS NULL OR b.pos IS NULL OR abs(a.value - b.value) >= 0.001")
def array_diff_positions(spark, d):
    a, b = user_arrays(spark, d)
    return D.array_diff_rows(a, b, ["user_id"], "v", X.close)


@query(f"WITH {ARRAYS_SQL} SELECT b.user_id, CAST(b.pos AS INT) AS pos, CASE WHEN abs(a.value - b.value) < 0.001 THEN a.value ELSE b.value END AS value FROM b LEFT JOIN a ON a.user_id = b.user_id AND a.pos = b.pos")
def array_patch(spark, d):
    a, b = user_arrays(spark, d)
    both = a.join(b.withColumnRenamed("v", "w"), "user_id")
    patched = D.array_patch(F.col("v"), F.size("w"), D.array_updates(F.col("v"), F.col("w"), X.close), D.array_tail(F.col("v"), F.col("w")))
    return both.select("user_id", F.posexplode(patched).alias("pos", "value"))


MUTATORS_SQL = "l AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1)"


def array_edits(a: DataFrame) -> DataFrame:
    """(user_id, v) -> a row for each edit: size, first and last item of its result, and the number of positions it touches."""
    v = F.col("v")
    edits = {"push": M.push(v, F.lit(9.5)), "pop": M.pop(v), "shift": M.shift(v), "unshift": M.unshift(v, F.lit(9.5)), "splice": M.splice(v, F.lit(2), F.lit(2), F.lit(9.5)), "length": M.set_length(v, F.lit(4)), "reverse": M.reverse(v), "sort": M.sort(v), "fill": M.fill(v, F.lit(0.0), F.lit(1), F.lit(3)), "copy": M.copy_within(v, F.lit(0), F.lit(3), F.lit(6))}
    rows = a.select("user_id", "v", F.explode(F.array(*[F.struct(F.lit(k).alias("edit"), w.alias("w")) for k, w in edits.items()])).alias("e")).select("user_id", "v", "e.edit", "e.w")
    return rows.select("user_id", "edit", F.size("w").alias("size"), F.try_element_at("w", F.lit(1)).alias("first"), F.try_element_at("w", F.lit(-1)).alias("last"), F.size(M.touched(F.col("v"), F.col("w"))).alias("touched"))


@query(f"WITH {MUTATORS_SQL}, m AS (SELECT user_id, 'push' AS edit, v || [9.5::DOUBLE] AS w, v FROM l UNION ALL SELECT user_id, 'pop', v[1:len(v) - 1], v FROM l UNION ALL SELECT user_id, 'shift', v[2:], v FROM l UNION ALL SELECT user_id, 'unshift', [9.5::DOUBLE] || v, v FROM l UNION ALL SELECT user_id, 'splice', v[1:2] || [9.5::DOUBLE] || v[5:], v FROM l UNION ALL SELECT user_id, 'length', v[1:4], v FROM l UNION ALL SELECT user_id, 'reverse', list_reverse(v), v FROM l UNION ALL SELECT user_id, 'sort', list_sort(v), v FROM l UNION ALL SELECT user_id, 'fill', v[1:1] || list_transform(v[2:3], lambda x: 0::DOUBLE) || v[4:], v FROM l UNION ALL SELECT user_id, 'copy', (v[4:6] || v[4:])[1:len(v)], v FROM l) SELECT user_id, edit, CAST(len(w) AS INT) AS size, w[1] AS first, w[-1] AS last, CAST(len(list_filter(range(1, len(w) + 1), lambda i: v[i] IS DISTINCT FROM w[i])) AS INT) AS touched FROM m")
def array_mutators(spark, d):
    """Each edit of all of a user's values, with the number of positions it touches."""
    a, _ = user_arrays(spark, d)
    return array_edits(a)


@query(f"WITH {MAPS_SQL}, j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, a.n AS x, b.n AS y FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type) SELECT user_id, event_type, CASE WHEN x IS NULL THEN 'add' WHEN y IS NULL THEN 'del' ELSE 'upd' END AS op, y AS new_value FROM j WHERE x IS DISTINCT FROM y")
def map_column_diff(spark, d):
    m = user_maps(spark, d)
    a, b = F.col("a"), F.col("b")

    def rows(op, entries):
        return F.transform(entries, lambda e: F.struct(e["key"].alias("event_type"), F.lit(op).alias("op"), e["value"].alias("new_value")))

    gone = F.transform(D.map_deletions(a, b), lambda k: F.struct(k.alias("event_type"), F.lit("del").alias("op"), F.lit(None).cast("long").alias("new_value")))
    return m.select("user_id", F.explode(F.concat(gone, rows("upd", F.map_entries(D.map_updates(a, b))), rows("add", F.map_entries(D.map_additions(a, b))))).alias("r")).select("user_id", "r.*")


@query(f"WITH {MAPS_SQL} SELECT user_id, event_type, n FROM b")
def map_column_patch(spark, d):
    m = user_maps(spark, d)
    a, b = F.col("a"), F.col("b")
    patched = D.map_patch(a, D.map_deletions(a, b), D.map_updates(a, b), D.map_additions(a, b))
    return m.select("user_id", F.explode(patched).alias("event_type", "n"))


# ---- equality


@query("SELECT l_returnflag, count(*) AS n, CAST(sum((abs(l_extendedprice * l_discount - l_extendedprice * l_tax) < 0.001)::INT) AS BIGINT) AS equal FROM lineitem GROUP BY 1")
def epsilon_equals(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(X.close(F.col("l_extendedprice") * F.col("l_discount"), F.col("l_extendedprice") * F.col("l_tax")).cast("long")).alias("equal"))


@query("SELECT user_id, count(*) AS n, CAST(sum((floor(value / 0.5 + 0.5) = floor((value + 0.2) / 0.5 + 0.5))::INT) AS BIGINT) AS equal FROM events GROUP BY 1")
def quantized_equals(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(X.same_quantum(v, v + 0.2, 0.5).cast("long")).alias("equal"))


@query(f"WITH {AB_SQL} SELECT o_orderkey, NOT (custkey_c OR status_c OR price_c OR priority_c) AS equal FROM j WHERE ina AND inb")
def struct_equals(spark, d):
    t = Object((("o_custkey", Int()), ("o_orderstatus", String()), ("o_totalprice", Float()), ("o_orderpriority", Optional(String()))))
    fields = [n for n, _ in t.fields]
    a, b = orders_a(spark, d).select("o_orderkey", F.struct(*fields).alias("a")), orders_b(spark, d).select("o_orderkey", F.struct(*fields).alias("b"))
    return a.join(b, "o_orderkey").select("o_orderkey", X.equals(Schema({}), t, F.col("a"), F.col("b")).alias("equal"))


@query(f"WITH {ARRAYS_SQL}, j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(abs(a.value - b.value) < 0.001, false) AS same FROM a FULL JOIN b ON a.user_id = b.user_id AND a.pos = b.pos) SELECT user_id, bool_and(same) AS equal FROM j GROUP BY 1 UNION ALL SELECT DISTINCT -1 - user_id, true FROM a")
def array_equals(spark, d):
    """Whole arrays against their variant and, under -1 - user_id, against themselves."""
    a, b = user_arrays(spark, d)
    both = a.join(b.withColumnRenamed("v", "w"), "user_id").unionByName(a.select((-1 - F.col("user_id")).alias("user_id"), "v", F.col("v").alias("w")))
    return both.select("user_id", X.equals(Schema({}), Array(Float()), F.col("v"), F.col("w")).alias("equal"))


@query(f"WITH {MAPS_SQL} SELECT user_id, NOT EXISTS (SELECT 1 FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type WHERE coalesce(a.user_id, b.user_id) = u.user_id AND a.n IS DISTINCT FROM b.n) AS equal FROM u")
def map_equals(spark, d):
    return user_maps(spark, d).select("user_id", X.equals(Schema({}), Map(String(), Int()), F.col("a"), F.col("b")).alias("equal"))


EVENT_UNION = Schema({"Click": Object((("value", Float(0.1)),)), "Other": Object((("kind", String()), ("value", Float()))), "Event": Union(("Click", "Other"))})


def event_union(e: DataFrame, value):
    click = F.when(F.col("event_type") == "click", F.struct(value.alias("value")))
    other = F.when(F.col("event_type") != "click", F.struct(F.col("event_type").alias("kind"), value.alias("value")))
    return F.struct(F.when(F.col("event_type") == "click", "Click").otherwise("Other").alias("_type"), click.alias("Click"), other.alias("Other"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN floor(value / 0.1::DOUBLE + 0.5::DOUBLE) = floor((value + 0.04::DOUBLE) / 0.1::DOUBLE + 0.5::DOUBLE) ELSE abs(value - (value + 0.04::DOUBLE)) < 0.001 END AS equal FROM events")
def union_equals(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", X.equals(EVENT_UNION, Ref("Event"), event_union(e, F.col("value")), event_union(e, F.col("value") + 0.04)).alias("equal"))


@query("WITH x AS (SELECT user_id, event_id, event_type, value, lag(event_type) OVER w AS p, lag(value) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, CASE WHEN p <> event_type THEN 'switch' WHEN abs(value - q) >= 0.001 THEN 'update' ELSE 'same' END AS diff, CASE WHEN p <> event_type THEN list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 END AS variant FROM x WHERE p IS NOT NULL")
def union_variant_diff(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("p", F.lag("event_type").over(w)).withColumn("q", F.lag("value").over(w)).where("p is not null")
    diff = D.union_diff(F.col("p"), F.col("event_type"), X.close(F.col("value"), F.col("q")))
    return e.select("user_id", "event_id", diff.alias("diff"), F.when(diff == "switch", X.ordinal(F.col("event_type"), EVENT_TYPES)).cast("int").alias("variant"))


# ---- numbers, sizes, bits


@query("SELECT o_orderpriority, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority) - 1 AS ordinal, CAST(ceil(log2(5)) AS INT) AS bits, count(*) AS n FROM orders GROUP BY ALL")
def enum_ordinal_bits(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority", X.ordinal(F.col("o_orderpriority"), PRIORITY).cast("int").alias("ordinal"), F.lit(X.bits_of(PRIORITY)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(floor(l_extendedprice / 0.25::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS quantum, CAST(floor(-l_extendedprice / 0.25::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS negative FROM lineitem")
def quantize_price(spark, d):
    p = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", p, X.quantum(p, 0.25).alias("quantum"), X.quantum(-p, 0.25).alias("negative"))


@query("WITH x AS (SELECT c_custkey, CAST(floor(c_acctbal * 100) AS BIGINT) AS cents FROM customer) SELECT c_custkey, cents, CASE WHEN cents >= 0 THEN 2 * cents ELSE -2 * cents - 1 END AS zigzag FROM x")
def zigzag_values(spark, d):
    cents = F.floor(F.col("c_acctbal") * 100).cast("long")
    return table(spark, d, "customer").select("c_custkey", cents.alias("cents"), X.zigzag(cents).alias("zigzag"))


@query("WITH x AS (SELECT c_custkey AS k, CAST(floor(c_acctbal * 100) AS BIGINT) AS c FROM customer), z AS (SELECT k, CASE WHEN c >= 0 THEN 2 * c ELSE -2 * c - 1 END AS z FROM x) SELECT k AS c_custkey, CAST(CASE WHEN k < 128 THEN 1 WHEN k < 16384 THEN 2 WHEN k < 2097152 THEN 3 WHEN k < 268435456 THEN 4 ELSE 5 END AS BIGINT) AS key_bytes, CAST(CASE WHEN z < 128 THEN 1 WHEN z < 16384 THEN 2 WHEN z < 2097152 THEN 3 WHEN z < 268435456 THEN 4 ELSE 5 END AS BIGINT) AS balance_bytes FROM z")
def varint_sizes(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.varint_size(F.col("c_custkey")).alias("key_bytes"), X.signed_size(F.floor(F.col("c_acctbal") * 100).cast("long")).alias("balance_bytes"))


@query("WITH x AS (SELECT o_orderstatus, o_orderkey AS k, 2 * o_custkey AS c, 2 * CAST(floor(o_totalprice / 0.01::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS p FROM orders) SELECT o_orderstatus, count(*) AS n, CAST(sum((CASE WHEN k < 128 THEN 1 WHEN k < 16384 THEN 2 WHEN k < 2097152 THEN 3 ELSE 4 END) + (CASE WHEN c < 128 THEN 1 WHEN c < 16384 THEN 2 WHEN c < 2097152 THEN 3 ELSE 4 END) + (CASE WHEN p < 128 THEN 1 WHEN p < 16384 THEN 2 WHEN p < 2097152 THEN 3 WHEN p < 268435456 THEN 4 ELSE 5 END)) AS BIGINT) AS data_bytes FROM x GROUP BY 1")
def encoded_size_estimate(spark, d):
    size = X.varint_size(F.col("o_orderkey")) + X.signed_size(F.col("o_custkey")) + X.signed_size(X.quantum(F.col("o_totalprice"), 0.01))
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("data_bytes"))


RUNS_SQL = "x AS (SELECT user_id, (event_type = 'click') AS bit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY ts, event_id) AS j FROM events), r AS (SELECT user_id, bit, CAST(min(i) - 1 AS BIGINT) AS start, count(*) AS n FROM x GROUP BY user_id, bit, i - j)"


def click_runs(spark, d):
    e = table(spark, d, "events").withColumn("bit", F.col("event_type") == "click")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    j = F.row_number().over(Window.partitionBy("user_id", "bit").orderBy("ts", "event_id"))
    return e.withColumn("i", i).withColumn("island", F.col("i") - j).groupBy("user_id", "bit", "island").agg((F.min("i") - 1).cast("long").alias("start"), F.count(F.lit(1)).alias("n")).drop("island")


@query(f"WITH {RUNS_SQL} SELECT user_id, bit, start, n FROM r")
def bool_rle_runs(spark, d):
    return click_runs(spark, d)


@query(f"WITH {RUNS_SQL} SELECT user_id, count(*) AS runs, CAST(1 + sum(CASE WHEN n = 1 THEN 1 WHEN n <= 3 THEN 3 WHEN n <= 5 THEN 4 WHEN n <= 13 THEN 7 WHEN n <= 269 THEN 12 END) AS BIGINT) AS bits FROM r GROUP BY 1")
def rle_bit_cost(spark, d):
    return click_runs(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), (F.sum(X.run_cost(F.col("n"))) + 1).alias("bits"))


@query("WITH f AS (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first) - 1 AS idx FROM f) SELECT c.conv_id, c.turn, CAST(idx AS INT) AS idx, c.turn = first AS sent, CAST(CASE WHEN c.turn = first THEN length(c.role) ELSE -idx - 1 END AS INT) AS code FROM conversations c JOIN g ON g.conv_id = c.conv_id AND g.role = c.role")
def string_dictionary_refs(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    first = F.min("turn").over(Window.partitionBy("conv_id", "role"))
    idx = (F.dense_rank().over(Window.partitionBy("conv_id").orderBy("first")) - 1).cast("int")
    out = c.withColumn("first", first).withColumn("idx", idx).withColumn("sent", F.col("turn") == F.col("first"))
    return out.select("conv_id", "turn", "idx", "sent", F.when(F.col("sent"), F.octet_length("role")).otherwise(-F.col("idx") - 1).cast("int").alias("code"))


# ---- coercion, defaults, JSON


@query(f"WITH {AB_SQL} SELECT o_orderkey, coalesce(custkey_a, 0) AS custkey, coalesce(status_a, 'F') AS status, coalesce(price_a, 0.0::DOUBLE) AS price FROM j")
def default_fill(spark, d):
    j = order_diff(spark, d, keep_same=True)
    s = ORDER_SCHEMA
    return j.select("o_orderkey", X.fill(F.col("old_o_custkey"), s, Int()).alias("custkey"), X.fill(F.col("old_o_orderstatus"), s, Ref("Status")).alias("status"), X.fill(F.col("old_o_totalprice"), s, Float(0.01)).alias("price"))


LOOSE_SQL = "x AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'true' WHEN 1 THEN 'FALSE' WHEN 2 THEN '1' WHEN 3 THEN '0' WHEN 4 THEN 'yes' WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN '42' ELSE '4.0' END AS v FROM events)"


def loose(spark, d):
    k = F.col("event_id") % 9
    v = F.when(k == 0, "true").when(k == 1, "FALSE").when(k == 2, "1").when(k == 3, "0").when(k == 4, "yes").when(k == 5, "").when(k == 6, None).when(k == 7, "42").otherwise("4.0")
    return table(spark, d, "events").select("event_id", "event_type", v.alias("v"))


@query(f"WITH {LOOSE_SQL} SELECT event_id, CASE WHEN lower(v) IN ('true', '1') THEN true WHEN lower(v) IN ('false', '0') THEN false END AS parsed FROM x")
def parse_bool(spark, d):
    return loose(spark, d).select("event_id", X.parse_boolean(F.col("v"), strict=False).alias("parsed"))


@query("SELECT event_id, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS ordinal, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN CASE WHEN event_id % 7 < 5 THEN ['click', 'error', 'purchase', 'signup', 'view'][event_id % 7 + 1] END END AS parsed FROM events")
def parse_enum(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id") % 3
    given = F.when(k == 0, F.col("event_type")).when(k == 1, F.upper("event_type")).otherwise((F.col("event_id") % 7).cast("string"))
    return e.select("event_id", X.ordinal(F.col("event_type"), EVENT_TYPES).cast("int").alias("ordinal"), X.parse_enum(given, EVENT_TYPES, strict=False).alias("parsed"))


@query(f"WITH {LOOSE_SQL}, y AS (SELECT event_id, CASE WHEN v = '' THEN 0 WHEN TRY_CAST(v AS DOUBLE) = floor(TRY_CAST(v AS DOUBLE)) AND v NOT IN ('true', 'FALSE') THEN CAST(TRY_CAST(v AS DOUBLE) AS BIGINT) END AS n FROM x) SELECT event_id, n AS any_int, CASE WHEN n BETWEEN 1 AND 10 THEN n END AS bounded FROM y")
def parse_int_bounds(spark, d):
    v = F.col("v")
    return loose(spark, d).select("event_id", X.parse_int(v, strict=False).alias("any_int"), X.parse_int(v, 1, 10, strict=False).alias("bounded"))


@query(f"WITH {LOOSE_SQL} SELECT event_id, nullif(v, '') AS present, TRY_CAST(nullif(v, '') AS DOUBLE) AS number FROM x")
def parse_optional(spark, d):
    return loose(spark, d).select("event_id", X.parse_optional(F.col("v")).alias("present"), X.parse_float(X.parse_optional(F.col("v")), strict=False).alias("number"))


PROPS = Schema({"Props": Object((("k", Int(0, 1000)), ("missing", Optional(String()))))})


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS rendered FROM events")
def json_props_roundtrip(spark, d):
    e = table(spark, d, "events").select("event_id", parse_json(PROPS, "Props", F.col("props")).alias("p"))
    return e.select("event_id", "p.k", render_json(PROPS, "Props", F.col("p")).alias("rendered"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'Click' ELSE 'Other' END AS variant, CASE WHEN event_type <> 'click' THEN event_type END AS kind, event_type = 'click' AS click_set FROM events")
def json_union_roundtrip(spark, d):
    e = table(spark, d, "events")
    text = render_json(EVENT_UNION, "Event", event_union(e, F.col("value")))
    parsed = e.select("event_id", parse_json(EVENT_UNION, "Event", text).alias("u"))
    return parsed.select("event_id", F.col("u._type").alias("variant"), F.col("u.Other.kind").alias("kind"), F.col("u.Click").isNotNull().alias("click_set"))


# ---- versions and history


@query("WITH x AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (p IS NOT NULL AND p <> event_type) AS transitions FROM x GROUP BY 1")
def transitions_per_entity(spark, d):
    e = ticks(spark, d).withColumn("p", F.lag("event_type").over(H.ordered(["user_id"], ["tick"])))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce((F.col("p") != F.col("event_type")).cast("long"), F.lit(0))).alias("transitions"))


@query("SELECT user_id, event_type, arg_max(value, struct_pack(ts, event_id)) AS value, CAST(max(event_id) AS BIGINT) AS last_id FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1, 2")
def state_as_of(spark, d):
    e = table(spark, d, "events")
    out = H.state_as_of(e, ["user_id", "event_type"], ["value", "event_id"], ["ts", "event_id"], F.col("ts") <= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return out.select("user_id", "event_type", "value", F.col("event_id").alias("last_id"))


@query(f"WITH {LOG_SQL} SELECT user_id, event_id, item, op, version FROM log")
def changelog_versions(spark, d):
    return H.with_versions(event_log(spark, d), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "item", "op", "version")


@query(f"WITH {LOG_SQL} SELECT user_id, max(version) AS version FROM log GROUP BY 1")
def entity_versions(spark, d):
    items = H.entity_versions(H.with_versions(event_log(spark, d), ["user_id"], ["ts", "event_id"]), ["user_id", "item"])
    return H.entity_versions(items, ["user_id"])


@query(f"WITH {LOG_SQL} SELECT user_id, item, max(version) AS version, count(*) AS changes FROM log WHERE version > 20 GROUP BY 1, 2")
def versioned_changes_since(spark, d):
    return H.changed_since(H.with_versions(event_log(spark, d), ["user_id"], ["ts", "event_id"]), ["user_id", "item"], "version", F.lit(20))


@query(f"WITH {LOG_SQL}, base AS (SELECT user_id, item, arg_max(op, version) AS op FROM log WHERE version <= 20 GROUP BY 1, 2), after AS (SELECT user_id, item, arg_max(op, version) AS op FROM log WHERE version > 20 GROUP BY 1, 2) SELECT a.user_id, a.item, CASE WHEN a.op = 'del' THEN 'del' WHEN b.op = 'set' THEN 'upd' ELSE 'add' END AS kind FROM after a LEFT JOIN base b ON a.user_id = b.user_id AND a.item = b.item WHERE NOT (a.op = 'del' AND b.op IS DISTINCT FROM 'set')")
def versioned_map_diff(spark, d):
    log = H.with_versions(event_log(spark, d), ["user_id"], ["ts", "event_id"])
    base = log.where("version <= 20").groupBy("user_id", "item").agg(F.max_by("op", "version").alias("op")).where("op = 'set'")
    return H.classify_since(log, ["user_id", "item"], "op", "version", F.lit(20), base)


@query(f"WITH {LOG_SQL}, s AS (SELECT min(version) AS oldest FROM log WHERE event_id % 1000 = 7 AND version > 5) SELECT user_id, event_id, op, version FROM log WHERE op <> 'del' OR version >= (SELECT oldest FROM s)")
def tombstone_prune(spark, d):
    log = H.with_versions(event_log(spark, d), ["user_id"], ["ts", "event_id"])
    snapshots = log.where("event_id % 1000 = 7 and version > 5").select(F.col("version").alias("at"))
    return H.prune_tombstones(log, "op", "version", snapshots, "at").select("user_id", "event_id", "op", "version")


@query(f"WITH {LOG_SQL}, c(client, baseline) AS (VALUES (0, 0), (1, 10), (2, 25), (3, 40)) SELECT CAST(client AS INT) AS client, user_id, count(DISTINCT item) AS items, max(version) AS version FROM c JOIN log ON version > baseline GROUP BY 1, 2")
def multi_baseline_diff(spark, d):
    log = H.with_versions(event_log(spark, d), ["user_id"], ["ts", "event_id"])
    baselines = F.explode(F.array(*[F.struct(F.lit(c).alias("client"), F.lit(b).alias("baseline")) for c, b in ((0, 0), (1, 10), (2, 25), (3, 40))]))
    # the clients are few: each row meets those below its version
    per = log.select("user_id", "item", "version", baselines.alias("c")).where(F.col("version") > F.col("c.baseline"))
    latest = per.groupBy("c.client", "user_id", "item").agg(F.max("version").alias("version"))
    return latest.groupBy("client", "user_id").agg(F.count(F.lit(1)).alias("items"), F.max("version").alias("version"))


@query(f"WITH {TICKS_SQL}, h AS (SELECT DISTINCT tick FROM t), c AS (SELECT user_id AS client, max(tick) // 2 AS acked FROM t GROUP BY 1) SELECT client, acked, CASE WHEN h.tick IS NULL THEN 'full' ELSE 'diff' END AS message, h.tick AS baseline FROM c LEFT JOIN h ON h.tick = acked")
def baseline_full_or_diff(spark, d):
    """A difference where the history, the ticks of all users, holds what the client acknowledged."""
    t = ticks(spark, d)
    clients_ = t.groupBy(F.col("user_id").alias("client")).agg(F.floor(F.max("tick") / 2).alias("acked"))
    return H.choose_baseline(clients_, t, "acked", "tick")


@query(f"WITH {TICKS_SQL}, x AS (SELECT user_id, tick, lag(tick) OVER (PARTITION BY user_id ORDER BY tick) AS baseline FROM t) SELECT user_id, tick, baseline, CASE WHEN baseline IS NULL THEN 'full' ELSE 'diff' END AS message FROM x")
def last_message_baseline(spark, d):
    return H.message_plan(ticks(spark, d).select("user_id", "tick"), ["user_id"], "tick")


@query("SELECT time_bucket(INTERVAL 5 SECOND, ts) AS start, count(*) AS messages, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY 1")
def interval_stats(spark, d):
    return H.bandwidth(table(spark, d, "events"), "ts", F.octet_length("props"), "5 seconds")


@query(f"WITH {TICKS_SQL} SELECT user_id, tick, event_id FROM t QUALIFY tick >= max(tick) OVER (PARTITION BY user_id) - 15")
def history_prune(spark, d):
    return H.prune_history(ticks(spark, d), "tick", 15, ["user_id"]).select("user_id", "tick", "event_id")


@query(f"WITH {TICKS_SQL}, r AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN tick - 2 ELSE tick END AS sent, tick FROM t) SELECT user_id, event_id, sent FROM r QUALIFY coalesce(sent > max(sent) OVER (PARTITION BY user_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)")
def input_dedupe(spark, d):
    t = ticks(spark, d).withColumn("sent", F.when(F.col("event_id") % 3 == 0, F.col("tick") - 2).otherwise(F.col("tick")))
    return H.dedupe_inputs(t, ["user_id"], ["tick"], "sent").select("user_id", "event_id", "sent")


@query(f"WITH {TICKS_SQL} SELECT user_id, tick, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY tick ROWS 4 PRECEDING), ',') AS sent FROM t")
def redundant_window(spark, d):
    return H.redundant_window(ticks(spark, d), ["user_id"], ["tick"], "event_id", 5).select("user_id", "tick", F.array_join(F.col("sent").cast("array<string>"), ",").alias("sent"))


@query(f"WITH {TICKS_SQL}, s AS (SELECT user_id, epoch_us(ts) AS at, value FROM t), w AS (SELECT user_id, s.at + 1800000000 AS at FROM s), x AS (SELECT w.user_id, w.at, s.at AS f, s.value AS v FROM w ASOF JOIN s ON s.user_id = w.user_id AND s.at <= w.at) SELECT x.user_id, x.at, round(CASE WHEN s.at IS NULL THEN v ELSE v + (s.value - v) * ((x.at - f)::DOUBLE / (s.at - f)) END, 6) AS value FROM x ASOF LEFT JOIN s ON s.user_id = x.user_id AND s.at > x.at")
def interpolate_asof(spark, d):
    """Values half an hour after every tick."""
    t = ticks(spark, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    wanted = t.select("user_id", (F.col("t") + 1_800_000_000).alias("at"))
    return H.interpolate(t, wanted, ["user_id"], "t", "value", "at").select("user_id", "at", F.round("value", 6).alias("value"))


@query(f"WITH {TICKS_SQL}, k AS (SELECT user_id, tick + tick // 6 AS tick FROM t), r AS (SELECT user_id, tick, tick - lag(tick) OVER (PARTITION BY user_id ORDER BY tick) - 1 AS g FROM k), x AS (SELECT user_id, tick, coalesce(g, 0) AS gap, sum(coalesce(g, 0)) OVER w AS lost, count(*) OVER w AS received FROM r WINDOW w AS (PARTITION BY user_id ORDER BY tick ROWS 99 PRECEDING)) SELECT user_id, tick, gap, CAST(lost AS BIGINT) AS lost, received, round(100.0 * lost / (received + lost), 6)::DOUBLE AS loss_pct FROM x")
def loss_window_100(spark, d):
    """Every seventh message of a user is missing from the ticks."""
    t = ticks(spark, d).select("user_id", (F.col("tick") + F.floor(F.col("tick") / 6)).alias("tick"))
    return H.loss_window(t, ["user_id"], "tick").withColumn("loss_pct", F.round("loss_pct", 6))


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS messages, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY 1, 2")
def bandwidth_tumbling(spark, d):
    return H.bandwidth(table(spark, d, "events"), "ts", F.octet_length("props"), "1 day", ["user_id"])


@query(f"WITH {TICKS_SQL} SELECT user_id, tick, avg(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY tick ROWS UNBOUNDED PRECEDING) AS mean_cents FROM t")
def running_mean(spark, d):
    t = ticks(spark, d).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return H.running_mean(t, ["user_id"], ["tick"], "cents").select("user_id", "tick", F.col("mean").alias("mean_cents"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def cascade_delete(spark, d):
    return H.drop_owned(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), "c_custkey")


@query("SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer QUALIFY place <= 5")
def scoreboard_topk(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal", F.row_number().over(w).cast("long").alias("place")).where("place <= 5")


@query("SELECT user_id, event_type, arg_max(event_id, struct_pack(ts, event_id)) AS event_id, arg_max(value, struct_pack(ts, event_id)) AS value FROM events GROUP BY 1, 2")
def latest_per_key(spark, d):
    return H.latest(table(spark, d, "events"), ["user_id", "event_type"], ["event_id", "value"], ["ts", "event_id"])


# ---- space and motion

POINTS_SQL = "p AS (SELECT c_custkey AS k, c_nationkey AS g, c_acctbal AS x, CAST((c_custkey * 7919) % 10000 AS DOUBLE) AS y FROM customer)"


def points(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("x"), ((F.col("c_custkey") * 7919) % 10000).cast("double").alias("y"))


@query(f"WITH {POINTS_SQL} SELECT a.k AS key_a, b.k AS key_b, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 4) AS d2 FROM p a JOIN p b ON a.k < b.k AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 40000 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) > 0")
def proximity_pairs(spark, d):
    # rounded as DuckDB does it; Spark's round() makes a decimal of each of the many pairs' d2
    return S.near_pairs(points(spark, d), "k", "x", "y", 200.0).withColumn("d2", F.floor(F.col("d2") * 1e4 + 0.5) / 1e4)


@query(f"WITH {POINTS_SQL}, s AS (SELECT s_suppkey, s_nationkey AS g, s_acctbal AS sx FROM supplier) SELECT s_suppkey, k FROM s JOIN p ON p.g = s.g WHERE abs(x - sx) < 500 QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY k) = 1")
def first_match_theta(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("sx"))
    return S.first_match(s, "s_suppkey", points(spark, d), "k", ["g"], F.abs(F.col("x") - F.col("sx")) < 500, [F.col("k")])


@query(f"WITH {POINTS_SQL} SELECT k, x, y FROM p WHERE x > 0 AND y BETWEEN 1000 AND 9000")
def expiry_filter(spark, d):
    return S.unexpired(points(spark, d), F.col("x"), F.col("y").between(1000, 9000)).select("k", "x", "y")


@query(f"WITH {POINTS_SQL} SELECT k, round(greatest(0.0, least(10000.0, x + y * 0.5)), 6)::DOUBLE AS moved, round(CASE WHEN x * x + y * y > 0 THEN x / sqrt(x * x + y * y) ELSE 0 END, 6)::DOUBLE AS ux FROM p")
def clamp_projection(spark, d):
    p = points(spark, d)
    return p.select("k", F.round(S.move(F.col("x"), F.col("y"), 0.5, 0, 10000), 6).alias("moved"), F.round(S.unit_vector(F.col("x"), F.col("y"))[0], 6).alias("ux"))


# ---- binary columns


def order_states(orders: DataFrame, name: str) -> DataFrame:
    return orders.select("o_orderkey", F.struct(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority")).alias(name))


@query(f"WITH {AB_SQL} SELECT o_orderkey, o_custkey AS custkey, o_orderstatus AS status, round(CAST(floor(o_totalprice / 0.01::DOUBLE + 0.5::DOUBLE) AS BIGINT) * 0.01::DOUBLE, 4) AS price, o_orderpriority AS priority FROM a")
def codec_roundtrip_orders(spark, d):
    c = StateColumns(ORDER_SCHEMA, "Order")
    out = order_states(spread(orders_a(spark, d)), "s").select("o_orderkey", c.encode(F.col("s")).alias("bytes")).select("o_orderkey", c.decode(F.col("bytes")).alias("s"))
    return out.select("o_orderkey", "s.custkey", "s.status", F.round("s.price", 4).alias("price"), "s.priority")


@query(f"WITH {AB_SQL}, q AS (SELECT *, CAST(floor(price_a / 0.01::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS qa, CAST(floor(price_b / 0.01::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS qb FROM j WHERE ina AND inb) SELECT o_orderkey, status_b AS status, round(CASE WHEN qa = qb THEN price_a ELSE qb * 0.01::DOUBLE END, 4) AS price, priority_b AS priority FROM q")
def codec_diff_roundtrip(spark, d):
    c = StateColumns(ORDER_SCHEMA, "Order")
    both = order_states(spread(orders_a(spark, d)), "a").join(order_states(orders_b(spark, d), "b"), "o_orderkey")
    out = both.select("o_orderkey", "a", c.encode_diff(F.col("a"), F.col("b")).alias("change")).select("o_orderkey", c.decode_diff(F.col("a"), F.col("change")).alias("s"))
    return out.select("o_orderkey", "s.status", F.round("s.price", 4).alias("price"), "s.priority")


# ---- streams

FULL_EVERY, LOST = 20, 13


def client_messages(spark, d) -> DataFrame:
    """(client, tick, baseline, payload): states of users by tick, a full one every 20 ticks, else the change since the last tick; a thirteenth gets lost."""
    c = StateColumns(PLAYER_SCHEMA, "Player")
    w = H.ordered(["user_id"], ["tick"])
    t = ticks(spark, d)
    state = F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("last"), F.col("tick").alias("total"), F.col("value").alias("value"))
    t = t.withColumn("state", state).withColumn("before", F.lag("state").over(w)).withColumn("full", (F.col("tick") % FULL_EVERY == 1) | F.col("before").isNull())
    t = t.withColumn("whole", c.encode(F.col("state"))).withColumn("change", c.encode_diff(F.coalesce("before", "state"), F.col("state")))
    out = t.where(F.col("event_id") % LOST != 0)
    return out.select(F.col("user_id").alias("client"), "tick", F.when(F.col("full"), 0).otherwise(F.col("tick") - 1).cast("long").alias("baseline"), F.when(F.col("full"), F.col("whole")).otherwise(F.col("change")).alias("payload"))


@query(f"WITH {TICKS_SQL}, x AS (SELECT *, sum((event_id % {LOST} = 0)::INT) OVER (PARTITION BY user_id, (tick - 1) // {FULL_EVERY} ORDER BY tick ROWS UNBOUNDED PRECEDING) AS gone FROM t) SELECT user_id AS client, count(*) AS received, count(*) FILTER (gone = 0) AS applied, count(*) FILTER (gone > 0) AS dropped, coalesce(max(tick) FILTER (gone = 0), 0) AS last_tick, arg_max(event_type, tick) FILTER (gone = 0) AS last_event FROM x WHERE event_id % {LOST} <> 0 GROUP BY 1")
def stream_client_fold(spark, d):
    """The client fold as a stream: messages written as files, read as a stream, folded with keyed state, result reread."""
    source, key = scratch(spark, "messages"), "spark.sql.streaming.stateStore.providerClass"
    client_messages(spark, d).write.parquet(source)
    before = spark.conf.get(key, None)
    spark.conf.set(key, clients.ROCKSDB)
    try:
        stream = spark.readStream.schema("client long, tick long, baseline long, payload binary").parquet(source)
        out = clients.run_to_table(clients.fold_clients(stream, PLAYER_SCHEMA, "Player"), scratch(spark, "folded"), scratch(spark, "fold-checkpoint"))
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    states = StateColumns(PLAYER_SCHEMA, "Player")
    out = out.withColumn("s", states.decode(F.col("state")))
    n = F.count(F.lit(1))
    return out.groupBy("client").agg(n.alias("received"), F.count_if(F.col("outcome") == "applied").alias("applied"), F.count_if(F.col("outcome") == "dropped").alias("dropped"), F.coalesce(F.max(F.when(F.col("outcome") == "applied", F.col("tick"))), F.lit(0)).alias("last_tick"), F.max_by("s.last", F.when(F.col("outcome") == "applied", F.col("tick"))).alias("last_event"))


@query(f"WITH {TICKS_SQL}, x AS (SELECT *, sum((event_id % {LOST} = 0)::INT) OVER (PARTITION BY user_id, (tick - 1) // {FULL_EVERY} ORDER BY tick ROWS UNBOUNDED PRECEDING) AS gone FROM t) SELECT user_id AS client, count(*) FILTER (gone = 0 AND event_id % {LOST} <> 0) AS applied FROM x GROUP BY 1")
def batch_client_fold(spark, d):
    """The same fold over a table: each client's messages decoded and folded in order of tick."""
    folded = clients.fold_table(client_messages(spark, d), PLAYER_SCHEMA, "Player")
    applied = folded.groupBy("client").agg(F.count_if(F.col("outcome") == "applied").alias("applied"))
    everyone = table(spark, d, "events").select(F.col("user_id").alias("client")).distinct()
    return everyone.join(applied, "client", "left").select("client", F.coalesce("applied", F.lit(0).cast("long")).alias("applied"))


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS messages, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_bandwidth_tumbling(spark, d):
    """Event-time windows with a watermark.

    Update mode: a batch writes the windows that it changed, the last batch's row of a window counts, and the watermark
    lets go of windows that can't change any more.
    """
    e = table(spark, d, "events")
    source = scratch(spark, "events")
    e.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(source)
    windows = clients.tumbling(stream, "ts", "1 day", "1 hour", F.col("value"), ("event_type",))
    out = scratch(spark, "windows")
    query_ = windows.writeStream.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch={k}")).option("checkpointLocation", scratch(spark, "window-checkpoint")).outputMode("update").trigger(availableNow=True).start()
    clients.finish(query_)
    changed = spark.read.schema(T.StructType([*windows.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    result = H.latest(changed, ["event_type", "start"], ["messages", "total"], ["batch"])
    return result.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "messages", F.round("total", 4).alias("total"))


from tidemark.plans import wire_queries  # noqa: E402, F401  (registers its queries, with names defined above)
