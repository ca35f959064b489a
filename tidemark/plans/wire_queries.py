"""Queries over loose values, the binary form's kinds of fields, and datagrams; registered with the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.functions.schema import Ref, parse_schema
from tidemark.operators import history as H
from tidemark.plans.catalog import EVENT_UNION, event_union, order_states, query
from tidemark.plans.inputs import AB_SQL, LOG_SQL, ORDER_SCHEMA, event_log, orders_a, orders_b, table
from tidemark.sources.codec import StateColumns, spread
from tidemark.streaming import clients

LOOSE_SQL = "x AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) || '.26' WHEN 1 THEN 'NaN' WHEN 2 THEN CAST(event_id AS VARCHAR) || 'e1' WHEN 3 THEN '12abc' WHEN 4 THEN 'Infinity' END AS t FROM events)"


@query(f"WITH {LOOSE_SQL}, n AS (SELECT *, TRY_CAST(t AS DOUBLE) AS d FROM x) SELECT event_id, t AS text, CASE WHEN isfinite(d) THEN d END AS number, CASE WHEN isfinite(d) THEN round(floor(d / 0.5 + 0.5) * 0.5, 4) END AS quantized FROM n")
def parse_loose_numbers(spark, d):
    """Text and finite numbers from loose values, quantized on request; what is no number is null."""
    i = F.col("event_id")
    text = F.when(i % 6 == 0, F.concat(i.cast("string"), F.lit(".26"))).when(i % 6 == 1, "NaN").when(i % 6 == 2, F.concat(i.cast("string"), F.lit("e1"))).when(i % 6 == 3, "12abc").when(i % 6 == 4, "Infinity")
    x = table(spark, d, "events").select("event_id", text.alias("t"))
    return x.select("event_id", X.parse_string(F.col("t")).alias("text"), X.parse_float(F.col("t"), strict=False).alias("number"), F.round(X.parse_float(F.col("t"), strict=False, precision=0.5), 4).alias("quantized"))


LOOSE = parse_schema(
    """
Loose:
  name: string
  ids: uint[]
  scores: <string, float>
"""
)


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS name, CAST(event_id + event_id + 1 AS BIGINT) AS id_sum, 2 AS n_ids, event_id % 3 + 1 AS n_scores, 'a,' || CASE WHEN event_id % 3 > 0 THEN 'b,' ELSE '' END || CASE WHEN event_id % 3 > 1 THEN 'c,' ELSE '' END AS names, (event_id % 3 + 1) * 1.5::DOUBLE AS score_sum FROM events")
def parse_collections(spark, d):
    """Arrays and maps of text as typed ones; other fields are passed over, a missing one is null where that isn't an error."""
    i = F.col("event_id")
    scores = F.map_from_arrays(F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (i % 3 + 1).cast("int")), F.array_repeat(F.lit("1.5"), (i % 3 + 1).cast("int")))
    loose = F.struct(F.when(i % 5 != 0, F.col("event_type")).alias("name"), F.array(i.cast("string"), (i + 1).cast("string")).alias("ids"), scores.alias("scores"), F.lit("x").alias("not_in_the_schema"))
    x = table(spark, d, "events").select("event_id", X.validate(LOOSE, Ref("Loose"), loose, strict=False).alias("v"))
    total = F.aggregate("v.ids", F.lit(0).cast("long"), lambda n, k: n + k)
    names = F.concat_ws("", F.transform(F.array_sort(F.map_keys("v.scores")), lambda k: F.concat(k, F.lit(","))))
    return x.select("event_id", "v.name", total.alias("id_sum"), F.size("v.ids").alias("n_ids"), F.size("v.scores").cast("long").alias("n_scores"), names.alias("names"), F.aggregate(F.map_values("v.scores"), F.lit(0.0), lambda n, k: n + k.cast("double")).alias("score_sum"))


KINDS = parse_schema(
    """
Node:
  id: int(min=5)
  on: boolean
  off: boolean?
  weight: float
  label: string
  marks: boolean[]
  counts: <string, int>
  next: Node?
"""
)


def kinds_state(new: bool):
    """A state with every kind of field; the new one differs from the old in fields that depend on the event."""
    i, v, step = F.col("event_id"), F.col("value"), 1 if new else 0
    on = (i % 2 == 0) != (F.lit(new) & (i % 3 == 0))
    off = F.when(i % 4 == 0, F.lit(None).cast("boolean")).otherwise((i % 4 == 1) != (F.lit(new) & (i % 5 == 0)))
    marks = F.transform(F.sequence(F.lit(0), (i % 3 + step).cast("int")), lambda k: (k + i + F.when(k == 0, step).otherwise(0)) % 2 == 0)
    # a key that goes, one that changes, one that stays, one that comes
    held = F.array(*[F.struct(F.lit(k).alias("key"), n.cast("long").alias("value")) for k, n in (("d" if new else "a", i), ("b", i + step), ("c", F.lit(7)))])
    label = F.concat(F.col("event_type"), F.lit(" é😀"), F.when(i % 2 == 1, F.lit(str(step))).otherwise(""))
    plain = [(i + 5).alias("id"), on.alias("on"), off.alias("off"), (v + 2 * step).cast("float").alias("weight"), label.alias("label"), marks.alias("marks"), F.map_from_entries(held).alias("counts")]
    inner = [F.lit(9).cast("long").alias("id"), (~on).alias("on"), F.lit(None).cast("boolean").alias("off"), F.lit(0.5 + step).cast("float").alias("weight"), label.alias("label"), F.array().cast("array<boolean>").alias("marks"), F.create_map().cast("map<string,bigint>").alias("counts")]
    return F.struct(*plain, F.when(i % 7 != 0, F.struct(*inner)).alias("next"))


def kinds_sql(step: int) -> str:
    """The same state, flat."""
    turn = "event_id % 3 = 0" if step else "false"
    turn_off = "event_id % 5 = 0" if step else "false"
    return f"""SELECT event_id, event_id + 5 AS id, (event_id % 2 = 0) <> ({turn}) AS is_on, CASE WHEN event_id % 4 <> 0 THEN (event_id % 4 = 1) <> ({turn_off}) END AS off,
      CAST(CAST(value + {2 * step} AS FLOAT) AS DOUBLE) AS weight, event_type || ' é😀' || CASE WHEN event_id % 2 = 1 THEN '{step}' ELSE '' END AS label,
      list_aggregate(list_transform(range(event_id % 3 + {step} + 1), lambda k: CASE WHEN (k + event_id + CASE WHEN k = 0 THEN {step} ELSE 0 END) % 2 = 0 THEN '1' ELSE '0' END), 'string_agg', '') AS marks,
      CASE WHEN {step} = 0 THEN 'a' || event_id || ',b' || event_id || ',c7' ELSE 'b' || (event_id + 1) || ',c7,d' || event_id END AS counts,
      CASE WHEN event_id % 7 <> 0 THEN NOT ((event_id % 2 = 0) <> ({turn})) END AS next_on, CASE WHEN event_id % 7 <> 0 THEN 0.5::DOUBLE + {step} END AS next_weight FROM events"""


def kinds_flat(s: str):
    counts = F.concat_ws(",", F.transform(F.array_sort(F.map_entries(f"{s}.counts")), lambda e: F.concat(e["key"], e["value"].cast("string"))))
    marks = F.concat_ws("", F.transform(F.col(f"{s}.marks"), lambda m: F.when(m, "1").otherwise("0")))
    return [F.col(f"{s}.id").alias("id"), F.col(f"{s}.on").alias("is_on"), F.col(f"{s}.off").alias("off"), F.col(f"{s}.weight").cast("double").alias("weight"), F.col(f"{s}.label").alias("label"), marks.alias("marks"), counts.alias("counts"), F.col(f"{s}.next.on").alias("next_on"), F.col(f"{s}.next.weight").cast("double").alias("next_weight")]


@query(kinds_sql(0))
def codec_roundtrip_kinds(spark, d):
    """Bounded integers, booleans, floats, text outside ASCII, arrays, maps, optionals and a type within itself, as bytes and back."""
    c = StateColumns(KINDS, "Node", depth=2)
    e = spread(table(spark, d, "events")).select("event_id", kinds_state(False).alias("s"))
    e = e.select("event_id", c.encode(F.col("s")).alias("bytes")).select("event_id", c.decode(F.col("bytes")).alias("s"))
    return e.select("event_id", *kinds_flat("s"))


@query(kinds_sql(1))
def codec_diff_kinds(spark, d):
    """What a receiver of the old state makes of the difference: flips, changed places, keys that go and come, nested states."""
    c = StateColumns(KINDS, "Node", depth=2)
    e = spread(table(spark, d, "events")).select("event_id", kinds_state(False).alias("a"), kinds_state(True).alias("b"))
    e = e.select("event_id", "a", c.encode_diff(F.col("a"), F.col("b")).alias("change")).select("event_id", c.decode_diff(F.col("a"), F.col("change")).alias("s"))
    return e.select("event_id", *kinds_flat("s"))


@query("SELECT event_id, event_type = 'click' AS was_click, event_id % 3 = 0 AS is_click, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_type = 'click' AND floor(value / 0.1::DOUBLE + 0.5::DOUBLE) = floor((value + 1) / 0.1::DOUBLE + 0.5::DOUBLE) THEN round(value, 4) ELSE round(floor((value + 1) / 0.1::DOUBLE + 0.5::DOUBLE) * 0.1::DOUBLE, 4) END ELSE round(CAST(CAST(value + 1 AS FLOAT) AS DOUBLE), 4) END AS value FROM events")
def codec_diff_root_union(spark, d):
    """Differences of states that are a union: of one variant, or from one to the other."""
    c = StateColumns(EVENT_UNION, "Event")
    old = event_union(None, F.col("value"))
    click, v = F.col("event_id") % 3 == 0, F.col("value") + 1
    new = F.struct(F.when(click, "Click").otherwise("Other").alias("_type"), F.when(click, F.struct(v.alias("value"))).alias("Click"), F.when(~click, F.struct(F.col("event_type").alias("kind"), v.alias("value"))).alias("Other"))
    e = spread(table(spark, d, "events")).select("event_id", old.alias("a"), new.alias("b"))
    e = e.select("event_id", "a", c.encode_diff(F.col("a"), F.col("b")).alias("change")).select("event_id", "a", c.decode_diff(F.col("a"), F.col("change")).alias("s"))
    return e.select("event_id", (F.col("a._type") == "Click").alias("was_click"), (F.col("s._type") == "Click").alias("is_click"), F.round(F.coalesce(F.col("s.Click.value").cast("double"), F.col("s.Other.value").cast("double")), 4).alias("value"))


@query(f"WITH {LOG_SQL}, p AS (SELECT user_id, event_id % 8 AS pos, max(version) AS version, count(*) AS changes FROM log WHERE version > 20 GROUP BY ALL), n AS (SELECT user_id, count(*) % 6 + 3 AS size FROM log GROUP BY 1) SELECT user_id, pos, p.version, changes FROM p JOIN n USING (user_id) WHERE pos < size")
def versioned_array_diff(spark, d):
    """Places of a user's array that changed after a version and lie within both its old and its new length."""
    log = H.with_versions(event_log(spark, d), ["user_id"], ["ts", "event_id"]).withColumn("pos", F.col("event_id") % 8)
    sizes = log.groupBy("user_id").agg((F.count(F.lit(1)) % 6 + 3).alias("size"))
    return H.changed_since(log, ["user_id", "pos"], "version", F.lit(20)).join(sizes, "user_id").where("pos < size").drop("size")


def _varint_sql(v: str) -> str:
    return f"(CASE {' '.join(f'WHEN {v} < {1 << 7 * k} THEN {k}' for k in range(1, 9))} ELSE 9 END)"


def _zigzag_sql(v: str) -> str:
    return f"(CASE WHEN {v} >= 0 THEN 2 * {v} ELSE -2 * {v} - 1 END)"


def _text_sql(v: str) -> str:
    return f"(CASE WHEN {v} IS NULL THEN 0 ELSE {_varint_sql(f'(2 * strlen({v}))')} + strlen({v}) END)"


_STATUS_BITS = "(CASE {0} WHEN 'F' THEN '00' WHEN 'O' THEN '01' ELSE '10' END)"
SIZES_SQL = f"""WITH {AB_SQL},
q AS (SELECT *, CAST(floor(price_a / 0.01::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS qa, CAST(floor(price_b / 0.01::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS qb FROM j WHERE ina AND inb),
s AS (SELECT o_orderkey,
  {_varint_sql("o_orderkey")} + {_varint_sql(_zigzag_sql("custkey_b"))} + {_varint_sql(_zigzag_sql("qb"))} + {_text_sql("priority_b")} AS full_data,
  {_STATUS_BITS.format("status_b")} || CASE WHEN priority_b IS NULL THEN '0' ELSE '1' END AS full_bits,
  CASE WHEN qa <> qb THEN {_varint_sql(_zigzag_sql("qb"))} ELSE 0 END + CASE WHEN priority_c THEN {_text_sql("priority_b")} ELSE 0 END AS diff_data,
  CASE WHEN status_c OR qa <> qb OR priority_c THEN '100' || CASE WHEN status_c THEN '1' || {_STATUS_BITS.format("status_b")} ELSE '0' END || CASE WHEN qa <> qb THEN '1' ELSE '0' END
    || CASE WHEN NOT priority_c THEN '0' WHEN priority_a IS NULL THEN '1' WHEN priority_b IS NULL THEN '10' ELSE '11' END ELSE '0' END AS diff_bits FROM q),
c AS (SELECT *, list_sum(list_transform(regexp_extract_all(full_bits, '0+|1+'), lambda r: CASE WHEN len(r) = 1 THEN 1 WHEN len(r) < 4 THEN 3 WHEN len(r) < 6 THEN 4 ELSE 7 END)) + 1 AS full_code,
  list_sum(list_transform(regexp_extract_all(diff_bits, '0+|1+'), lambda r: CASE WHEN len(r) = 1 THEN 1 WHEN len(r) < 4 THEN 3 WHEN len(r) < 6 THEN 4 ELSE 7 END)) + 1 AS diff_code FROM s)
SELECT o_orderkey, CAST(full_data + (full_code + 7) // 8 + 1 AS INT) AS full_bytes, CAST(diff_data + (diff_code + 7) // 8 + 1 AS INT) AS diff_bytes FROM c"""


@query(SIZES_SQL)
def codec_sizes(spark, d):
    """Bytes of full states and of differences; a difference is never much larger than the state."""
    c = StateColumns(ORDER_SCHEMA, "Order")
    both = order_states(spread(orders_a(spark, d)), "a").join(order_states(orders_b(spark, d), "b"), "o_orderkey")
    return both.select("o_orderkey", F.length(c.encode(F.col("b"))).alias("full_bytes"), F.length(c.encode_diff(F.col("a"), F.col("b"))).alias("diff_bytes"))


@query("SELECT event_id, event_id % 70000 AS baseline, props AS payload, strlen(props) + 4 AS size FROM events")
def datagram_frames(spark, d):
    """Payloads behind the four bytes of their baseline's tick, and read back."""
    e = table(spark, d, "events").select("event_id", clients.frame(F.col("event_id") % 70000, F.col("props").cast("binary")).alias("datagram"))
    baseline, payload = clients.unframe(F.col("datagram"))
    return e.select("event_id", baseline.alias("baseline"), payload.cast("string").alias("payload"), F.octet_length("datagram").cast("long").alias("size"))
