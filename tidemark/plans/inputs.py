"""Derived inputs of the queries, in Spark and in SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.schema import parse_schema

STATUS = ("F", "O", "P")
PRIORITY = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

ORDER_SCHEMA = parse_schema(
    """
Status: [F, O, P]
Order:
  key: uint
  custkey: int
  status: Status
  price: float(precision=0.01)
  priority: string?
"""
)

PLAYER_SCHEMA = parse_schema(
    """
Player:
  user: uint
  last: string
  total: int
  value: float(precision=0.01)
"""
)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one of the cluster; where none is set, a temporary one if the master is local, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-scratch-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root}/tidemark-{uuid.uuid4().hex}-{name}"


def orders_a(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, d, "orders").where(key % 10 != 3).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.when(key % 9 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))


def orders_b(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    price = F.col("o_totalprice") + F.when(key % 5 == 0, 1.0).when(key % 5 == 1, 0.0005).otherwise(0.0)
    return table(spark, d, "orders").where(key % 10 != 7).select("o_orderkey", "o_custkey", F.when(key % 4 == 0, "F").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), price.alias("o_totalprice"), F.when(key % 6 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))


AB_SQL = """
a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 10 <> 3),
b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
  o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 1.0::DOUBLE WHEN o_orderkey % 5 = 1 THEN 0.0005::DOUBLE ELSE 0.0::DOUBLE END AS o_totalprice,
  CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 10 <> 7),
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey IS NOT NULL AS ina, b.o_orderkey IS NOT NULL AS inb,
  a.o_custkey AS custkey_a, b.o_custkey AS custkey_b, a.o_orderstatus AS status_a, b.o_orderstatus AS status_b, a.o_totalprice AS price_a, b.o_totalprice AS price_b, a.o_orderpriority AS priority_a, b.o_orderpriority AS priority_b,
  coalesce(a.o_custkey IS DISTINCT FROM b.o_custkey, true) AS custkey_c, a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus AS status_c,
  coalesce(abs(a.o_totalprice - b.o_totalprice) >= 0.001, true) AS price_c, a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority AS priority_c
  FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey),
o AS (SELECT *, CASE WHEN NOT ina THEN 'add' WHEN NOT inb THEN 'del' WHEN custkey_c OR status_c OR price_c OR priority_c THEN 'upd' ELSE 'same' END AS op FROM j)
"""


def user_arrays(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(user_id, v): values in time order; and a variant with updates, truncations and tails."""
    e = table(spark, d, "events")
    a = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("v"))
    changed = F.transform("v", lambda x, i: F.when(i % 7 == 0, x + 1).otherwise(x))
    cut = F.slice(changed, F.lit(1), F.greatest(F.size("v") - 3, F.lit(0)))
    tail = F.concat(changed, F.array(F.lit(1.5), F.lit(2.5)))
    return a, a.select("user_id", F.when(F.col("user_id") % 3 == 0, cut).when(F.col("user_id") % 3 == 1, tail).otherwise(changed).alias("v"))


ARRAYS_SQL = """
e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, value FROM events),
a AS (SELECT user_id, pos, value FROM e),
b AS (SELECT user_id, pos, CASE WHEN pos % 7 = 0 THEN value + 1 ELSE value END AS value FROM e WHERE user_id % 3 <> 0 OR pos < n - 3
  UNION ALL SELECT user_id, n + x.i, x.v FROM (SELECT DISTINCT user_id, n FROM e WHERE user_id % 3 = 1), (VALUES (0, 1.5::DOUBLE), (1, 2.5::DOUBLE)) x(i, v))
"""


def user_maps(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, a, b): counts by event type of odd and of even events, as maps; for every other user b has signups as logins."""
    e = table(spark, d, "events")
    kind = F.when((F.col("event_id") % 2 == 0) & (F.col("user_id") % 2 == 0) & (F.col("event_type") == "signup"), "login").otherwise(F.col("event_type"))

    def counts(odd: int, name: str) -> DataFrame:
        c = e.where(F.col("event_id") % 2 == odd).groupBy("user_id", kind.alias("event_type")).agg(F.count(F.lit(1)).alias("n"))
        return c.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias(name))

    empty = F.create_map().cast("map<string,bigint>")
    return counts(1, "a").join(counts(0, "b"), "user_id", "full_outer").select("user_id", F.coalesce("a", empty).alias("a"), F.coalesce("b", empty).alias("b"))


MAPS_SQL = """
c AS (SELECT user_id, CASE WHEN event_id % 2 = 0 AND user_id % 2 = 0 AND event_type = 'signup' THEN 'login' ELSE event_type END AS event_type, event_id % 2 AS odd, count(*) AS n FROM events GROUP BY ALL),
u AS (SELECT DISTINCT user_id FROM c),
a AS (SELECT user_id, event_type, n FROM c WHERE odd = 1),
b AS (SELECT user_id, event_type, n FROM c WHERE odd = 0)
"""


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """A change log: errors delete a user's event type, everything else sets it."""
    e = table(spark, d, "events")
    return e.select("user_id", "event_id", "ts", F.element_at(F.split(F.lit(",".join(EVENT_TYPES)), ","), (F.col("event_id") % 5 + 1).cast("int")).alias("item"), F.when(F.col("event_type") == "error", "del").otherwise("set").alias("op"), "value")


LOG_SQL = f"""
log AS (SELECT user_id, event_id, ts, string_split('{",".join(EVENT_TYPES)}', ',')[event_id % 5 + 1] AS item, CASE WHEN event_type = 'error' THEN 'del' ELSE 'set' END AS op, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events)
"""


def ticks(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, tick, ts, event_id, value): each user's events as ticks from 1."""
    from pyspark.sql.window import Window

    e = table(spark, d, "events")
    return e.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("tick"), "ts", "event_id", "event_type", "value")


TICKS_SQL = "t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tick, ts, event_id, event_type, value FROM events)"
