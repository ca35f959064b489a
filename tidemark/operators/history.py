"""Versions of state: change logs, snapshots, baselines, pruning, replay of acknowledged ticks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def ordered(entity: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*entity).orderBy(*order)


def with_versions(log: DataFrame, entity: Sequence[str], order: Sequence[str], version: str = "version") -> DataFrame:
    """Each change of an entity with its number, from 1.  Versions count by entity, so no global order is needed."""
    return log.withColumn(version, F.row_number().over(ordered(entity, order)).cast("long"))


def entity_versions(log: DataFrame, entity: Sequence[str], version: str = "version") -> DataFrame:
    """The highest version of anything below an entity: what propagates to a parent."""
    return log.groupBy(*entity).agg(F.max(version).alias(version))


def state_as_of(log: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str], until: Column) -> DataFrame:
    """The last values of each key among the log's rows for which `until` holds; one partial aggregation, no sort."""
    last = F.max_by(F.struct(*values), F.struct(*order))
    return log.where(until).groupBy(*keys).agg(last.alias("__last")).select(*keys, *[F.col(f"__last.{v}").alias(v) for v in values])


def changed_since(log: DataFrame, keys: Sequence[str], version: str, baseline: Column) -> DataFrame:
    """Keys with a change above the baseline, with their latest version and operation count."""
    return log.where(F.col(version) > baseline).groupBy(*keys).agg(F.max(version).alias(version), F.count(F.lit(1)).alias("changes"))


def classify_since(log: DataFrame, keys: Sequence[str], op: str, version: str, baseline: Column, base_keys: DataFrame) -> DataFrame:
    """Each key touched after a baseline as add, upd or del: the last operation, against the keys the baseline had.

    A key set and deleted again that the baseline lacked is no change.
    """
    last = log.where(F.col(version) > baseline).groupBy(*keys).agg(F.max_by(op, version).alias("__op"))
    had = base_keys.select(*keys, F.lit(True).alias("__had"))
    out = last.join(had, list(keys), "left").withColumn("kind", F.when((F.col("__op") == "del") & F.col("__had"), "del").when(F.col("__op") == "del", None).when(F.col("__had"), "upd").otherwise("add"))
    return out.where("kind is not null").select(*keys, "kind")


def prune_tombstones(log: DataFrame, op: str, version: str, snapshots: DataFrame, snapshot_version: str) -> DataFrame:
    """The log without deletions older than the oldest live snapshot; without snapshots, without any deletion."""
    return log.where((F.col(op) != "del") | (F.col(version) >= snapshots.agg(F.min(snapshot_version)).scalar()))


def prune_history(history: DataFrame, tick: str, keep: int, entity: Sequence[str] = ()) -> DataFrame:
    """Rows of the last `keep` ticks, of each entity if given."""
    if entity:
        newest = F.max(tick).over(Window.partitionBy(*entity))
        return history.withColumn("__newest", newest).where(F.col(tick) >= F.col("__newest") - keep).drop("__newest")
    return history.where(F.col(tick) >= history.agg(F.max(tick)).scalar() - keep)


def choose_baseline(clients: DataFrame, history: DataFrame, acked: str, tick: str) -> DataFrame:
    """Clients with the message they get: a diff from the acknowledged tick if history still holds it, else the full state."""
    held = history.select(F.col(tick).alias("__held")).distinct()
    out = clients.join(held, F.col(acked) == F.col("__held"), "left")
    return out.withColumn("message", F.when(F.col("__held").isNotNull(), "diff").otherwise("full")).withColumn("baseline", F.col("__held")).drop("__held")


def message_plan(ticks: DataFrame, client: Sequence[str], tick: str) -> DataFrame:
    """Each client's messages against its own last one: full at first, then a diff from the tick before."""
    before = F.lag(tick).over(ordered(client, [tick]))
    return ticks.withColumn("baseline", before).withColumn("message", F.when(F.col("baseline").isNull(), "full").otherwise("diff"))


def dedupe_inputs(inputs: DataFrame, client: Sequence[str], arrival: Sequence[str], tick: str) -> DataFrame:
    """Inputs with a tick above all that their client sent before."""
    seen = F.max(tick).over(ordered(client, arrival).rowsBetween(Window.unboundedPreceding, -1))
    return inputs.withColumn("__seen", seen).where(F.col("__seen").isNull() | (F.col(tick) > F.col("__seen"))).drop("__seen")


def redundant_window(inputs: DataFrame, client: Sequence[str], order: Sequence[str], value: str, n: int, out: str = "sent") -> DataFrame:
    """Each input with the last `n` of its client, oldest first."""
    return inputs.withColumn(out, F.collect_list(value).over(ordered(client, order).rowsBetween(-(n - 1), 0)))


def latest(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last values of each key."""
    return state_as_of(df, keys, values, order, F.lit(True))


def loss_window(ticks: DataFrame, client: Sequence[str], tick: str, n: int = 100) -> DataFrame:
    """Each message with the lost share (percent) of its client's last `n`: gaps in the tick count as losses."""
    w = ordered(client, [tick])
    gap = F.greatest(F.coalesce(F.col(tick) - F.lag(tick).over(w) - 1, F.lit(0)), F.lit(0))
    out = ticks.withColumn("gap", gap.cast("long"))
    recent = w.rowsBetween(-(n - 1), 0)
    out = out.withColumn("lost", F.sum("gap").over(recent)).withColumn("received", F.count(F.lit(1)).over(recent))
    return out.withColumn("loss_pct", 100.0 * F.col("lost") / (F.col("received") + F.col("lost")))


def running_mean(df: DataFrame, entity: Sequence[str], order: Sequence[str], value: str, out: str = "mean") -> DataFrame:
    return df.withColumn(out, F.avg(value).over(ordered(entity, order).rowsBetween(Window.unboundedPreceding, 0)))


def bandwidth(messages: DataFrame, ts: str, size: Column, width: str, by: Sequence[str] = ()) -> DataFrame:
    """Messages and bytes of each tumbling window; the same expression serves a stream with a watermark."""
    return messages.groupBy(*by, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("messages"), F.sum(size).alias("bytes")).select(*by, F.col("w.start").alias("start"), "messages", "bytes")


def drop_owned(owned: DataFrame, owner: str, removed: DataFrame, key: str) -> DataFrame:
    """Rows whose owner wasn't removed."""
    return owned.join(removed.select(F.col(key).alias("__gone")), F.col(owner) == F.col("__gone"), "left_anti")


def interpolate(samples: DataFrame, wanted: DataFrame, entity: Sequence[str], t: str, value: str, at: str) -> DataFrame:
    """Values at the wanted times, between the last sample at or before and the first after; held beyond the last, null before the first.

    Both sides go through one window over the entity's merged times, forwards and backwards, each with a running frame: as-of
    in both directions without a theta join, in time that grows with an entity's rows, not with their square.  Of samples
    at one time, the one with the greatest value counts before it and the one with the least after it.
    """
    a = samples.select(*entity, F.col(t).alias("__t"), F.col(value).cast("double").alias("__v"), F.lit(0).alias("__kind"))
    b = wanted.select(*entity, F.col(at).alias("__t"), F.lit(None).cast("double").alias("__v"), F.lit(1).alias("__kind"))
    forth = Window.partitionBy(*entity).orderBy("__t", "__kind", "__v")
    back = Window.partitionBy(*entity).orderBy(F.desc("__t"), F.desc("__kind"), F.desc("__v"))
    sample = F.when(F.col("__kind") == 0, F.struct(F.col("__t").alias("t"), F.col("__v").alias("v")))
    both = a.unionByName(b)
    both = both.withColumn("__from", F.last(sample, ignorenulls=True).over(forth.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("__to", F.last(sample, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    share = (F.col("__t") - F.col("__from.t")) / (F.col("__to.t") - F.col("__from.t"))
    out = F.when(F.col("__from").isNull(), None).when(F.col("__to").isNull(), F.col("__from.v")).otherwise(F.col("__from.v") + (F.col("__to.v") - F.col("__from.v")) * share)
    return both.where("__kind = 1").select(*entity, F.col("__t").alias(at), out.alias(value))
