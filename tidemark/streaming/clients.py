"""Streams of state messages: each client folds full states and differences against acknowledged baselines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.functions.schema import Schema
from tidemark.functions.wire import Codec, WireError

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUTPUT = T.StructType([T.StructField("client", T.LongType()), T.StructField("tick", T.LongType()), T.StructField("outcome", T.StringType()), T.StructField("state", T.BinaryType())])


class ClientFold(StatefulProcessor):
    """Rows (client, tick, baseline, payload) -> one row for each message: applied, stale or dropped, with the full state encoded.

    Baseline 0 is a full state.  A message whose baseline the client doesn't hold is dropped, one not newer than the last
    applied tick is stale.  States of the last `keep` ticks are held, encoded, in keyed state; older ones go.
    """

    def __init__(self, schema: Schema, root: str, keep: int):
        self.schema, self.root, self.keep = schema, root, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.codec = Codec(self.schema, self.root)
        self.last = handle.getValueState("last", T.StructType([T.StructField("tick", T.LongType())]))
        self.held = handle.getMapState("held", T.StructType([T.StructField("tick", T.LongType())]), T.StructType([T.StructField("state", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        messages = pd.concat(list(rows)).sort_values("tick", kind="stable")
        last = self.last.get()[0] if self.last.exists() else 0
        out = []
        for tick, baseline, payload in zip(messages["tick"], messages["baseline"], messages["payload"], strict=True):
            tick, baseline, state = int(tick), int(baseline), None
            if tick <= last:
                outcome = "stale"
            else:
                try:
                    if baseline == 0:
                        state = self.codec.decode(bytes(payload))
                    elif self.held.containsKey((baseline,)):
                        state = self.codec.decode_diff(self.codec.decode(bytes(self.held.getValue((baseline,))[0])), bytes(payload))
                    outcome = "dropped" if state is None else "applied"
                except WireError:
                    outcome = "dropped"
            encoded = None
            if outcome == "applied":
                encoded, last = self.codec.encode(state), tick
                self.held.updateValue((tick,), (encoded,))
            out.append((int(key[0]), tick, outcome, encoded))
        self.last.update((last,))
        for (tick,) in list(self.held.keys()):
            if tick < last - self.keep:
                self.held.removeKey((tick,))
        yield pd.DataFrame(out, columns=OUTPUT.names)

    def close(self) -> None:
        pass


def fold_clients(messages: DataFrame, schema: Schema, root: str, keep: int = 150) -> DataFrame:
    """The fold over a stream of (client, tick, baseline, payload); needs the RocksDB state store (see ROCKSDB)."""
    return messages.groupBy("client").transformWithStateInPandas(ClientFold(schema, root, keep), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def fold_table(messages: DataFrame, schema: Schema, root: str, keep: int = 150) -> DataFrame:
    """The fold over a table of (client, tick, baseline, payload), by the rules of ClientFold, each client's messages in order of tick.

    Older states go after each message (a stream drops them after each of its batches).  A client's rows pass through one
    task, but only the states that it holds are kept.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, client, last, held = Codec(schema, root), None, 0, {}
        for batch in batches:
            out = []
            for own, tick, baseline, payload in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != client:
                    client, last, held = own, 0, {}
                outcome, encoded = "stale" if tick <= last else "dropped", None
                if tick > last:
                    try:
                        if baseline == 0:
                            encoded = codec.encode(codec.decode(payload))
                        elif baseline in held:
                            encoded = codec.encode(codec.decode_diff(codec.decode(held[baseline]), payload))
                    except WireError:
                        pass
                if encoded is not None:
                    outcome, last, held[tick] = "applied", tick, encoded
                    while (oldest := next(iter(held))) < last - keep:
                        del held[oldest]
                out.append((own, tick, outcome, encoded))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=OUTPUT.names)

    rows = messages.select(F.col("client").cast("long"), F.col("tick").cast("long"), F.col("baseline").cast("long"), "payload")
    return rows.repartition("client").sortWithinPartitions("client", "tick", "baseline", "payload").mapInArrow(over, OUTPUT)


def tumbling(stream: DataFrame, ts: str, width: str, late: str, value: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Messages and sum of each tumbling event-time window, with a watermark for late rows."""
    out = stream.withWatermark(ts, late).groupBy(*by, F.window(ts, width).alias("w"))
    return out.agg(F.count(F.lit(1)).alias("messages"), F.sum(value).alias("total")).select(*by, F.col("w.start").alias("start"), "messages", "total")


def dedupe_stream(stream: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """Each key once, whatever the number of redundant sends, within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def finish(query: StreamingQuery, timeout: float | None = None) -> None:
    """Wait until an availableNow query has ended by itself, however long it takes.

    With a timeout (seconds), a query that is still running then is stopped and TimeoutError raised: what it wrote isn't whole.
    """
    try:
        ended = query.awaitTermination() if timeout is None else query.awaitTermination(timeout)
        if query.exception() is not None:
            raise query.exception()
        if ended is False:
            raise TimeoutError(f"the stream had not ended after {timeout} s")
    finally:
        query.stop()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", timeout: float | None = None) -> DataFrame:
    """Run what is there now to the end into Parquet, exactly once, and read the result; see `finish` for the timeout."""
    finish(stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(), timeout)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def frame(baseline: Column, payload: Column) -> Column:
    """A datagram: the baseline's tick in four bytes, least first (0 for a full state), then the payload; null if either is."""
    big = F.unhex(F.lpad(F.hex(baseline.cast("long")), 8, "0"))
    return F.concat(*[F.substring(big, i, 1) for i in (4, 3, 2, 1)], payload)


def unframe(datagram: Column) -> tuple[Column, Column]:
    """Baseline and payload of a datagram; null where it is shorter than its prefix."""
    whole = F.octet_length(datagram) >= 4
    prefix = F.concat(*[F.hex(F.substring(datagram, i, 1)) for i in (4, 3, 2, 1)])
    return F.when(whole, F.conv(prefix, 16, 10).cast("long")), F.when(whole, F.substring(datagram, F.lit(5), F.octet_length(datagram)))
