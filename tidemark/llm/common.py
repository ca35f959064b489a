"""What the training-data operators share: table access, scratch tables, Arrow batches, ASCII case folding."""

from __future__ import annotations

import atexit
import shutil
import string
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only; letters outside ASCII stay as they are."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or a variant of it that is no column of `df` (columns are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, from spark.checkpoint.dir; where that is unset, one of our own if the master is local, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` as Parquet under the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tidemark-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Delete scratch tables made by stored(); their frames must not be read again."""
    for df in frames:
        spark = df.sparkSession
        for f in {p.rpartition("/")[0] for p in df.inputFiles()}:
            if "/tidemark-" in f:
                path = spark._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of one key that stay together where a join spreads its hot keys, and the number of keys that it spreads (16 bytes each are broadcast).
SPREAD_ROWS, HOT_KEYS = 256, 10_000


def spread_join(many: DataFrame, one: DataFrame, key: Sequence[str], counts: DataFrame, by: Sequence[str | Column], how: str = "inner") -> DataFrame:
    """`many` joined to `one` on `key`, a hot key's rows in several tasks.

    `counts` has `key` and n, the rows of `many` with that key.  The HOT_KEYS keys with the most rows, if more than
    SPREAD_ROWS, are salted: `many` by a hash of the columns `by`, so that a task that is run again deals alike, and
    `one` repeated once a salt.  Any other key has fewer rows than those, at most a HOT_KEYS-th of all.
    """
    hot = counts.where(F.col("n") > SPREAD_ROWS).orderBy(F.col("n").desc(), *key).limit(HOT_KEYS)
    hot = F.broadcast(hot.select(*key, F.ceil(F.col("n") / SPREAD_ROWS).cast("int").alias("j_parts")))
    left = many.join(hot, list(key), "left").withColumn("j_salt", F.pmod(F.xxhash64(*by), F.coalesce("j_parts", F.lit(1))).cast("int")).drop("j_parts")
    right = one.join(hot, list(key), "left").withColumn("j_salt", F.explode(F.sequence(F.lit(0), F.coalesce("j_parts", F.lit(1)) - 1))).drop("j_parts")
    return left.join(right, [*key, "j_salt"], how).drop("j_salt")


#: Bytes of an Arrow batch; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches to BATCH_BYTES, so that a worker's memory doesn't follow the length of the texts; a lower limit stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
