"""Bounded, deterministic samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Classes that are learned at most, and the parts that a class is numbered in.
CLASSES, PARTS = 200, 64


def crc_of(id_col: Column) -> Column:
    """crc32 of the id written as text; null counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


def sample_ids(labelled: DataFrame, id_col: str, class_col: str, per_class: int, classes: int = CLASSES) -> DataFrame:
    """(s_id, s_class, s_at): up to `per_class` rows of each class, those with the smallest id hashes, numbered from 1 in that order; the same ones on every run.

    Of more classes than `classes`, those with the most rows count, so that the sample is bounded where labels are dirty.
    A first pass counts classes; a second keeps about twice as many rows as asked for by a hash threshold and numbers them
    in parts, so no class, however large, is sorted in one task.
    """
    rows = labelled.select(F.col(id_col).alias("s_id"), F.col(class_col).alias("s_class")).where("s_id is not null and s_class is not null").groupBy("s_id").agg(F.max("s_class").alias("s_class"))
    rows = rows.withColumn("s_hash", F.pmod(F.xxhash64("s_id"), F.lit(1 << 52)))
    counts = {r["s_class"]: r["n"] for r in rows.groupBy("s_class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "s_class").limit(classes).collect()}
    limit = F.lit(None).cast("long")
    for name, n in counts.items():
        limit = F.when(F.col("s_class") == F.lit(name), F.lit(int((1 << 52) * min(1.0, (2 * per_class + 50) / n)))).otherwise(limit)
    # numbered in parts of a class by ranges of the hash; the parts' offsets are at most classes * PARTS rows
    kept = rows.withColumn("s_limit", limit).where("s_hash < s_limit").withColumn("s_part", F.floor(F.col("s_hash") * PARTS / F.col("s_limit")).cast("int"))
    before = Window.partitionBy("s_class").orderBy("s_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy("s_class", "s_part").agg(F.count(F.lit(1)).alias("s_n")).select("s_class", "s_part", F.coalesce(F.sum("s_n").over(before), F.lit(0)).alias("s_before"))
    number = F.row_number().over(Window.partitionBy("s_class", "s_part").orderBy("s_hash", "s_id"))
    numbered = kept.withColumn("s_number", number).join(F.broadcast(offsets), ["s_class", "s_part"])
    return numbered.withColumn("s_at", (F.col("s_before") + F.col("s_number")).cast("int")).where(F.col("s_at") <= per_class).select("s_id", "s_class", "s_at")
