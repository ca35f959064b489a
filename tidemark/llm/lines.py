"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate.  HyperLogLog sketches of the sites, one for each line hash, merge by
aggregation; a line whose estimate is clearly at or above the threshold is boilerplate, one clearly below isn't, and
lines near the threshold get exact distinct counts.  Documents then lose their boilerplate lines.  DataFrame operations
only: sketches are built before the shuffle, so a line on a third of all documents costs one sketch for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh, spread_join, stored, table

MIN_SITES, SKETCH_LOG2 = 5, 12
#: Half-width of the band of estimates that are counted exactly: over six standard errors of the sketch (1.04 / sqrt(2**12)).
NEAR = 0.1
#: Boilerplate hashes up to this many (8 bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_LINES = 500_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def blank(line: Column) -> Column:
    """Nothing but spaces; a line of other white space is a line like any other."""
    return F.trim(line) == ""


def _among(x: Column) -> Column:
    """Whether `x` is among `hashes` (sorted): the last place that isn't above it, found by the powers of two in `steps`."""
    place = F.aggregate("steps", F.lit(0), lambda at, by: F.when(F.try_element_at("hashes", at + by) <= x, at + by).otherwise(at))
    return (place > 0) & (F.try_element_at("hashes", F.greatest(place, F.lit(1))) == x)


def spread_lines(docs: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """(line): 64-bit hashes of the non-blank lines that stand on `min_sites` sites or more.  A null site is none."""
    found = docs.select(F.col(f"`{site_col}`").cast("string").alias("site"), F.explode(F.array_distinct(F.transform(F.filter(lines_of(F.col(f"`{text_col}`")), lambda x: ~blank(x)), lambda x: F.xxhash64(x)))).alias("line")).where("site is not null")
    sketches = found.groupBy("line").agg(F.hll_sketch_agg("site", SKETCH_LOG2).alias("sketch"))
    estimates = sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - near) - 1)
    estimates = stored(estimates, "line-spread")
    high = min_sites * (1 + near) + 1
    close = estimates.where(F.col("sites") < high).select("line")
    counts = found.distinct().join(close, "line", "left_semi").groupBy("line").agg(F.count(F.lit(1)).alias("sites"))
    return estimates.where(F.col("sites") >= high).select("line").unionByName(counts.where(F.col("sites") >= min_sites).select("line"))


def remove_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with three columns more: n_lines, n_removed, kept (the text without its boilerplate lines; order and blank lines stay).

    Returns the frame and the names the three columns got (they dodge columns of `docs`).  Null text has no lines and
    stays null; repeated rows keep their rows, each judged by its own lines; empty input gives an empty result.  Texts
    meet their boilerplate lines by a digest of the text, a text on many rows in several tasks.
    """
    names = {k: fresh(docs, k) for k in ("n_lines", "n_removed", "kept")}
    boilerplate = stored(spread_lines(docs, site_col, text_col, min_sites), "line-boilerplate")
    if boilerplate.count() <= BROADCAST_LINES:
        boilerplate = F.broadcast(boilerplate)
    salt = [F.col("doc")[f.name] for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.col("doc")[text_col]
    # rows without a text match nothing; a key of their own keeps them apart
    whole = whole.withColumn("key", F.coalesce(F.md5(text), F.xxhash64(*salt).cast("string")))
    own = whole.select("key", F.explode(F.array_distinct(F.transform(lines_of(text), lambda x: F.xxhash64(x)))).alias("line")).join(boilerplate, "line", "left_semi")
    own = own.groupBy("key").agg(F.array_sort(F.collect_set("line")).alias("hashes"), F.count(F.lit(1)).alias("n"))
    # a line is looked up in its text's list by halving, so a long text costs its lines times the logarithm of its hits
    powers = F.sequence(F.floor(F.log2(F.size("hashes"))).cast("int"), F.lit(0), F.lit(-1))
    own = own.withColumn("steps", F.transform(powers, lambda i: F.call_function("shiftleft", F.lit(1), i)))
    joined = spread_join(whole, own.drop("n"), ["key"], own.select("key", "n"), salt, "left")
    kept = F.filter(lines_of(text), lambda x: blank(x) | ~_among(F.xxhash64(x)))
    kept = F.when(F.col("hashes").isNull(), lines_of(text)).otherwise(kept)
    out = joined.withColumn("kept", kept)
    n = F.coalesce(F.size(lines_of(text)), F.lit(0))
    n = F.when(text.isNull(), 0).otherwise(n).cast("long")
    left = F.when(text.isNull(), 0).otherwise(F.size("kept")).cast("long")
    made = [n.alias(names["n_lines"]), (n - left).alias(names["n_removed"]), F.array_join("kept", "\n").alias(names["kept"])]
    return out.select(*[F.col("doc")[c].alias(c) for c in docs.columns], *made), names


def op8_lines(spark, sf_dir: str) -> DataFrame:
    """Null texts have no lines and an empty kept text; a null source is no site; null and repeated doc_ids are rows of their own."""
    out, names = remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", F.col(names["n_lines"]).alias("n_lines"), F.col(names["n_removed"]).alias("n_removed"), F.sha2(F.coalesce(F.col(names["kept"]), F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT rid, source, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
b AS (SELECT line FROM x WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
k AS (SELECT rid, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS kept FROM x WHERE line NOT IN (SELECT line FROM b) GROUP BY rid)
SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l), 0) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
