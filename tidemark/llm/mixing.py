"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source gets a target share of words.  A source's documents stand in a permuted order (by a digest of their id), its
words form a line, once through or begun anew where the target exceeds the source, and the line is cut into blocks of
equal length.  The exact block quotas of all sources are split down a binary tree: at each node a random half of the
blocks goes left, so that the counts by source follow the multivariate hypergeometric law and stay exact.  The leaves
are output shards; each then draws its quota of permuted blocks, disjoint from the other shards', and orders its rows by
a local shuffle key.  DataFrame operations only: the tree works on a summary of at most MIX_BLOCKS blocks plus one for
each source, and a running position is a bucket's offset plus a position in the bucket, so no source meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import stored, table

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
MIX_BLOCKS, TREE_DEPTH, BUCKET_DIGITS = 4096, 4, 3
#: Sources up to this many are broadcast (a few hundred bytes each); beyond, the join shuffles.
BROADCAST_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> those, rank, target: weights in the order of sources (null last), never above cap x size.

    The excess of capped sources is shared again by weight until none is above: the level at which the uncapped ones meet.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(w) for w in weights])
    w = sizes.withColumn("rank", F.row_number().over(ordered)).withColumn("w", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    fill = Window.orderBy("ratio", "rank")
    everything = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("most").over(before), F.lit(0))
    # a frame to the end would be summed anew for each row
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    w = w.withColumn("total", F.sum("source_size").over(everything)).withColumn("level", (share * F.col("total") - below) / weight)
    w = w.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
    return w.select("source", "source_size", "rank", F.least(F.col("most").cast("double"), F.col("level") * F.col("w")).alias("target"))


def splitting_tree(quotas: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """(rank, blocks) -> (rank, block, shard): blocks of each source dealt to 2**depth shards."""
    unit = quotas.where("blocks > 0").select("rank", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block")).withColumn("node", F.lit(0))
    for level in range(depth):
        key = F.md5(F.concat_ws(":", F.lit(f"split{level}"), "rank", "block"))
        at = F.row_number().over(Window.partitionBy("node").orderBy(key))
        half = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("node")) / 2)
        unit = unit.withColumn("right", (at > half).cast("int")).withColumn("node", F.col("node") * 2 + F.col("right")).drop("right")
    quota = unit.select("rank", F.col("node").alias("shard"), F.row_number().over(Window.partitionBy("rank").orderBy("node", "block")).alias("draw"))
    permuted = F.md5(F.concat_ws(":", F.lit("block"), "rank", "block"))
    blocks = unit.select("rank", "block", F.row_number().over(Window.partitionBy("rank").orderBy(permuted)).alias("draw"))
    return blocks.join(quota, ["rank", "draw"]).select("rank", "block", "shard")


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(doc, id, source, size, key, bucket): doc holds all columns of `docs`, so no name of theirs clashes with ours."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = whole.select("doc", F.col("doc")[id_col].alias("id"), F.col("doc")[source_col].cast("string").alias("source"), word_count(F.col("doc")[text_col]).alias("size"))
    key = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":mix")))
    return rows.withColumn("key", key).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))


def _plan(narrow: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Targets and the blocks' shards by source; the words before each bucket of a source's permuted order."""
    buckets = stored(narrow.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix-buckets")
    plan = targets(buckets.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("quota", F.floor("target"))
    length = F.greatest(F.lit(1), F.ceil(F.sum("quota").over(Window.partitionBy()) / MIX_BLOCKS))
    plan = stored(plan.withColumn("length", length).withColumn("blocks", F.ceil(F.col("quota") / F.col("length"))), "mix-targets")
    dealt = splitting_tree(plan.select("rank", "blocks"), depth).groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "shard"))), lambda x: x["shard"]).alias("shards"))
    plan = stored(plan.join(dealt, "rank", "left").select(F.col("source").alias("p_source"), "source_size", "target", "quota", "length", "shards"), "mix-plan")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return (F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan), offsets


def _draw(rows: DataFrame, plan: DataFrame, offsets: DataFrame) -> DataFrame:
    """`rows` with source_size, target, taken and copies; with quota, at (the words before it in its source), start and ties (of the rows that equal it in key, id and size: the least at, the count)."""
    columns = rows.columns
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
    inside = Window.partitionBy("o_source", "o_bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.col("offset") + F.sum("size").over(inside) - F.col("size"))
    equal = Window.partitionBy("o_source", "o_bucket", "key", "id", "size")  # where nobody reads start and ties, they aren't computed
    rows = rows.withColumn("start", F.min("at").over(equal)).withColumn("ties", F.count(F.lit(1)).over(equal))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    first = F.least("quota", "source_size")

    def copy(epoch: int, quota: Column, begin: Column) -> Column:
        words = F.greatest(F.lit(0), F.least("size", quota - F.col("at")))
        shard = F.try_element_at("shards", (F.floor((begin + F.col("at")) / F.col("length")) + 1).cast("int"))
        return F.struct(F.lit(epoch).alias("epoch"), words.alias("words"), shard.alias("shard"), F.md5(F.concat(F.lit(f"{epoch}:"), "key")).alias("slot_key"))

    copies = F.filter(F.array(copy(1, first, F.lit(0)), copy(2, F.col("quota") - first, first)), lambda c: c["words"] > 0)
    rows = rows.withColumn("copies", copies)
    return rows.select(*columns, "source_size", "target", F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"]).alias("taken"), "copies", "quota", "at", "start", "ties")


def _cuts(drawn: DataFrame) -> DataFrame:
    """(c_source, last1, last2): the last copies of a source's epochs, null where nothing is taken.

    last: key, id and size of the document; ties, the documents that equal it in those, and ahead, those of them that are
    taken whole before it; words, null for a whole copy.  All documents with words before it are taken whole in that
    epoch, none after it: a source's words are taken from the first on, and one copy ends at the quota.
    """
    first = F.least("quota", "source_size")
    ends = drawn.select("source", "key", "id", "size", "at", "start", "ties", F.explode("copies").alias("copy"), first.alias("q1"), (F.col("quota") - first).alias("q2"))
    ends = ends.where(F.col("at") + F.col("copy.words") == F.when(F.col("copy.epoch") == 1, F.col("q1")).otherwise(F.col("q2")))
    ahead = F.expr("(at - start) div size")
    words = F.when(F.col("copy.words") < F.col("size"), F.col("copy.words"))
    last = F.struct("key", "id", "size", "ties", ahead.alias("ahead"), words.alias("words"))
    per = [F.max(F.when(F.col("copy.epoch") == e, last)).alias(f"last{e}") for e in (1, 2)]  # of one row
    return ends.groupBy(F.col("source").alias("c_source")).agg(*per)


def _epochs(rows: DataFrame, cuts: DataFrame, text: Column) -> DataFrame:
    """`rows` (id, source, key and others) once for each copy that the mix takes, with words: null for a whole copy.

    `text` is looked into for words, and its words are counted at a cut only.
    """
    columns, few = rows.columns, cuts.count() <= BROADCAST_SOURCES
    rows = rows.join(F.broadcast(cuts) if few else cuts, F.col("source").eqNullSafe(F.col("c_source")))
    here, epochs = F.struct("id", word_count(text).alias("size")), [F.col("last1"), F.col("last2")]
    ends = [F.coalesce(F.col("key") == x["key"], F.lit(False)) & (here == F.struct(x["id"].alias("id"), x["size"].alias("size"))) for x in epochs]

    if cuts.where("last1.ties > 1 or last2.ties > 1").isEmpty():
        rows = rows.withColumn("number", F.lit(0))
    else:  # documents that equal the last one are told apart by numbers
        tied = F.lit(False)
        for x, end in zip(epochs, ends, strict=True):
            tied = tied | (end & (x["ties"] > 1))
        number = F.row_number().over(Window.partitionBy("source", "key", "id", word_count(text)).orderBy(F.xxhash64(text))) - 1
        rows = rows.where(~tied).withColumn("number", F.lit(0)).unionByName(rows.where(tied).withColumn("number", number))

    def words(last: Column, end: Column) -> Column:
        before = F.when(F.col("key") == last["key"], here < F.struct(last["id"].alias("id"), last["size"].alias("size"))).otherwise(F.col("key") < last["key"])
        at_end = F.when(F.col("number") == last["ahead"], last["words"]).when(F.col("number") > last["ahead"], F.lit(0))
        return F.when(last.isNull(), F.lit(0)).when(end, at_end).when(~before, F.lit(0))

    some = F.coalesce(F.regexp_like(text, F.lit(WORD)), F.lit(False))
    taken = F.filter(F.array(*[words(x, end) for x, end in zip(epochs, ends, strict=True)]), lambda n: n.isNull() | (n > 0))
    return rows.where(some).select(*columns, F.explode(taken).alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", depth: int = TREE_DEPTH) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, copies.

    copies: array of (epoch, words, shard, slot_key); words < size in at most one copy of a source and epoch, whose first
    words are meant; within a shard, rows stand in the order of slot_key.  Source shares are exact: the copies of a source
    hold floor(target) words.  Null text and text without words have size 0 and no copy; a null source is a source of its
    own, last.  Rows that repeat an id are separate documents; equal keys are ordered by id and size, and full ties are
    interchangeable.  Empty input gives an empty result.  Other columns of `docs` may have any name.
    """
    narrow = stored(_sized(docs, id_col, source_col, text_col).drop("doc"), "mix-sizes")
    return _draw(narrow, *_plan(narrow, depth)).select("id", "size", "source_size", "target", "taken", "copies")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", chars_col: str = "n_chars", depth: int = TREE_DEPTH) -> DataFrame:
    """The mixed corpus, with the columns of `docs`: a row for each copy that the mix takes.

    A copy cut short keeps its first words, joined by one space, and its own count of characters in `chars_col`.  The
    copies are those of mix(): they are drawn over ids and sizes, and what a source's epochs end with is broadcast, so that
    texts don't travel (but for those of full ties at an end, and beyond BROADCAST_SOURCES sources).
    """
    rows = _sized(docs, id_col, source_col, text_col)
    narrow = stored(rows.drop("doc"), "mix-sizes")
    cuts = stored(_cuts(_draw(narrow, *_plan(narrow, depth))), "mix-cuts")
    text = F.col("doc")[text_col]
    out = _epochs(rows.select("doc", "id", "source", "key"), cuts, text)
    short = F.col("words").isNotNull()
    cut = F.array_join(F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != ""), 1, F.col("words").cast("int")), " ")
    changed = {text_col: F.when(short, cut).otherwise(text)}
    if chars_col in docs.columns:
        changed[chars_col] = F.when(short, F.length(cut).cast(docs.schema[chars_col].dataType)).otherwise(F.col("doc")[chars_col])
    return out.select(*[changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def op10_mix(spark, sf_dir: str) -> DataFrame:
    """Null texts have size 0 and are never taken; a null source is one of its own, last; null and repeated ids stay rows of their own."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    shards = F.array_join(F.transform("copies", lambda c: c["shard"].cast("string")), ",")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", shards.alias("shards"))


def _tree_sql(depth: int) -> str:
    out = ["n0 AS (SELECT rank, block, 0 AS node FROM unit)"]
    for i in range(depth):
        out.append(f"n{i + 1} AS (SELECT rank, block, node * 2 + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY md5('split{i}:' || rank || ':' || block)) > ceil(count(*) OVER (PARTITION BY node) / 2.0) THEN 1 ELSE 0 END AS node FROM n{i})")
    return ",\n".join(out)


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix') AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS most FROM s),
r AS (SELECT *, most / w AS ratio, sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (1.5::DOUBLE * total - coalesce(sum(most) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
lv AS (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, rank LIMIT 1),
t AS (SELECT source, source_size, rank, least(CAST(most AS DOUBLE), (SELECT level FROM lv) * w) AS target FROM l),
q AS (SELECT *, CAST(floor(target) AS BIGINT) AS quota FROM t),
p AS (SELECT *, greatest(1, CAST(ceil(sum(quota) OVER () / {MIX_BLOCKS}.0) AS BIGINT)) AS length FROM q),
unit AS (SELECT rank, unnest(range(CAST(ceil(quota / CAST(length AS DOUBLE)) AS BIGINT))) AS block FROM p),
{_tree_sql(TREE_DEPTH)},
qu AS (SELECT rank, node AS shard, row_number() OVER (PARTITION BY rank ORDER BY node, block) AS draw FROM n{TREE_DEPTH}),
bl AS (SELECT rank, block, row_number() OVER (PARTITION BY rank ORDER BY md5('block:' || rank || ':' || block)) AS draw FROM unit),
dealt AS (SELECT bl.rank, block, shard FROM bl JOIN qu ON bl.rank = qu.rank AND bl.draw = qu.draw),
a AS (SELECT doc_id, d.size, source_size, target, rank, quota, length, least(quota, source_size) AS q1,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS pos
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
c AS (SELECT *, greatest(0, least(size, q1 - pos)) AS w1, greatest(0, least(size, quota - q1 - pos)) AS w2 FROM a)
SELECT doc_id, c.size, source_size, target, CAST(w1 + w2 AS BIGINT) AS taken,
       concat_ws(',', CASE WHEN w1 > 0 THEN CAST(x.shard AS VARCHAR) END, CASE WHEN w2 > 0 THEN CAST(y.shard AS VARCHAR) END) AS shards
FROM c LEFT JOIN dealt x ON x.rank = c.rank AND x.block = CAST(pos AS BIGINT) // length
LEFT JOIN dealt y ON y.rank = c.rank AND y.block = CAST(q1 + pos AS BIGINT) // length
"""
