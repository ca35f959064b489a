"""Sharding by a minimax contiguous partition of atomic groups.

Equal texts form an atomic group.  Groups are ordered by their text digest; contiguous groups whose digest begins alike
are one unit, and a unit never splits a group.  A group that holds a FINE-th of an even share, or more, is a unit of its
own, and so are the groups before, between and after such groups.  At most SHARDS * FINE groups are that large, so there
are at most 16**UNIT_DIGITS + 2 * SHARDS * FINE units however large the corpus.  A unit as large as an even share gets a
shard of its own.  For the others the smallest feasible capacity is found by binary search, each capacity checked by
greedy filling, and the cuts are set under that capacity, as near to even as it lets them.  DataFrame operations only:
shuffles of narrow rows, combined before; what meets in one task is a summary of the units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import fresh, stored, table

SHARDS, OVERHEAD = 40, 16
#: Hexadecimal digits of a text's digest: those that order it, and the first ones, which units share.
DIGITS, UNIT_DIGITS = 15, 4
FINE = 64
_TAIL_BITS = 4 * (DIGITS - UNIT_DIGITS)

_CAPACITY = """
aggregate(sequence(1, 62), named_struct('lo', greatest(largest, cast(ceil(total / k) as bigint)), 'hi', largest + cast(ceil(total / k) as bigint)),
  (s, i) -> CASE WHEN s.lo >= s.hi THEN s
    WHEN aggregate(sizes, named_struct('used', 1L, 'fill', 0L),
           (a, x) -> CASE WHEN a.fill + x > (s.lo + s.hi) div 2 THEN named_struct('used', a.used + 1L, 'fill', x) ELSE named_struct('used', a.used, 'fill', a.fill + x) END).used <= k
    THEN named_struct('lo', s.lo, 'hi', (s.lo + s.hi) div 2)
    ELSE named_struct('lo', (s.lo + s.hi) div 2 + 1L, 'hi', s.hi) END).lo
"""
# latest[t]: the least boundary from which t shards can hold all that follows.
_LATEST = """
aggregate(sequence(1, k), array(total), (r, i) -> concat(r, array(array_min(filter(ends, p -> p >= element_at(r, -1) - capacity)))))
"""
# Each cut is the boundary nearest to an even share of the rest, within what the capacity and the later shards allow.
_CUTS = """
aggregate(sequence(1, k), array(0L), (c, i) -> concat(c, array(
  aggregate(
    filter(ends, p -> p >= greatest(element_at(c, -1), element_at(latest, k - i + 1)) AND p <= element_at(c, -1) + capacity),
    named_struct('p', cast(null as bigint), 'd', cast(null as double)),
    (b, p) -> CASE WHEN b.p IS NULL OR abs(p - element_at(c, -1) - (total - element_at(c, -1)) / (k - i + 1)) < b.d
                   THEN named_struct('p', p, 'd', cast(abs(p - element_at(c, -1) - (total - element_at(c, -1)) / (k - i + 1)) as double)) ELSE b END).p)))
"""


def minimax_plan(units: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(unit, bytes) -> (unit, shard): contiguous in the order of units but for the giants, which come first.

    Bounded input: one row per unit.  Every shard but a giant's holds at most the smallest feasible capacity.
    """
    one = units.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "unit"))).alias("by_size"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("all"))
    giants = f"""
    aggregate(slice(by_size, 1, {shards - 1}), named_struct('n', 0, 'rest', all, 'on', true),
      (s, x) -> CASE WHEN s.on AND -x.minus * ({shards} - s.n) >= s.rest THEN named_struct('n', s.n + 1, 'rest', s.rest + x.minus, 'on', true) ELSE named_struct('n', s.n, 'rest', s.rest, 'on', false) END).n
    """
    one = one.withColumn("giants", F.expr(giants)).withColumn("k", F.lit(shards) - F.col("giants"))
    flat = one.select("giants", "k", F.posexplode("by_size").alias("place", "x")).select("giants", "k", "place", F.col("x.unit").alias("unit"), (-F.col("x.minus")).alias("bytes"))
    ordered = Window.orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
    rest = flat.where("place >= giants").withColumn("end", F.sum("bytes").over(ordered))
    cuts = rest.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("end", "bytes"))).alias("x"), F.max("bytes").alias("largest"), F.sum("bytes").alias("total"))
    cuts = cuts.select("k", "largest", "total", F.transform("x", lambda x: x["bytes"]).alias("sizes"), F.concat(F.array(F.lit(0).cast("long")), F.transform("x", lambda x: x["end"])).alias("ends"))
    for name, sql in (("capacity", _CAPACITY), ("latest", _LATEST), ("cuts", _CUTS)):
        cuts = cuts.select("*", F.explode(F.array(F.expr(sql))).alias(name))  # a generator, lest the next lambda evaluate it for each element
    cuts = stored(cuts.select("k", "capacity", "cuts"), "shard-cuts")  # one row
    # a shard's end belongs to it; an end that repeats (an empty shard) goes to the first
    shard = F.expr(f"size(filter(cuts, c -> c < end)) - 1 + {shards} - k")
    return rest.join(F.broadcast(cuts.select("k", "cuts")), "k").select("unit", shard.cast("int").alias("shard")).unionByName(flat.where("place < giants").select("unit", F.col("place").cast("int").alias("shard")))


def text_size(text: Column, overhead: int = OVERHEAD) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, id, size, text_crc32, digest): doc holds all columns of `docs`, so no name of theirs clashes with ours."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.coalesce(F.col("doc")[text_col], F.lit(""))
    digest = F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")
    return whole.select("doc", F.col("doc")[id_col].alias("id"), text_size(F.col("doc")[text_col]).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), digest.alias("digest"))


def _prefix() -> Column:
    return F.shiftright("digest", _TAIL_BITS)


def unit_starts(narrow: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(digest, size) -> (prefix, starts): the digests at which units begin inside a prefix, where a large group cuts it.

    At most shards * FINE groups are that large, so the result is broadcast.
    """
    prefixes = narrow.groupBy(_prefix().alias("p")).agg(F.sum("size").alias("bytes")).withColumn("total", F.sum("bytes").over(Window.partitionBy()))
    large = F.col("bytes") * (shards * FINE) >= F.col("total")
    prefixes = prefixes.where(large).select("p", "total")  # only there can a group be large: shards * FINE rows at most
    groups = narrow.join(F.broadcast(prefixes), _prefix() == F.col("p")).groupBy("p", "total", "digest").agg(F.sum("size").alias("bytes")).where(large)
    return groups.groupBy(F.col("p").alias("prefix")).agg(F.flatten(F.collect_list(F.array(F.col("digest"), F.col("digest") + 1))).alias("starts"))


def _with_unit(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """`rows` with unit, the digest at which their unit begins, in place of digest."""
    own = F.array_max(F.filter("starts", lambda s: s <= F.col("digest")))
    begin = F.shiftleft(F.shiftright("digest", _TAIL_BITS), _TAIL_BITS)
    return rows.join(F.broadcast(starts), _prefix() == F.col("prefix"), "left").withColumn("unit", F.coalesce(own, begin)).drop("prefix", "starts", "digest")


def _place(rows: DataFrame, narrow: DataFrame, shards: int) -> DataFrame:
    """`rows` with law, shard and slot; `narrow` has their id, size and digest."""
    starts = stored(unit_starts(narrow, shards), "shard-starts")
    narrow, rows = _with_unit(narrow, starts), _with_unit(rows, starts)
    units = stored(narrow.groupBy("unit").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-units")
    # a unit with many rows is numbered in several parts, in proportion to its rows, so that no task numbers a hot group
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") * 16**UNIT_DIGITS / F.sum("n").over(Window.partitionBy()))).cast("int")
    plan = stored(units.withColumn("parts", parts).join(minimax_plan(units.select("unit", "bytes"), shards), "unit").select("unit", "parts", "shard"), "shard-plan")
    part = F.conv(F.substring(F.md5(F.concat_ws(":", "id", "size")), 1, 8), 16, 10).cast("long") % F.col("parts")
    # at most as many rows as there are units, and 16**UNIT_DIGITS more
    counts = stored(narrow.join(F.broadcast(plan), "unit").groupBy("shard", "unit", part.alias("part")).agg(F.count(F.lit(1)).alias("n")), "shard-counts")
    before = Window.partitionBy("shard").orderBy("unit", "part").rowsBetween(Window.unboundedPreceding, -1)
    # 32 bytes a row
    offsets = counts.select("unit", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("unit", "part").orderBy("id", "size", "text_crc32"))
    placed = rows.join(F.broadcast(plan), "unit").withColumn("part", part).withColumn("number", number).join(F.broadcast(offsets), ["unit", "part"])
    return placed.select(*[c for c in rows.columns if c != "unit"], F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("number") - 1).cast("long").alias("slot"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot.

    Shards run from 0 to shards - 1; slots of a shard are gapless from 0.  Null text counts as empty, so null and empty
    texts are one group.  Rows that repeat an id are separate documents; full ties are interchangeable.  Empty input gives
    an empty result.  Other columns of `docs` may have any name.
    """
    narrow = stored(_sized(docs, id_col, text_col).drop("doc"), "shard-sizes")
    return _place(narrow, narrow, shards)


def shard_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """The columns of `docs`, whole, with the shard and slot of each row; a name that `docs` has already gets underscores in front, see `fresh`."""
    rows = _sized(docs, id_col, text_col)
    narrow = stored(rows.select("id", "size", "digest"), "shard-sizes")
    out = _place(rows, narrow, shards)
    return out.select(*[F.col("doc")[c].alias(c) for c in docs.columns], F.col("shard").alias(fresh(docs, shard_col)), F.col("slot").alias(fresh(docs, slot_col)))


def op2_shard(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts are one group of 16 bytes each; null and repeated doc_ids are rows of their own."""
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP2_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id AS id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) + {OVERHEAD} AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(text, '')), 1, {DIGITS}) AS BIGINT) AS digest FROM documents),
-- checksums of the distinct texts, a byte at a time
steps AS (SELECT list_transform(range(256), lambda c: list_reduce(list_concat([c], range(8)), lambda a, i: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS step),
crcs AS (SELECT text, xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
  lambda a, b: xor(a >> 8, step[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM (SELECT DISTINCT text FROM d), steps),
-- units
t AS (SELECT CAST(sum(size) AS BIGINT) AS total, count(*) AS n FROM d),
heavy AS (SELECT digest FROM d GROUP BY digest HAVING sum(size) * {SHARDS * FINE} >= (SELECT total FROM t)),
starts AS (SELECT (digest >> {_TAIL_BITS}) << {_TAIL_BITS} AS unit FROM d UNION SELECT digest FROM heavy UNION SELECT digest + 1 FROM heavy),
u AS (SELECT d.*, unit FROM d ASOF JOIN starts ON digest >= unit),
units AS (SELECT unit, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n, row_number() OVER (ORDER BY sum(size) DESC, unit) - 1 AS place FROM u GROUP BY unit),
giant AS (SELECT 0 AS n, total AS rest FROM t
  UNION ALL SELECT giant.n + 1, rest - bytes FROM giant JOIN units ON place = giant.n WHERE giant.n < {SHARDS - 1} AND bytes * ({SHARDS} - giant.n) >= rest),
k AS (SELECT max(n) AS giants, {SHARDS} - max(n) AS k FROM giant),
rest AS (SELECT unit, bytes, CAST(sum(bytes) OVER (ORDER BY unit) AS BIGINT) AS fin FROM units, k WHERE place >= giants),
r AS (SELECT k, max(bytes) AS largest, max(fin) AS total FROM rest, k GROUP BY k),
-- the smallest capacity under which greedy filling needs no more than k shards: one shard filled in each step
search AS (SELECT greatest(largest, CAST(ceil(total / k) AS BIGINT)) AS lo, largest + CAST(ceil(total / k) AS BIGINT) AS hi, CAST(0 AS BIGINT) AS pos, 1 AS used FROM r
  UNION ALL SELECT CASE WHEN nxt < total AND used = k THEN (lo + hi) // 2 + 1 ELSE lo END, CASE WHEN nxt = total THEN (lo + hi) // 2 ELSE hi END,
    CASE WHEN nxt < total AND used < k THEN nxt ELSE 0 END, CASE WHEN nxt < total AND used < k THEN used + 1 ELSE 1 END
  FROM (SELECT lo, hi, used, max(fin) AS nxt FROM search JOIN rest ON fin <= pos + (lo + hi) // 2 WHERE lo < hi GROUP BY lo, hi, pos, used), r),
cap AS (SELECT max(lo) AS capacity FROM search),
ends AS (SELECT CAST(0 AS BIGINT) AS p UNION ALL SELECT fin FROM rest),
late AS (SELECT CAST(0 AS BIGINT) AS i, total AS lim FROM r
  UNION ALL SELECT i + 1, min(p) FROM late, cap, k JOIN ends ON true WHERE i < k AND p >= lim - capacity GROUP BY i),
cut AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS c FROM r
  UNION ALL SELECT i + 1, min(struct_pack(off := off, p := p)).p FROM (
    SELECT cut.i, p, abs(p - c - (r.total - c) / (r.k - cut.i)) AS off FROM cut, r, cap, late, ends WHERE cut.i < r.k AND late.i = r.k - cut.i - 1 AND p >= greatest(c, lim) AND p <= c + capacity) GROUP BY i),
homes AS (SELECT unit, CAST(count(*) - 1 + any_value(giants) AS INTEGER) AS shard FROM rest JOIN cut ON c < fin, k GROUP BY unit
  UNION ALL SELECT unit, CAST(place AS INTEGER) FROM units, k WHERE place < giants),
parts AS (SELECT unit, greatest(1, CAST(ceil(units.n * {16**UNIT_DIGITS} / t.n) AS BIGINT)) AS parts FROM units, t),
w AS (SELECT u.*, crc, shard, CAST('0x' || substr(md5(concat_ws(':', id, size)), 1, 8) AS BIGINT) % parts AS part FROM u JOIN crcs USING (text) JOIN homes USING (unit) JOIN parts USING (unit))
SELECT id AS doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY unit, part, id NULLS FIRST, size, crc) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM w
"""
