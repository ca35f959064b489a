"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct shingles of five words.  Documents with equal sets are one class.  Each class gets
a sketch of 128 registers; a register keeps the least hash of its bucket as a leading-zero count and ten mantissa bits.
Small sets would leave most buckets empty, so there every register takes the least of the whole set under a multiplier
of its own; sets of middling size carry both sketches, and two sets of Jaccard similarity 0.75 always share one kind.
Four neighbouring registers are a band.  Classes that share a band are candidates; the Jaccard estimate, corrected for
accidental register collisions, drops the hopeless, and the full sets decide.

Large groups of copies share bands in whole.  Instead of all pairs, each class is first compared with the smallest and
the greatest class of its band; the links found merge classes into components.  Only bands that still hold several
components go on: there, blocks of the classes outside the band's largest component (the minor ones) meet blocks of all
its classes, first by sketch, then by the full sets of those with hope.  With N classes, M of them minor, that ships
N * ceil(M / BLOCK) + M * ceil(N / BLOCK) sketches.  No band is cut or dropped, and only links leave a block.
Joins on a class, a band or a hub that many rows share are dealt to several tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, drop_stored, spread_join, stored, table, text_bytes
from tidemark.llm.components import components
from tidemark.llm.kernels import WHITESPACE, U, Words, chunks, mix

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
REGISTERS, BUCKET_BITS, MANTISSA, BAND = 128, 7, 10, 4
BANDS = REGISTERS // BAND
EMPTY = np.uint16(0xFFFF)
#: Sets up to LARGEST_SMALL get the sketch for small sets, sets from SMALLEST_LARGE the bucketed one; their ratio is the threshold.
SMALLEST_LARGE, LARGEST_SMALL = 192, 256
#: Estimates this far below the threshold are dropped: four standard errors, sqrt(0.75 * 0.25 / 128) each.
MARGIN = 0.153
CHUNK_BYTES = 500_000
#: Classes of one band that meet in one block.
BLOCK = 256
#: And the shingles of a block's classes (8 bytes each), so that long documents make smaller blocks.
BLOCK_SHINGLES = 1_000_000
#: Document ids up to this many (8 bytes each) are broadcast to fetch texts; beyond, the join shuffles.
BROADCAST_IDS = 200_000

_MULTIPLIERS = np.random.Generator(np.random.PCG64(75)).integers(1, 2**63, REGISTERS, dtype=np.uint64) * U(2) + U(1)


def shingle_sets(texts: list[bytes | None], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer than k words the whole sequence is one; without words, none."""
    words = Words(texts, WHITESPACE, fold_ascii=True)
    pos, grams = words.grams(k)
    cut = np.searchsorted(pos, words.first)
    out = []
    for i in range(len(texts)):
        a, b = words.first[i], words.first[i + 1]
        if a == b:
            out.append(np.empty(0, dtype=np.uint64))
        elif b - a < k:
            out.append(words.runs(np.array([a]), np.array([b])))
        else:
            out.append(np.unique(grams[cut[i] : cut[i + 1]]))
    return out


def registers(values: np.ndarray) -> np.ndarray:
    """Least hashes (as fractions of 2**64) to leading-zero count and mantissa bits, 16 bits together."""
    high = np.frexp(np.maximum(values, U(1)).astype(np.float64))[1]
    # rounding to double may carry into the next power of two
    high = np.where((high > 64) | (values >> np.minimum(high - 1, 63).astype(np.uint64) == 0), high - 1, high)
    zeros = np.minimum(64 - high, 61)
    mantissa = (values << (zeros + 1).astype(np.uint64)) >> U(64 - MANTISSA)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)


def sketch(s: np.ndarray) -> tuple[bytes | None, bytes | None]:
    """The registers for small sets and the bucketed ones, each None where the set's size doesn't call for it."""
    small = large = None
    if len(s) and len(s) <= LARGEST_SMALL:
        small = registers((s[None, :] * _MULTIPLIERS[:, None]).min(axis=1)).tobytes()
    if len(s) >= SMALLEST_LARGE:
        bucket = (s >> U(64 - BUCKET_BITS)).astype(np.int64)
        first = np.searchsorted(bucket, np.arange(REGISTERS))
        full = np.zeros(REGISTERS, dtype=bool)
        full[bucket] = True
        out = np.full(REGISTERS, EMPTY)
        out[full] = registers(s[first[full]] << U(BUCKET_BITS))
        large = out.tobytes()
    return small, large


def band_keys(small: bytes | None, large: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the bands of both sketches and the bands' places, BANDS for each kind; a band of empty registers has none."""
    keys, places = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    for kind, regs in enumerate((small, large)):
        if regs is not None:
            bands = np.frombuffer(regs, dtype=np.uint64)
            place = kind * BANDS + np.arange(BANDS)
            full = bands != U(0xFFFFFFFFFFFFFFFF)
            keys.append(mix(bands + mix(place.astype(np.uint64) + U(1)))[full])
            places.append(place[full])
    return np.concatenate(keys), np.concatenate(places)


def collision(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability that registers over unrelated sets of a and b hashes (on average, for each register) agree by accident."""
    level = np.arange(62)[None, :]
    low, high = 2.0 ** -(level + 1.0), 2.0**-level
    a, b = a[:, None].astype(np.float64), b[:, None].astype(np.float64)
    p = low / 2**MANTISSA * a * b / (a + b) * (np.exp(-(a + b) * low) - np.exp(-(a + b) * high))
    return (p / ((1 - np.exp(-a)) * (1 - np.exp(-b)))).sum(axis=1)


def estimate(agree: np.ndarray, either: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, bucketed: np.ndarray) -> np.ndarray:
    """Jaccard similarity from agreeing and used registers, corrected for accidental collisions."""
    share = np.where(bucketed, 1 / REGISTERS, 1.0)
    p = collision(n_a * share, n_b * share)
    return (agree / np.maximum(either, 1) - p) / (1 - p)


def estimate_pairs(a: list[tuple], b: list[tuple]) -> np.ndarray:
    """Estimates for parallel lists of (n, small, large); -1 where the sizes alone rule the pair out."""
    out = np.full(len(a), -1.0)
    n_a, n_b = np.array([x[0] for x in a], dtype=np.float64), np.array([x[0] for x in b], dtype=np.float64)
    close = DENOMINATOR * np.minimum(n_a, n_b) >= NUMERATOR * np.maximum(n_a, n_b)
    for kind in (1, 2):
        at = np.flatnonzero(close & (out < 0) & np.array([x[kind] is not None and y[kind] is not None for x, y in zip(a, b, strict=True)], dtype=bool))
        if len(at):
            x = np.frombuffer(b"".join([a[i][kind] for i in at]), dtype=np.uint16).reshape(-1, REGISTERS)
            y = np.frombuffer(b"".join([b[i][kind] for i in at]), dtype=np.uint16).reshape(-1, REGISTERS)
            used = (x != EMPTY) | (y != EMPTY)
            out[at] = np.maximum(estimate(((x == y) & used).sum(axis=1), used.sum(axis=1), n_a[at], n_b[at], np.full(len(at), kind == 2)), -0.5)
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The contract's rule on two sorted sets."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


_SKETCHED = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("small", T.BinaryType()), T.StructField("large", T.BinaryType())])


def _sketches(batches):
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
        for part_ids, part in chunks([ids, texts], 1, CHUNK_BYTES):
            rows: list[list] = [[], [], [], [], []]
            for s in shingle_sets(part):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                one = int.from_bytes(digest[:8], "little", signed=True) if digest else None
                two = int.from_bytes(digest[8:], "little", signed=True) if digest else None
                for column, value in zip(rows, (len(s), one, two, *sketch(s)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(part_ids, pa.int64()), *[pa.array(c, pa.int64()) for c in rows[:3]], *[pa.array(c, pa.binary()) for c in rows[3:]]], names=_SKETCHED.names)


def _bands(batches):
    """Rows rep, n, small, large -> a row for each band."""
    for batch in batches:
        pairs = [band_keys(s, g) for s, g in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        times = [len(k) for k, _ in pairs]
        reps, sizes = (pa.array(np.repeat(batch.column(i).to_numpy(zero_copy_only=False), times), pa.int64()) for i in (0, 1))
        keys = np.concatenate([np.empty(0, dtype=np.uint64), *[k for k, _ in pairs]]).view(np.int64)
        places = np.concatenate([np.empty(0, dtype=np.int64), *[p for _, p in pairs]])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), reps, sizes, pa.array(places, pa.int32())], names=["band", "rep", "n", "place"])


def _sets(batches):
    for batch in batches:
        for ids, texts in chunks([batch.column(0).to_pylist(), text_bytes(batch.column(1))], 1, CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], names=["rep", "shingles"])


def _passing(batches):
    """Rows a, b, n_a, small_a, large_a, n_b, small_b, large_b -> the pairs whose estimate leaves hope."""
    for batch in batches:
        c = [x.to_pylist() for x in batch.columns[2:]]
        keep = pa.array(estimate_pairs(list(zip(*c[:3], strict=True)), list(zip(*c[3:], strict=True))) >= NUMERATOR / DENOMINATOR - MARGIN, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _verified(batches):
    for batch in batches:
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = pa.array([linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) for x, y in zip(left, right, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For rows of registers, the number of the first band that agrees and isn't empty; BANDS if none does."""
    same = (x.view(np.uint64) == y.view(np.uint64)) & (x.view(np.uint64) != U(0xFFFFFFFFFFFFFFFF))
    return np.where(same.any(axis=1), same.argmax(axis=1), BANDS)


def _open_pairs(key: tuple, group: pa.Table) -> pa.Table:
    """Block i of an open band's minor classes (side 0) and block j of all its classes (side 1) -> a row for each class with hope, and its partners.

    Pairs of different components whose estimate leaves hope, each pair in the first band that it shares only (and of two
    minor classes in one order), without the band's hubs, which were compared already.
    """
    band, i, j = (k.as_py() for k in key)
    rep, comp, minor, side = (np.array(group.column(k).to_pylist()) for k in ("rep", "comp", "minor", "side"))
    n = np.array(group.column("n").to_pylist(), dtype=np.float64)
    lo, hi, place = (group.column(k)[0].as_py() for k in ("lo", "hi", "place"))
    kind, number = divmod(place, BANDS)
    regs = np.frombuffer(b"".join(group.column(("small", "large")[kind]).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
    small = group.column("small").to_pylist() if kind else []
    inner = (rep != lo) & (rep != hi)
    left, right = np.flatnonzero(inner & (side == 0)), np.flatnonzero(inner & (side == 1))
    rows: dict[int, list[int]] = {}
    for x in left:
        ok = (comp[right] != comp[x]) & (~minor[right] | (rep[right] > rep[x])) & (DENOMINATOR * np.minimum(n[right], n[x]) >= NUMERATOR * np.maximum(n[right], n[x]))
        at = right[ok]
        if not len(at):
            continue
        one, two = np.ascontiguousarray(np.broadcast_to(regs[x], (len(at), REGISTERS))), regs[at]
        used = (one != EMPTY) | (two != EMPTY)
        j_ = estimate(((one == two) & used).sum(axis=1), used.sum(axis=1), np.full(len(at), n[x]), n[at], np.full(len(at), kind == 1))
        at = at[(j_ >= NUMERATOR / DENOMINATOR - MARGIN) & (_first_shared(one, two) == number)]
        if kind and small[x] is not None:
            at = [y for y in at if small[y] is None or _first_shared(np.frombuffer(small[x], dtype=np.uint16)[None, :], np.frombuffer(small[y], dtype=np.uint16)[None, :])[0] == BANDS]
        if len(at):
            rows.setdefault(int(rep[x]), []).extend(int(r) for r in rep[at])
            for r in rep[at]:
                rows.setdefault(int(r), [])
    count = len(rows)
    return pa.table({"band": pa.array([band] * count, pa.int64()), "i": pa.array([i] * count, pa.int32()), "j": pa.array([j] * count, pa.int32()), "rep": pa.array(list(rows), pa.int64()), "partners": pa.array(list(rows.values()), pa.list_(pa.int64()))})


def _open_links(group: pa.Table) -> pa.Table:
    """The same blocks with the full sets -> linked pairs."""
    sets: dict[int, dict[bytes, np.ndarray]] = {}  # an id that repeats has several
    for r, s in zip(group.column("rep").to_pylist(), group.column("shingles").to_pylist(), strict=True):
        sets.setdefault(r, {})[s] = np.frombuffer(s, dtype=np.uint64)
    pairs = {(x, y) for x, partners in zip(group.column("rep").to_pylist(), group.column("partners").to_pylist(), strict=True) for y in partners if y in sets}
    found = [(max(x, y), min(x, y)) for x, y in pairs if any(linked(one, two) for one in sets[x].values() for two in sets[y].values())]
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, shingles) for the ids in `wanted`."""
    ids = stored(wanted.distinct().toDF("want"), "neardup-wanted")
    small = ids.count() <= BROADCAST_IDS
    return stored(docs.join(F.broadcast(ids) if small else ids, F.col("id") == F.col("want"), "left_semi").select("id", "text").mapInArrow(_sets, "rep long, shingles binary"), "neardup-sets")


def _estimated(star: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b) of members a and hubs b -> those whose estimate leaves hope."""
    a = reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("small").alias("small_a"), F.col("large").alias("large_a"))
    b = reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("small").alias("small_b"), F.col("large").alias("large_b"))
    met = spread_join(star.join(a, "a"), b, ["b"], star.groupBy("b").agg(F.count(F.lit(1)).alias("n")), ["a"])
    return met.select("a", "b", "n_a", "small_a", "large_a", "n_b", "small_b", "large_b").mapInArrow(_passing, "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of members a and hubs b -> those that the full sets link."""
    left, right = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("left")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("right"))
    met = spread_join(pairs.join(left, "a"), right, ["b"], pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), ["a"])
    return met.select("a", "b", "left", "right").mapInArrow(_verified, "a long, b long")


def _hub_links(members: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between the classes of each band and its smallest and greatest one."""
    up = members.where("rep > lo").select(F.col("rep").alias("a"), F.col("lo").alias("b"))
    down = members.where("lo < rep and rep < hi").select(F.col("rep").alias("a"), F.col("hi").alias("b"))
    star = stored(up.unionByName(down).distinct(), "neardup-star")
    pairs = stored(_estimated(star, reps), "neardup-pairs")
    sets = _full_sets(docs, pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))))
    links = stored(_verify(pairs, sets), "neardup-links")
    drop_stored(star, pairs, sets)
    return links


def _open_band_links(members: DataFrame, merged: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Links within bands that still hold several components; of two classes only, one compared the other in full already."""
    labelled = members.join(merged, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component")
    labelled = stored(labelled, "neardup-labelled")
    tallies = labelled.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("weight"))
    bands = tallies.groupBy("band").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("k", "comp", "weight")).alias("top"), F.sum("k").alias("total"), F.sum("weight").alias("weight")).where("comps > 1 and total > 2")

    def blocks(count, weight, name: str):
        return F.greatest(F.lit(1), F.ceil(count / BLOCK), F.ceil(weight / BLOCK_SHINGLES)).cast("int").alias(name)

    bands = stored(bands.select("band", "total", F.col("top.comp").alias("major"), blocks(F.col("total"), F.col("weight"), "all_blocks"), blocks(F.col("total") - F.col("top.k"), F.col("weight") - F.col("top.weight"), "minor_blocks")), "neardup-open")
    mine = spread_join(labelled, bands.drop("total"), ["band"], bands.select("band", F.col("total").alias("n")), ["rep"]).withColumn("minor", F.col("comp") != F.col("major")).drop("major")
    mine = mine.join(reps.select("rep", "n", "small", "large"), ["rep", "n"])

    def every(count: str):
        return F.sequence(F.lit(0), F.col(count) - 1)

    def own(count: str):
        return F.pmod(F.xxhash64("rep"), F.col(count)).cast("int")

    as_any = F.transform(every("minor_blocks"), lambda i: F.struct(i.alias("i"), own("all_blocks").alias("j"), F.lit(1).alias("side")))
    as_minor = F.transform(every("all_blocks"), lambda j: F.struct(own("minor_blocks").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    met = mine.withColumn("x", F.explode(F.when(F.col("minor"), F.concat(as_any, as_minor)).otherwise(as_any)))
    met = met.select("band", "x.i", "x.j", "x.side", "rep", "comp", "minor", "place", "lo", "hi", "n", "small", "large")
    hope = stored(met.groupBy("band", "i", "j").applyInArrow(_open_pairs, "band long, i int, j int, rep long, partners array<long>"), "neardup-hope")
    if hope.isEmpty():
        drop_stored(labelled, bands, hope)
        return docs.sparkSession.createDataFrame([], "a long, b long")
    sets = _full_sets(docs, hope.select("rep"))
    links = stored(hope.join(sets, "rep").groupBy("band", "i", "j").applyInArrow(_open_links, "a long, b long"), "neardup-links")
    drop_stored(labelled, bands, hope, sets)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component.

    component is the smallest id that the document reaches over links, its own included.  Null text and text without
    words have no shingle and are linked with nothing.  A null id is linked with nothing either and has a null component.
    Rows that repeat an id are one document: the links of either text are links of both.  Empty input gives an empty
    result.  Other columns of `docs` aren't looked at.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sketched = stored(docs.mapInArrow(_sketches, _SKETCHED), "neardup-sketches")
    filled = sketched.where("s1 is not null and id is not null")
    # equal sets have equal sketches, so the first will do
    classes = stored(filled.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("k"), *[F.first(c).alias(c) for c in ("n", "small", "large")]), "neardup-classes")
    reps = classes.select("rep", "n", "small", "large")
    # an id with several texts links their classes; nothing else can
    texts = sketched.where("id is not null").groupBy("id").agg(F.count_if(F.col("s1").isNull()).alias("none"), *[f("s1").alias(f"{f.__name__}1") for f in (F.min, F.max)], *[f("s2").alias(f"{f.__name__}2") for f in (F.min, F.max)])
    several = texts.where("min1 <> max1 or min2 <> max2 or (none > 0 and min1 is not null)").select("id")
    same = filled.join(several, "id", "left_semi").join(classes, ["s1", "s2"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    same = stored(same, "neardup-same")

    bands = stored(reps.mapInArrow(_bands, "band long, rep long, n long, place int"), "neardup-bands")
    hubs = stored(bands.groupBy("band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo < hi"), "neardup-hubs")
    members = stored(spread_join(bands, hubs.drop("k"), ["band"], hubs.select("band", F.col("k").alias("n")), ["rep"]), "neardup-members")
    drop_stored(bands, hubs)
    links = same.unionByName(_hub_links(members, reps, docs))
    merged = components(links)
    more = _open_band_links(members, merged, reps, docs)
    drop_stored(members)
    if not more.isEmpty():
        drop_stored(merged)
        merged = components(links.unionByName(more))

    found = classes.join(merged, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    rows = sketched.select("id", F.col("n").alias("n_shingles"), "s1", "s2")
    worded = spread_join(rows.where("s1 is not null and id is not null"), found, ["s1", "s2"], classes.select("s1", "s2", F.col("k").alias("n")), ["id"]).select("id", "n_shingles", "component")
    bare = rows.where("s1 is null and id is not null").join(merged, F.col("id") == F.col("node"), "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))
    nameless = rows.where("id is null").select("id", "n_shingles", F.lit(None).cast("long").alias("component"))
    return worded.unionByName(bare).unionByName(nameless)


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` (with doc_id and text) without the documents whose component has a smaller one; null ids stay."""
    found = near_duplicates(docs).groupBy(F.col("id").alias("n_id")).agg(F.min("component").alias("n_component"))
    gone = found.where("n_id <> n_component").select("n_id")
    return docs.join(gone, docs["doc_id"] == gone["n_id"], "left_anti")


def op3_neardup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.k = y.k AND x.doc_id > y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * shared >= 75 * (u.n + v.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
