"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are the 13-word windows of benchmark items (an item of 1 to 12 words is one window).  A shift table over
blocks of three words tells how far the search may jump; a block that ends some test string opens the bucket of test
strings with that suffix, a hash of the whole window selects one there, and direct comparison of all words confirms.
Text without benchmark phrases is visited once in eleven words.

A benchmark of more than MATCHER_WORDS words is searched for in several passes over the texts.  A pass writes the digest,
ranges and items of those texts only that it found something in; these are merged by text and joined to the documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, drop_stored, fresh, spread_join, stored, table, text_bytes

WINDOW = 13
BLOCK = 3
#: Benchmark words compiled into the matchers of one pass; a worker holds no more than these, the driver twice these and one item.
MATCHER_WORDS = 250_000
#: Rows of hits up to this many are broadcast to the documents if their ranges and items are as few; beyond, the join shuffles.
BROADCAST_HITS = 50_000
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Words are runs of 0-9, a-z (after lower-casing A-Z) and everything outside ASCII.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class WuManber:
    """Shift table and suffix buckets for test strings of one length (in words)."""

    def __init__(self, patterns: dict[tuple[bytes, ...], tuple], length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.shift: dict[tuple[bytes, ...], int] = {}
        # a bucket's dict hashes the whole window and then compares it
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], tuple]] = defaultdict(dict)
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, length), length - end)
            self.buckets[words[length - self.block :]][words] = items
        self.buckets = dict(self.buckets)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple]]:
        """Start of each occurrence, with the items of its test string."""
        size, block, far, shift = self.length, self.block, self.length - self.block + 1, self.shift
        end, n = size, len(words)
        while end <= n:
            key = tuple(words[end - block : end])
            step = shift.get(key, far)
            if not step:
                items = self.buckets[key].get(tuple(words[end - size : end]))
                if items is not None:
                    yield end - size, items
                step = 1
            end += step


def compile_matchers(items: list[tuple[object, list[bytes]]], window: int = WINDOW) -> list[WuManber]:
    """One matcher for each length of test strings; items without words have none."""
    by_length: dict[int, dict[tuple[bytes, ...], set]] = defaultdict(lambda: defaultdict(set))
    for item, held in items:
        words = tuple(held)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            by_length[size][words[i : i + size]].add(item)
    return [WuManber({w: tuple(s) for w, s in found.items()}, size) for size, found in sorted(by_length.items())]


def search(matchers: list[WuManber], words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """Merged spans of hit words, and the items with occurring test strings."""
    spans, items = [], set()
    for m in matchers:
        for start, found in m.find(words):
            items.update(found)
            spans.append((start, start + m.length))
    return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _benchmark_parts(benchmark: DataFrame, id_col: str, text_col: str, limit: int, window: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items as word lists, `limit` words a part at most; a longer item is cut into pieces that overlap by window - 1 words."""
    limit = max(limit, window)
    part, held = [], 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        words = words_of(None if text is None else text.encode())
        for at in range(0, max(1, len(words) - window + 1), limit - window + 1):
            piece = words[at : at + limit]
            if part and held + len(piece) > limit:
                yield part
                part, held = [], 0
            part.append((item, piece))
            held += len(piece)
    yield part


_RANGES = T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))
_RANGES_ARROW, _ITEMS_ARROW = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])), pa.list_(pa.string())


def _arrays(found: list[tuple[list[tuple[int, int]], set]]) -> list[pa.Array]:
    spans = pa.array([[{"lo": a, "hi": b} for a, b in s] for s, _ in found], _RANGES_ARROW)
    return [spans, pa.array([sorted(x for x in items if x is not None) for _, items in found], _ITEMS_ARROW)]


def _search_all(docs: DataFrame, text_col: str, names: dict[str, str], part, window: int) -> DataFrame:
    """One narrow pass: `docs` with n_words, spans and items."""
    schema = T.StructType([*docs.schema.fields, T.StructField(names["n_words"], T.LongType()), T.StructField(names["spans"], _RANGES), T.StructField(names["items"], T.ArrayType(T.StringType()))])
    matchers, at = compile_matchers(part, window), docs.columns.index(text_col)

    def over(batches):
        for batch in batches:
            counts, found = [], []
            for text in text_bytes(batch.column(at)):
                words = words_of(text)
                counts.append(len(words))
                found.append(search(matchers, words))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), *_arrays(found)], names=schema.names)

    return docs.mapInArrow(over, schema)


def _search_hits(texts: DataFrame, part, window: int) -> DataFrame:
    """(key, text) -> (key, spans, items) of the texts with a hit."""
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("spans", _RANGES), T.StructField("items", T.ArrayType(T.StringType()))])
    matchers = compile_matchers(part, window)

    def over(batches):
        for batch in batches:
            found = [search(matchers, words_of(t)) for t in text_bytes(batch.column(1))]
            keep = [i for i, (spans, _) in enumerate(found) if spans]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())).cast(pa.binary()), *_arrays([found[i] for i in keep])], names=schema.names)

    return texts.mapInArrow(over, schema)


def _merged(batches):
    """(key, n, all: array of (spans, items)) -> (key, n, spans, items)."""
    for batch in batches:
        found = [(merge([(s["lo"], s["hi"]) for x in held for s in x["spans"]]), {i for x in held for i in x["items"]}) for held in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), batch.column(1), *_arrays(found)], names=["key", "n", "spans", "items"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, matcher_words: int = MATCHER_WORDS) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with three columns more: n_words, spans (array of hit word ranges [lo, hi)), items (sorted item ids as strings).

    Returns the frame and the names the three columns got (they dodge columns of `docs`).  A benchmark of up to
    `matcher_words` words needs one narrow pass, without a shuffle; a larger one as many passes as parts, which write hits
    but no text, and one join.  Null text has no words.  A null item id contaminates, but isn't listed.  Repeated rows,
    ties and empty tables need no care: each row is judged alone.
    """
    bounded_batches(docs.sparkSession)
    names = {k: fresh(docs, k) for k in ("n_words", "spans", "items")}
    parts = _benchmark_parts(benchmark, item_col, item_text_col, matcher_words, window)
    part, following = next(parts), next(parts, None)
    if following is None:
        return _search_all(docs, text_col, names, part, window), names
    # the documents' own columns stay in a struct, so that no name of theirs clashes with ours
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.col("doc")[text_col].cast("string")
    salt = [F.col("doc")[f.name] for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
    # rows without a text match nothing; a key of their own keeps them apart
    keyed = whole.withColumn("key", F.coalesce(F.unhex(F.sha2(text, 256)), F.xxhash64(*salt).cast("string").cast("binary")))
    texts = keyed.where(text.isNotNull()).select("key", text.alias("text"))
    found = [stored(_search_hits(texts, p, window), "decontamination-hits") for p in (part, following)]
    found += [stored(_search_hits(texts, p, window), "decontamination-hits") for p in parts]
    hits = found[0].withColumn("pass", F.lit(0))
    for k, f in enumerate(found[1:], 1):
        hits = hits.unionByName(f.withColumn("pass", F.lit(k)))
    one = hits.groupBy("key", "pass").agg(F.count(F.lit(1)).alias("n"), F.any_value("spans").alias("spans"), F.any_value("items").alias("items"))
    merged = one.groupBy("key").agg(F.max("n").alias("n"), F.collect_list(F.struct("spans", "items")).alias("all"))
    merged = stored(merged.mapInArrow(_merged, T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("spans", _RANGES), T.StructField("items", T.ArrayType(T.StringType()))])), "decontamination-merged")
    drop_stored(*found)
    rows, size = merged.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans") + F.size("items")), F.lit(0))).first()
    if rows <= BROADCAST_HITS and size <= BROADCAST_HITS:
        joined = keyed.join(F.broadcast(merged.drop("n")), "key", "left")
    else:
        joined = spread_join(keyed, merged.drop("n"), ["key"], merged.select("key", "n"), salt, "left")
    n = F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    extra = [n.alias(names["n_words"]), F.coalesce("spans", F.array().cast(_RANGES)).alias(names["spans"]), F.coalesce("items", F.array().cast("array<string>")).alias(names["items"])]
    return joined.select(*[F.col("doc")[c].alias(c) for c in docs.columns], *extra), names


def hit_words(spans):
    """Number of hit words, from the spans column."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])


def contaminated(n_hit, n_words):
    """The rule: at least one hit word, and at least a twentieth of all words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` without the documents that the rule calls contaminated; clean ones are unchanged."""
    found, names = find_contamination(docs, benchmark, text_col)
    return found.filter(~contaminated(hit_words(F.col(names["spans"])), F.col(names["n_words"]))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Null and word-less texts have no words and no hit; null items none; a null item_id contaminates, but isn't listed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, names = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    out = found.select("doc_id", F.col(names["n_words"]).alias("n_words"), hit_words(F.col(names["spans"])).alias("n_hit"), F.col(names["items"]).alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (SELECT item, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM p),
q AS (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM pat) WHERE len(w) >= m),
hit AS (SELECT rid, i, q.m, item FROM q JOIN pat ON pat.m = q.m AND pat.k = array_to_string(q.w[q.i:q.i + q.m - 1], ' ')),
cover AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS pos FROM hit) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN named USING (rid)
"""
