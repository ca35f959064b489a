"""Substring dedup by repeated-phrase automata.

A window is 50 consecutive words.  Candidates: winnowing picks, in each window, the smallest hash of its 25-word runs, so
equal windows pick equal hashes; hashes that stand in texts of one kind only are done with.  Confirmation: windows around
the others are grouped by hash; one that recurs belongs to the smallest document that holds it, and consecutive windows
of an owner join to a passage.  A text with copies is a passage as a whole, owned by its first copy.  Location: documents
are dealt to shards, each shard gets the passages whose owners its documents share windows with, compiles them to an
Aho-Corasick automaton over words, in blocks of 25 (each window of a passage holds a whole block), and streams its
documents through it; each hit is extended word by word against the passage, and a run of 50 words or more is a repeat.
Equal texts are streamed once as their first copy and once as a later one, and the rows of copies take what was located.
Shards are cut by the bytes of their documents, several of them make a task, and a passage on a third of all documents
is one row for each shard, so no task sees all its occurrences.
"""

from __future__ import annotations

import hashlib
import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, drop_stored, spread_join, stored, table, text_bytes
from tidemark.llm.kernels import Words, chunks, sliding_min

WINDOW = 50
CHUNK_BYTES = 500_000
#: Text bytes of the documents of one shard, about; and shards of a task, about, so that their differences even out.
SHARD_BYTES, TASK_SHARDS = 1_000_000, 4
_OUT_ROWS = 200_000


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: text number and hash of each picked run, then start and picked hash of each window."""
    half = window // 2
    pos, grams = words.grams(half)
    width = window - half + 1
    if len(grams) < width:
        none = np.empty(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none.astype(np.uint64)
    least = sliding_min(grams, width)
    # a window stays within one text: its first and its last run are consecutive words of it
    whole = words.doc[pos[: len(least)]] == words.doc[pos[width - 1 :]]
    edge = np.zeros(width - 1, dtype=np.uint64)
    most = ~sliding_min(~np.concatenate([edge, np.where(whole, least, 0), edge]), width)
    picked = most[: len(grams)] == grams
    starts = np.flatnonzero(whole)
    return words.doc[pos[picked]], grams[picked], pos[starts], least[starts]


def _rows(schema: T.StructType, arrays: list[pa.Array]):
    batch = pa.RecordBatch.from_arrays(arrays, names=schema.names)
    for at in range(0, batch.num_rows, _OUT_ROWS):
        yield batch.slice(at, _OUT_ROWS)


def picked_runs(docs: DataFrame, window: int) -> DataFrame:
    """(id, kind, text) -> (h, id, kind): the distinct picked runs of each text."""
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("id", T.LongType()), T.StructField("kind", T.LongType())])

    def over(batches):
        for batch in batches:
            for ids, kinds, texts in chunks([batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))], 2, CHUNK_BYTES):
                doc, h, _, _ = anchors(Words(texts), window)
                if len(h):
                    doc, h = _distinct(doc, h)
                    yield from _rows(schema, [pa.array(_signed(h)), pa.array(ids, pa.int64()).take(pa.array(doc)), pa.array(kinds, pa.int64()).take(pa.array(doc))])

    return docs.select("id", "kind", "text").mapInArrow(over, schema)


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def _candidate_windows(texts: list[bytes | None], picked: list, window: int):
    """Words, window starts, text numbers and window hashes of those windows whose pick is in the text's list."""
    words = Words(texts)
    _, _, starts, least = anchors(words, window)
    doc = words.doc[starts]
    keep = np.zeros(len(starts), dtype=bool)
    for i, wanted in enumerate(picked):
        a, b = np.searchsorted(doc, [i, i + 1])
        keep[a:b] = np.isin(least[a:b], np.asarray(wanted, dtype=np.int64).view(np.uint64))
    starts, doc = starts[keep], doc[keep]
    return words, starts, doc, words.runs(starts, starts + window)


def recurring_windows(marked: DataFrame, window: int) -> DataFrame:
    """(id, text, picked) -> (w, id), distinct."""
    schema = T.StructType([T.StructField("w", T.LongType()), T.StructField("id", T.LongType())])

    def over(batches):
        for batch in batches:
            for ids, texts, picked in chunks([batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()], 1, CHUNK_BYTES):
                _, _, doc, w = _candidate_windows(texts, picked, window)
                if len(w):
                    doc, w = _distinct(doc, w)
                    yield from _rows(schema, [pa.array(_signed(w)), pa.array(ids, pa.int64()).take(pa.array(doc))])

    return marked.select("id", "text", "picked").mapInArrow(over, schema)


def owned_passages(marked: DataFrame, window: int) -> DataFrame:
    """(id, text, picked, owned) -> (owner, text): the runs of windows whose hashes are in `owned`, words joined by one space."""
    schema = T.StructType([T.StructField("owner", T.LongType()), T.StructField("text", T.StringType())])

    def over(batches):
        for batch in batches:
            owners, out = [], []
            for ids, texts, picked, owned in chunks([batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()], 1, CHUNK_BYTES):
                words, starts, doc, w = _candidate_windows(texts, picked, window)
                for i, wanted in enumerate(owned):
                    a, b = np.searchsorted(doc, [i, i + 1])
                    own = starts[a:b][np.isin(w[a:b], np.asarray(wanted, dtype=np.int64).view(np.uint64))]
                    if not len(own):
                        continue
                    split = np.flatnonzero(np.diff(own) > 1) + 1
                    for run in np.split(own, split):
                        owners.append(ids[i])
                        out.append(b" ".join(words.raw[words.start[run[0]] : words.end[run[-1] + window - 1]].split()))
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=schema.names)

    return marked.select("id", "text", "picked", "owned").mapInArrow(over, schema)


def common(a: tuple, i: int, b: tuple, j: int) -> int:
    """How many items of a[i:] and b[j:] agree, by slices that double and then shrink."""
    n, step, grows, most = 0, 16, True, min(len(a) - i, len(b) - j)
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step = step * 2 if grows else step
        elif step == 1:
            break
        else:
            grows, step = False, step // 2
    return n


class Automaton:
    """Passages compiled for location in documents."""

    def __init__(self, passages: list[tuple[int, bytes]], window: int = WINDOW):
        self.window, self.block = window, window // 2
        self.ids: dict[bytes, int] = {}
        #: Word numbers of each passage, and the same backwards.
        self.passages: list[tuple[tuple[int, ...], tuple[int, ...]]] = []
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        places: dict[tuple[int, ...], dict[int, list[tuple[int, int]]]] = {}
        for owner, text in passages:
            numbers = tuple([self.ids.setdefault(w, len(self.ids) + 1) for w in text.split()])
            k = len(self.passages)
            self.passages.append((numbers, numbers[::-1]))
            for at in range(0, len(numbers) - self.block + 1, self.block):
                places.setdefault(numbers[at : at + self.block], {}).setdefault(owner, []).append((k, at))
        for key, where in places.items():
            self.trie.add_word(key, where)
        if places:
            self.trie.make_automaton()

    def repeats(self, doc_id: int, words: list[bytes], owners: set[int]) -> list[tuple[int, int]]:
        """Merged word ranges of `words` that are covered by windows of passages of smaller documents in `owners`.

        A hit whose passage, laid over the text, stays within the range found last can add nothing and isn't extended, so
        text that repeats itself costs no more than other text.
        """
        if not len(self.trie):
            return []
        get = self.ids.get
        text = tuple([get(w, 0) for w in words])
        back, size = text[::-1], len(text)
        done: dict[tuple[int, int], int] = {}
        spans: list[tuple[int, int]] = []
        a = b = 0
        for last, where in self.trie.iter(text):
            begin, end = last - self.block + 1, last + 1
            for owner in where.keys() & owners:
                if owner >= doc_id:
                    continue
                for k, at in where[owner]:
                    passage, mirror = self.passages[k]
                    offset = begin - at
                    if (a <= max(0, offset) and min(size, offset + len(passage)) <= b) or done.get((k, offset), -1) > last:
                        continue
                    low = begin - common(mirror, len(passage) - at, back, size - begin)
                    high = end + common(passage, at + self.block, text, end)
                    done[k, offset] = high
                    if high - low >= self.window:
                        if low <= b and a <= high:
                            a, b = min(a, low), max(b, high)
                        else:
                            spans.append((a, b))
                            a, b = low, high
            if a == 0 and b == size:
                break
        out: list[tuple[int, int]] = []
        for a, b in sorted([*spans, (a, b)]):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            elif a < b:
                out.append((a, b))
        return out


_FOUND = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.StringType()), T.StructField("copied", T.BooleanType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))), T.StructField("kept", T.StringType())])
_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _located(automaton: Automaton, id_: int, key: str, copied: bool, text: bytes, owners: set[int]):
    """One row of _FOUND, or none without a hit."""
    words = text.split()
    spans = automaton.repeats(id_, words, owners)
    if spans:
        kept, last = [], 0
        for a, b in spans:
            kept += words[last:a]
            last = b
        kept += words[last:]
        yield id_, key, copied, [{"lo": a, "hi": b} for a, b in spans], b" ".join(kept)


def _locate(window: int):
    def rows(batches):
        """Rows (shard, is_doc, id, key, text, owners, copy) in the order of shard and is_doc, so that passages come first.

        A passage with a `copy` is a whole text that stands in a document with that id too, and is streamed as that.
        """
        shard, passages, copies, automaton = None, [], [], None

        def rest():
            if copies:
                made = automaton or Automaton(passages, window)
                for id_, key, text, owner in copies:
                    yield from _located(made, id_, key, True, text, {owner})

        for batch in batches:
            for s, is_doc, id_, key, text, owners, copy in zip(*[batch.column(i).to_pylist() for i in range(4)], text_bytes(batch.column(4)), *[batch.column(i).to_pylist() for i in (5, 6)], strict=True):
                if s != shard:
                    yield from rest()
                    shard, passages, copies, automaton = s, [], [], None
                if not is_doc:
                    passages.append((id_, text))
                    if copy is not None:
                        copies.append((copy, key, text, id_))
                    continue
                if automaton is None:
                    automaton, passages = Automaton(passages, window), []
                yield from _located(automaton, id_, key, False, text, set(owners))
        yield from rest()

    def over(batches):
        held, size = [], 0
        for row in rows(batches):
            held.append(row)
            size += len(row[4]) + 16 * len(row[3]) + 64
            if size > CHUNK_BYTES:
                yield _found(held)
                held, size = [], 0
        yield _found(held)

    return over


def _found(rows: list[tuple]) -> pa.RecordBatch:
    ids, keys, copied, spans, kept = zip(*rows, strict=True) if rows else ([],) * 5
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(copied, pa.bool_()), pa.array(spans, _SPANS), pa.array(kept, pa.binary()).cast(pa.string())], names=_FOUND.names)


def _dealt(routes: DataFrame, bytes_: int) -> DataFrame:
    """(id, owners, bytes) -> those and shard: documents with one smallest owner go together, unless they hold more than a shard."""
    bins = max(1, math.ceil(bytes_ / SHARD_BYTES))
    routes = routes.withColumn("main", F.array_min("owners"))
    groups = routes.groupBy("main").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("bytes") / SHARD_BYTES).alias("parts"))
    routes = spread_join(routes, groups.select("main", "parts"), ["main"], groups.select("main", "n"), ["id"])
    alone = F.xxhash64("main", F.pmod(F.xxhash64("id"), F.col("parts")))
    return routes.withColumn("shard", F.when(F.col("parts") > 1, alone).otherwise(F.pmod(F.xxhash64("main"), F.lit(bins)))).drop("main", "parts")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Repeated passages of `docs`: (found, copies).

    found: id, key (md5 of the text), copied, spans (word ranges [lo, hi) covered by windows that also start in a document
    with a smaller id), kept (the other words, joined by one space), for texts that lose words: as their first copy
    (copied is false, id is the smallest) and as a later copy (copied is true; what holds for one holds for each).
    copies: key, first (the smallest id with that text), n (documents with it).  Null texts have no words; null ids are no
    smaller document and lose nothing; rows that repeat an id are one document, which doesn't repeat itself; empty input
    gives empty results.  Other columns of `docs` aren't looked at.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null and text is not null")
    keyed = rows.withColumn("key", F.md5("text"))
    copies = stored(keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("bytes")), "passage-copies")
    runs = picked_runs(rows.withColumn("kind", F.xxhash64("text")), window)
    recurring = stored(runs.groupBy("h").agg(F.min("kind").alias("a"), F.max("kind").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("h", "n"), "passage-picks")
    picked = spread_join(runs.select("h", "id"), recurring.select("h"), ["h"], recurring, ["id"]).groupBy("id").agg(F.collect_set("h").alias("picked"))
    # a window takes that many bytes at least
    wanted = copies.where((F.col("last") > F.col("first")) & (F.col("bytes") >= 2 * window - 1)).select(F.col("first").alias("id"), "key", F.col("last").alias("copy"))
    wanted = copies.select(F.col("first").alias("id"), "key").join(picked, "id").join(wanted, ["id", "key"], "full")
    marked = stored(keyed.join(wanted, ["id", "key"]).select("id", "key", "text", "picked", "copy", F.octet_length("text").alias("bytes")), "passage-marked")
    drop_stored(recurring)
    searched = marked.where("picked is not null")
    windows = stored(recurring_windows(searched, window), "passage-windows")
    confirmed = stored(windows.groupBy("w").agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("owner < last").drop("last"), "passage-confirmed")
    owned = confirmed.groupBy(F.col("owner").alias("id")).agg(F.collect_list("w").alias("owned"))
    passages = stored(owned_passages(searched.join(owned, "id"), window).distinct(), "passage-owned")
    routes = spread_join(windows, confirmed.drop("n"), ["w"], confirmed.select("w", "n"), ["id"]).where("owner < id").groupBy("id").agg(F.collect_set("owner").alias("owners"))
    routes = stored(routes.join(marked.groupBy("id").agg(F.sum("bytes").alias("bytes")), "id"), "passage-routes")
    drop_stored(windows, confirmed)
    whole = marked.where("copy is not null")
    total = (routes.agg(F.sum("bytes")).first()[0] or 0) + (whole.agg(F.sum("bytes")).first()[0] or 0)
    dealt = stored(_dealt(routes, total), "passage-shards")
    drop_stored(routes)
    sent = dealt.select("shard", F.explode("owners").alias("owner")).distinct()
    sent = spread_join(sent, passages, ["owner"], sent.groupBy("owner").agg(F.count(F.lit(1)).alias("n")), ["shard"])
    none, no_id = F.array().cast("array<bigint>"), F.lit(None).cast("long")
    sent = sent.select("shard", F.lit(False).alias("is_doc"), F.col("owner").alias("id"), F.lit("").alias("key"), "text", none.alias("owners"), no_id.alias("copy"))
    bins = F.lit(max(1, math.ceil(total / SHARD_BYTES)))
    whole = whole.select(F.pmod(F.xxhash64("key"), bins).alias("shard"), F.lit(False).alias("is_doc"), "id", "key", "text", none.alias("owners"), "copy")
    read = searched.join(dealt, "id").select("shard", F.lit(True).alias("is_doc"), "id", "key", "text", "owners", no_id.alias("copy"))
    tasks = max(1, math.ceil(total / SHARD_BYTES / TASK_SHARDS))
    ready = sent.unionByName(whole).unionByName(read).repartition(tasks, "shard").sortWithinPartitions("shard", "is_doc", "id")
    return ready.mapInArrow(_locate(window), _FOUND), copies.select("key", "first", "n")


def word_count_bytes(docs: DataFrame) -> DataFrame:
    """(id, text) -> (id, key, n_words, plain): plain is the sha256 of all words joined by one space."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("plain", T.StringType())])

    def over(batches):
        for batch in batches:
            split = [t.split() if t else [] for t in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(w) for w in split], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in split], pa.string())], names=schema.names)

    return docs.select("id", "key", "text").mapInArrow(over, schema)


def op9_passages(spark, sf_dir: str) -> DataFrame:
    """Null and word-less texts lose nothing; a null doc_id is no smaller document and loses nothing; rows with one id don't repeat each other."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")
    found, copies = find_repeats(docs, "id")
    lost = F.struct(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"]).alias("n"), F.sha2("kept", 256).alias("sha"))
    located = found.groupBy("key").agg(F.max(F.when(~F.col("copied"), lost)).alias("as_first"), F.max(F.when(F.col("copied"), lost)).alias("as_copy"))
    one = copies.drop("n").join(located, "key", "left")
    rows = word_count_bytes(docs.where("text is not null").withColumn("key", F.md5("text")))
    rows = spread_join(rows, one, ["key"], copies.select("key", "n"), ["id"], "left")
    lost = F.when(F.col("id") > F.col("first"), F.col("as_copy")).when(F.col("id") == F.col("first"), F.col("as_first"))
    out = rows.select(F.col("id").alias("doc_id"), "n_words", F.coalesce(lost["n"], F.lit(0)).cast("long").alias("n_removed"), F.coalesce(lost["sha"], "plain").alias("kept_sha256"))
    none = F.lit(0).cast("long")
    return out.unionByName(docs.where("text is null").select(F.col("id").alias("doc_id"), none.alias("n_words"), none.alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept_sha256")))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
q AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS first FROM q GROUP BY k),
r AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS pos FROM q JOIN f USING (k) WHERE doc_id > first),
n AS (SELECT rid, count(*) AS n_removed FROM r GROUP BY rid),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT x.rid, string_agg(word, ' ' ORDER BY x.pos) AS t FROM x ANTI JOIN r ON r.rid = x.rid AND r.pos = x.pos GROUP BY x.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)
"""
