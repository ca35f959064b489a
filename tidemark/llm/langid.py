"""Language identification by string kernels.

A text is the set of byte n-grams it holds (letters only, A-Z lower-cased, everything else one space), for each n hashed
to 2**BITS places: it is places that are compared, and n-grams that share one are taken for one.  The blended
spectrum kernel of two texts is the mean over n of |common n-grams| / sqrt(|own| |other's|).  Nystroem features come from
a set of landmark texts; kernel ridge regression learns one score for each language against the rest.  As the kernel is
linear in the presence vectors, landmarks and weights fold into one matrix for each n, and a batch of texts is scored by
matrix products.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, fresh, table, text_bytes
from tidemark.llm.kernels import chunks
from tidemark.llm.samples import crc_of, sample_ids

GRAMS, BITS = (2, 3, 4), 13
#: The classifier is fitted on at most so many texts of each language; so many of each are landmarks, fewer where they would be more in all.
TRAIN_PER_LANG, LANDMARKS_PER_LANG, LANDMARKS, RIDGE = 300, 40, 1000, 0.1
UNKNOWN, SHARPNESS = "und", 6.0
BATCH_DOCS, BATCH_BYTES = 256, 1_000_000

_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
# An odd multiplier for each n spreads n-grams over 2**BITS places.
_SPREAD = {n: np.uint32(m) for n, m in zip(GRAMS, (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35), strict=True)}


def presence(texts: list[bytes | None]) -> np.ndarray:
    """(texts, len(GRAMS), 2**BITS) of 0 and 1: which n-gram places the whole texts hold."""
    size = 1 << BITS
    out = np.zeros((len(texts), len(GRAMS), size), dtype=np.float32)
    texts = [b" ".join(t.translate(_FOLD).split()) if t else b"" for t in texts]
    buf = np.frombuffer(b" ".join(texts), dtype=np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths + 1) - 1
    doc = np.repeat(np.arange(len(texts)), lengths + 1)[: len(buf)]
    code, flat = buf.copy(), out.reshape(-1)
    for n in range(2, max(GRAMS) + 1):
        code = (code[:-1] << np.uint32(8)) | buf[n - 1 :]
        if n in GRAMS and len(code):
            own = doc[: len(code)]
            inside = np.arange(len(code)) + n <= ends[own]
            place = (code[inside] * _SPREAD[n]) >> np.uint32(32 - BITS)
            flat[(own[inside] * len(GRAMS) + GRAMS.index(n)) * size + place] = 1
    return out


def normalised(x: np.ndarray) -> np.ndarray:
    """Each presence vector divided by the root of its size, so that dot products are kernel values."""
    return x / np.sqrt(np.maximum(x.sum(axis=2, keepdims=True), 1.0))


def unpacked(bits: list[bytes]) -> np.ndarray:
    """Normalised presence vectors, flat and scaled so that dot products are the blended kernel, from packed bits."""
    x = np.unpackbits(np.frombuffer(b"".join(bits), dtype=np.uint8)).reshape(len(bits), len(GRAMS), -1)
    return normalised(x.astype(np.float32)).reshape(len(bits), -1) / np.float32(np.sqrt(len(GRAMS)))


class KernelRidge:
    """One-versus-rest kernel ridge regression on Nystroem features."""

    def __init__(self, packed: list[bytes], classes: list[str], landmarks: list[int]):
        """packed: presence bits of the training texts, unpacked a few at a time; landmarks: numbers of some of them."""
        self.names = sorted(set(classes))
        own = unpacked([packed[i] for i in landmarks])
        value, vector = np.linalg.eigh((own @ own.T).astype(np.float64))
        keep = value > 1e-6 * max(value.max(), 1e-12)
        root = vector[:, keep] / np.sqrt(value[keep])
        size, counts = root.shape[1] + 1, Counter(classes)
        left, right = np.zeros((size, size)), np.zeros((size, len(self.names)))
        for at in range(0, len(packed), BATCH_DOCS):
            part = classes[at : at + BATCH_DOCS]
            features = np.hstack([(unpacked(packed[at : at + BATCH_DOCS]) @ own.T).astype(np.float64) @ root, np.ones((len(part), 1))])
            target = np.array([[1.0 if c == name else -1.0 for name in self.names] for c in part])
            # every language weighs alike
            weight = np.array([1.0 / counts[c] for c in part])[:, None] * len(classes) / len(self.names)
            left += features.T @ (weight * features)
            right += features.T @ (weight * target)
        penalty = RIDGE * np.eye(size)
        penalty[-1, -1] = 1e-6
        solved = np.linalg.solve(left + penalty, right)
        self.bias = solved[-1].astype(np.float32)
        self.matrix = (own.T.astype(np.float64) @ (root @ solved[:-1]) / np.sqrt(len(GRAMS))).astype(np.float32)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return normalised(presence(texts)).reshape(len(texts), -1) @ self.matrix + self.bias


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_PER_LANG, landmarks: int = LANDMARKS_PER_LANG) -> KernelRidge | None:
    """Fit on a bounded sample of `docs`; None if nothing is labelled."""
    bounded_batches(docs.sparkSession)
    ids = sample_ids(docs.where(F.rlike(F.col(text_col), F.lit(r"\p{L}"))), id_col, lang_col, per_lang)

    def over(batches):
        for batch in batches:
            for texts, ids_, langs in chunks([text_bytes(batch.column(2)), batch.column(0).to_pylist(), batch.column(1).to_pylist()], 0, BATCH_BYTES):
                bits = np.packbits(presence(texts).astype(bool).reshape(len(texts), -1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids_, pa.int64()), pa.array(langs, pa.string()), pa.array([b.tobytes() for b in bits], pa.binary())], names=["id", "lang", "bits"])

    # the sample's ids are bounded by per_lang for each language
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(ids.select(F.col("s_id").cast("long").alias("id"))), "id", "left_semi").where("lang is not null")
    rows = chosen.mapInArrow(over, "id long, lang string, bits binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["id"], bytes(r["bits"])))
    langs = [r["lang"] for r in rows]
    share, seen, marks = max(2, min(landmarks, LANDMARKS // len(set(langs)))), Counter(), []
    for i, lang in enumerate(langs):
        seen[lang] += 1
        if seen[lang] <= share:
            marks.append(i)
    return KernelRidge([bytes(r["bits"]) for r in rows], langs, marks)


def predict(docs: DataFrame, model: KernelRidge | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """`docs` with the predicted language and a score from 0 to 1; a name that `docs` has already gets underscores in front, see `fresh`.

    A text that is null or has no letter, or any text if nothing was learned, is `und` with score 0.  Whole texts are
    judged, rows alone: repeated rows get equal results; of equal scores the first language in code point order wins.
    """
    bounded_batches(docs.sparkSession)
    lettered, lang_out, score_out = (fresh(docs, n) for n in ("lang_lettered", lang_out, score_out))
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    width, at = len(docs.columns), docs.columns.index(text_col)

    def over(batches):
        for batch in batches:
            texts, letters = text_bytes(batch.column(at)), batch.column(width).to_pylist()
            langs: list[str] = [UNKNOWN] * len(texts)
            scores = [0.0] * len(texts)
            wanted = [i for i in range(len(texts)) if letters[i] and model is not None]
            for begin in range(0, len(wanted), BATCH_DOCS):
                for numbers, part in chunks([wanted[begin : begin + BATCH_DOCS], [texts[i] for i in wanted[begin : begin + BATCH_DOCS]]], 1, BATCH_BYTES):
                    s = model.scores(part).astype(np.float64)
                    e = np.exp(SHARPNESS * (s - s.max(axis=1, keepdims=True)))
                    best = s.argmax(axis=1)
                    sure = e[np.arange(len(part)), best] / e.sum(axis=1)
                    for i, b, p in zip(numbers, best.tolist(), sure.tolist(), strict=True):
                        langs[i], scores[i] = model.names[b], p
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.withColumn(lettered, F.coalesce(F.rlike(F.col(f"`{text_col}`"), F.lit(r"\p{L}")), F.lit(False))).mapInArrow(over, schema)


def op6_langid(spark, sf_dir: str) -> DataFrame:
    """Null, empty and letterless texts are `und`; rows without a lang teach nothing; null doc_ids are rows of their own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(crc_of(F.col("doc_id")), F.lit(4)) == 2
    model = fit(docs.where(~held))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
