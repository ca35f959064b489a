"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are lexicon densities (a small list of insults, and words and word beginnings learned from the labelled sample),
the proximity of second-person words to lexicon words, and rates of capitals, punctuation and obfuscation.  Learned
lexicons are cross-fitted: a training text's features come from the lexicon of the other fold, and so does the
prediction that the calibration sees.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, drop_stored, fresh, stored, table
from tidemark.llm.samples import crc_of, sample_ids

#: The classifier is fitted on at most so many labelled texts of either class.
TRAIN_PER_CLASS = 3000
THRESHOLD = 0.7
FOLDS, TREES, DEPTH, RATE, BINS, LEAF_L2, MIN_LEAF = 3, 60, 3, 0.15, 32, 1.0, 4
#: A learned word or beginning stands in this many toxic texts at least, with this log-odds ratio at least.
MIN_TEXTS, MIN_WEIGHT, PREFIXES = 3, 1.5, (5, 7)
NEAR = 5

# Common insults, and second-person words.
INSULTS = frozenset("arsehole asshole bastard bitch clown cretin disgusting dumb dumbass fool freak fucker garbage idiot imbecile jerk loser moron pathetic pig retard scum slut stupid trash vermin whore worthless".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())

_LEET = str.maketrans("013457@$!|", "oieastasil")
_STRIP = re.compile(r"[\W_]+")
_MIXED = re.compile(r"[^\W\d_][\d@$!|*.\-_]+[^\W\d_]|[\d@$!|*]+[^\W\d_]{2}")
_REPEAT = re.compile(r"(\w)\1{3}")
_UPPER = bytes(range(65, 91))


def tokens(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def forms(token: str) -> tuple[str, ...]:
    """The word in a token, and what it spells if digits and signs stand for letters."""
    if token.isalpha():
        return (token,)
    plain = _STRIP.sub("", token)
    if plain.isalpha() and _MIXED.search(token) is None:
        return (plain,)
    spelled = _STRIP.sub("", token.rstrip(".,;:!?)]}\"'").translate(_LEET))
    return (plain, spelled) if spelled != plain else (plain,)


def terms(text: str) -> set[str]:
    """The words of a text, and their beginnings marked by a tilde."""
    words = {w for token in set(tokens(text)) for w in forms(token) if w}
    out = set(words)
    for k in PREFIXES:
        out.update(f"{w[:k]}~" for w in words if len(w) > k)
    return out


def learn_lexicon(terms_: list[str], bad: np.ndarray, good: np.ndarray, n1: int, n0: int) -> dict[str, float]:
    """Log-odds ratios of the terms that toxic texts hold more often: `bad` of n1 toxic texts, `good` of n0 others."""
    weight = np.log((bad + 0.5) / (n1 - bad + 0.5)) - np.log((good + 0.5) / (n0 - good + 0.5))
    return {terms_[i]: float(weight[i]) for i in np.flatnonzero((bad >= MIN_TEXTS) & (weight >= MIN_WEIGHT))}


class Features:
    """Dense features of a text, given a lexicon.  What a token contributes is remembered, for up to MEMORY tokens."""

    COUNT, MEMORY = 17, 200_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, tuple | None] = {}
        self.marked = INSULTS | SECOND_PERSON | {w for w in lexicon if w[-1] != "~"}
        self.beginnings = [(k, {w[:-1] for w in lexicon if w[-1] == "~" and len(w) == k + 1}) for k in PREFIXES]

    def token(self, token: str) -> tuple | None:
        """(insult, person, obfuscated, word weights, prefix weights), or None for the many tokens without any."""
        word = token.rstrip(".,;:!?")
        if word.isalpha() and word not in self.marked and not any([word[:k] in held for k, held in self.beginnings if len(word) > k]) and _REPEAT.search(token) is None:
            return None  # what most tokens come to
        found = forms(token)
        insult, person = any(w in INSULTS for w in found), any(w in SECOND_PERSON for w in found)
        odd = (len(found) > 1) + (_REPEAT.search(token) is not None)
        weights = [self.lexicon[w] for w in found if w in self.lexicon]
        prefixes = [self.lexicon[p] for w in found for k in PREFIXES if len(w) > k and (p := f"{w[:k]}~") in self.lexicon]
        return (insult, person, odd, weights, prefixes) if insult or person or odd or weights or prefixes else None

    def __call__(self, text: str | None) -> list[float]:
        """Empty and null texts have all features 0."""
        words = tokens(text)
        n = len(words)
        if not n:
            return [0.0] * self.COUNT
        known, counts = self.known, Counter(words)
        if len(known) > self.MEMORY:
            known.clear()
        base = learned = prefixed = person = odd = strong = 0
        hit, second = set(), set()
        word_weights: list[float] = []
        prefix_weights: list[float] = []
        for token, k in counts.items():
            info = known.get(token, 0)
            if info is None:
                continue
            if info == 0:
                info = known[token] = self.token(token)
                if info is None:
                    continue
            insult, is_person, strange, weights, prefixes = info
            odd += k * strange
            if is_person:
                person += k
                second.add(token)
            if insult:
                base += k
                hit.add(token)
            if weights:
                learned += k
                strong += k * (max(weights) > 4)
                word_weights += weights
                hit.add(token)
            if prefixes:
                prefixed += k
                prefix_weights += prefixes
        near = 0
        if hit and second:
            marks = iter([*(i for i, w in enumerate(words) if w in second), n + NEAR + 1])
            last, ahead = -NEAR - 1, next(marks)
            for i, w in enumerate(words):
                while ahead <= i:
                    last, ahead = ahead, next(marks)
                near += w in hit and min(i - last, ahead - i) <= NEAR
        word_weights.sort(reverse=True)
        prefix_weights.sort(reverse=True)
        raw = text.encode()
        upper = len(raw) - len(raw.translate(None, _UPPER))
        return [
            math.log1p(n), base / n, math.log1p(base), learned / n, math.log1p(learned), math.log1p(strong), sum(word_weights[:1]), sum(word_weights[:3]), sum(word_weights[:8]),
            prefixed / n, sum(prefix_weights[:2]), sum(prefix_weights[:8]), person / n, near / n, upper / len(raw), (text.count("!") + text.count("?") + text.count("*")) / n, odd / n,
        ]


class Trees:
    """Boosted trees for the logistic loss on binned features; each tree is complete, of depth DEPTH."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.start = math.log(mean / (1 - mean))
        self.feature, self.cut, self.leaf = [], [], []
        margin = np.full(len(y), self.start)
        for _ in range(TREES if len(y) else 0):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), dtype=np.int64)
            feature, cut = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, BINS + 1, dtype=np.int64)
            for depth in range(DEPTH):
                first, width = 2**depth - 1, 2**depth
                best = np.full(width, 1e-6)
                for j in range(x.shape[1]):
                    key = node * (BINS + 1) + binned[:, j]
                    sums = [np.bincount(key, weights=v, minlength=width * (BINS + 1)).reshape(width, -1).cumsum(axis=1) for v in (g, h, np.ones(len(y)))]
                    (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
                    gain = gl**2 / (hl + LEAF_L2) + (gt - gl) ** 2 / (ht - hl + LEAF_L2) - gt**2 / (ht + LEAF_L2)
                    gain[(nl < MIN_LEAF) | (nt - nl < MIN_LEAF)] = 0
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    for k in np.flatnonzero(top > best):
                        best[k], feature[first + k], cut[first + k] = top[k], j, at[k]
                node = node * 2 + (binned[np.arange(len(y)), feature[first + node]] > cut[first + node])
            leaf = -RATE * np.bincount(node, weights=g, minlength=2**DEPTH) / (np.bincount(node, weights=h, minlength=2**DEPTH) + LEAF_L2)
            margin += leaf[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for depth in range(DEPTH):
                at = 2**depth - 1 + node
                node = node * 2 + (binned[rows, feature[at]] > cut[at])
            out += leaf[node]
        return out


class Isotonic:
    """Pool-adjacent-violators over (margin, label), read by interpolation."""

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        blocks: list[list[float]] = []
        for i in np.lexsort((y, margin)):
            m = float(margin[i])
            if blocks and blocks[-1][2] == m:
                blocks[-1][0] += float(y[i])
                blocks[-1][1] += 1
            else:
                blocks.append([float(y[i]), 1.0, m, m])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                s, n, _, high = blocks.pop()
                blocks[-1][0] += s
                blocks[-1][1] += n
                blocks[-1][3] = high
        points = [(m, (s + 0.01) / (n + 0.02)) for s, n, low, high in blocks for m in ((low, high) if low < high else (low,))]
        self.x, self.y = np.array([p[0] for p in points] or [0.0]), np.array([p[1] for p in points] or [0.5])

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.x, self.y)


class Model:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: dict[str, float], trees: Trees, calibration: Isotonic):
        self.features, self.trees, self.calibration = Features(lexicon), trees, calibration

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        x = np.array([self.features(t) for t in texts])
        return np.clip(self.calibration(self.trees.margin(x)), 0.0, 1.0)


def _sample_terms(batches):
    """(label, fold, text) -> (term, label, fold), each term of a text once."""
    for batch in batches:
        for label, fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            held = sorted(terms(text))
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([label] * len(held), pa.int32()), pa.array([fold] * len(held), pa.int32())], names=["term", "label", "fold"])


def _sample_features(lexicons: list[dict[str, float]]):
    def over(batches):
        made = [Features(x) for x in lexicons]
        for batch in batches:
            x = [made[fold](text) for fold, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["label", "fold", "x"])

    return over


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = TRAIN_PER_CLASS) -> Model | None:
    """Fit on a bounded sample of the labelled documents, whole texts; None if no text is labelled.

    Terms are counted and features made on the executors; the driver gets the terms of at least MIN_TEXTS toxic texts with
    their counts, and a row of features for each sampled text.
    """
    bounded_batches(docs.sparkSession)
    ids = sample_ids(labels, id_col, label_col, per_class)
    chosen = docs.select(F.col(id_col).alias("s_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "s_id").where("text is not null")
    sample = stored(chosen.select(F.col("s_class").cast("int").alias("label"), (F.col("s_at") % FOLDS).cast("int").alias("fold"), "text"), "toxicity-sample")

    def held(label: int, fold: int):
        return F.count_if((F.col("label") == label) & (F.col("fold") == fold)).alias(f"n{label}{fold}")

    cells = [held(label, fold) for label in (1, 0) for fold in range(FOLDS)]
    size = np.array(sample.agg(*cells).first(), dtype=np.int64).reshape(2, FOLDS)
    if not size.sum():
        return None
    counted = sample.mapInArrow(_sample_terms, "term string, label int, fold int").groupBy("term").agg(*cells)
    counted = counted.where(" + ".join(f"n1{k}" for k in range(FOLDS)) + f" >= {MIN_TEXTS}").toArrow().sort_by("term")
    names = counted.column("term").to_pylist()
    count = np.array([counted.column(i + 1).to_numpy() for i in range(2 * FOLDS)], dtype=np.int64).reshape(2, FOLDS, len(names))

    def lexicon(left_out: int | None) -> dict[str, float]:
        use = [k for k in range(FOLDS) if k != left_out]
        return learn_lexicon(names, count[0, use].sum(axis=0), count[1, use].sum(axis=0), int(size[0, use].sum()), int(size[1, use].sum()))

    rows = sorted(sample.mapInArrow(_sample_features([lexicon(k) for k in range(FOLDS)]), "label int, fold int, x array<double>").collect())
    drop_stored(sample)
    y, fold, x = np.array([r["label"] for r in rows], dtype=np.float64), np.array([r["fold"] for r in rows]), np.array([r["x"] for r in rows])
    out_of_fold = np.zeros(len(y))
    for k in range(FOLDS):
        out_of_fold[fold == k] = Trees(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(lexicon(None), Trees(x, y), Isotonic(out_of_fold, y))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 (`out_col`, with underscores in front if `docs` has it, see `fresh`); null and empty texts are scored too, 0 if nothing was learned.

    Rows are judged alone, by whole texts: ties and repeated rows get equal scores; empty input gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(fresh(docs, out_col), T.DoubleType())])
    at = docs.columns.index(text_col)

    def over(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            scores = model.score(texts) if model is not None else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(over, schema)


def learned_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels that may be learned from: crc32 of the id as text, modulo 3, isn't 1."""
    return labels.where(F.pmod(crc_of(F.col(id_col)), F.lit(3)) != 1)


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the documents that score `threshold` or more."""
    name = fresh(docs, "score")
    return score(docs, model, text_col, name).where(F.col(name) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Null texts are scored as empty ones; null labels teach nothing; rows that repeat an id are each scored by their text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, learned_rows(table(spark, sf_dir, "labels")))
    out = score(docs.select("doc_id", "text", (F.pmod(crc_of(F.col("doc_id")), F.lit(3)) == 1).alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
