"""Plain versions of the operators' results, and fixtures with the awkward cases."""

import hashlib
import random
import re

WORDS = [f"w{i}" for i in range(400)]
ODD = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, words string, score string, spans string, id string, unit string, key string, rep string, kept string, bucket string"


def frame(spark, rows):
    """(doc_id, text, lang, source) rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, g, s, len(t or ""), *["x"] * 11) for d, t, g, s in rows], ODD)


def corpus(seed=0, n=60):
    """Random documents with near copies, copies, repeated passages, nulls, empty and white texts, a long text, repeated rows."""
    r = random.Random(seed)
    passage = " ".join(r.choice(WORDS) for _ in range(70))
    short = " ".join(r.choice(WORDS) for _ in range(49))
    rows = []
    for i in range(n):
        t = [r.choice(WORDS) for _ in range(r.choice([0, 1, 3, 4, 5, 6, 8, 20, 60, 120, 200, 300, 420]))]
        if rows and r.random() < 0.35:
            t = (rows[r.randrange(len(rows))][1] or "").split()
            for _ in range(r.choice([0, 0, 1, 2, 6, 20])):
                if t:
                    t[r.randrange(len(t))] = r.choice(WORDS)
        if r.random() < 0.25:
            at = r.randrange(len(t) + 1)
            t = t[:at] + r.choice([passage, passage, short]).split() + t[at:]
        text = " ".join(w.upper() if r.random() < 0.02 else w for w in t)
        if r.random() < 0.3:
            text = text.replace(" ", "  \n", 2) + r.choice(["", " ", "\t", "\x0b", "\u00a0é"])
        rows.append((i * 3 + 1, text, "en", r.choice(["a", "b", "c", "é", None])))
    rows += [(10500, None, None, None), (10501, "", "en", "a"), (10502, " \n\t ", "en", "b"), (10503, " ".join(r.choice(WORDS) for _ in range(9000)), "en", "a"), rows[7], (10504, rows[7][1], "en", "c"), (10505, None, "en", "a")]
    r.shuffle(rows)
    return rows


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def white_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, found = set(), set()
    for item, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(body))
        n = min(13, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit.update(range(j, j + n))
                    found |= {str(item)} - {"None"}
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words)


def shingles(text):
    w = white_words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_components(rows):
    ids = sorted({d for d, *_ in rows if d is not None})
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t)) for d, t, *_ in rows if d is not None]
    for a, x in sets:
        for b, y in sets:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


def repeats(rows, window=50):
    first = {}
    for d, t, *_ in rows:
        w = white_words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t, *_ in rows:
        w = white_words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out)


def shares(sizes):
    total, most = 1.5 * sum(sizes), [2 * x for x in sizes]
    weight = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    capped = [False] * len(sizes)
    while True:
        rest = total - sum(m for m, c in zip(most, capped, strict=True) if c)
        free = sum(w for w, c in zip(weight, capped, strict=True) if not c)
        want = [m if c else rest * w / free for m, w, c in zip(most, weight, capped, strict=True)]
        above = [i for i, (x, m) in enumerate(zip(want, most, strict=True)) if not capped[i] and x > m + 1e-9]
        if not above:
            return want
        for i in above:
            capped[i] = True
