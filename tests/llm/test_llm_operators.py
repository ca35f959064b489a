import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import components, decontaminate, kernels, langid, lines, media, mixing, neardup, passages, sharding, toxicity, urls


def table_of(spark, tmp_path, rows, name="documents"):
    brute.frame(spark, rows).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


# ---- kernels


def test_words_match_split():
    texts = [b"a bb  ccc", None, b"", b"  x\ty\n", "é A Z".encode(), b"a bb"]
    w = kernels.Words(texts, fold_ascii=True)
    got = [[w.buf[s:e].tobytes() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [[x.lower() if x.isascii() else x for x in (t or b"").split()] for t in texts]
    assert w.hash[0] == w.hash[w.first[5]] and len({*w.hash.tolist()}) == len({x for t in got for x in t})


def test_runs_depend_on_words_alone():
    a, b = kernels.Words([b"q a b c d e z"]), kernels.Words([b"x", b"a  b c d e"])
    assert set(a.grams(5)[1].tolist()) & set(b.grams(5)[1].tolist())
    assert len(b.grams(5)[0]) == 1 and len(kernels.Words([b"a b", b"c d e"]).grams(5)[0]) == 0


@given(st.lists(st.integers(0, 50), min_size=8, max_size=60), st.integers(1, 8))
def test_sliding_min(xs, width):
    assert kernels.sliding_min(np.array(xs), width).tolist() == [min(xs[i : i + width]) for i in range(len(xs) - width + 1)]


# ---- 1 decontamination


def test_decontamination(spark, tmp_path):
    rows = brute.corpus(1)
    r = random.Random(9)
    items = [(i, " ".join(brute.WORDS[(i * 7 + k) % 400] for k in range(n))) for i, n in enumerate([40, 13, 14, 5, 1, 0, 2])] + [(50, None), (51, "--- !!"), (None, "only here now"), (3, "w1 W2, w3")]
    for _ in range(25):
        body = (r.choice([b for _, b in items if b]) or "").split()
        rows.append((600 + len(rows), " ".join([*(r.choice(brute.WORDS) for _ in range(r.randrange(60))), *body[: r.randrange(20)], "END", *body[-r.randrange(1, 30) :]]), "en", "a"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, decontaminate.op1_decontaminate(spark, table_of(spark, tmp_path, rows)).collect()))
    want = []
    for d, t, *_ in rows:
        want.append((d, *brute.contamination(t, items)))
    assert got == sorted(want)
    assert sum(x[5] for x in got) > 3


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_decontamination_in_passes_is_the_same(spark, monkeypatch, broadcast):
    from tidemark.llm import common

    monkeypatch.setattr(decontaminate, "BROADCAST_HITS", broadcast)
    monkeypatch.setattr(common, "SPREAD_ROWS", 4)
    written, searched = [], []
    real, search = decontaminate.stored, decontaminate._search_hits
    monkeypatch.setattr(decontaminate, "stored", lambda df, name: written.append(df.columns) or real(df, name))
    monkeypatch.setattr(decontaminate, "_search_hits", lambda docs, part, window: searched.append(sum(len(w) for _, w in part)) or search(docs, part, window))
    rows = brute.corpus(2, 30)
    rows += [(2000 + i, rows[3][1], "en", "a") for i in range(20)]
    items = [(i, " ".join((rows[i * 3][1] or "w1 w2").split()[:25])) for i in range(8)] + [(8, " ".join(" ".join(t for _, t, *_ in rows[:9] if t).split()[:70])), (None, "w1 w2")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = brute.frame(spark, rows).withColumns({c: F.lit(1) for c in ("key", "doc", "n", "j_salt", "items")})
    one, names = decontaminate.find_contamination(docs, benchmark)
    assert not searched
    many, same = decontaminate.find_contamination(docs, benchmark, matcher_words=40)
    assert names == same and names["spans"] == "_spans" and names["items"] == "_items" and set(docs.columns) < set(one.columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    # many passes, the long item in pieces, and no text in what they write
    assert len(searched) >= 5 and max(searched) <= 40 and len(items[8][1].split()) == 70
    assert all("text" not in c and "doc" not in c for c in written) and len(written) == len(searched) + 1


def test_decontamination_of_nothing(spark):
    rows = brute.corpus(2, 30)
    docs, items = brute.frame(spark, rows), spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert decontaminate.drop_contaminated(docs, items).columns == docs.columns
    assert decontaminate.drop_contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == len(rows)


@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), min_size=1, max_size=6))
@settings(max_examples=200)
def test_wu_manber(text, patterns):
    items = [(i, [c.encode() for c in p]) for i, p in enumerate(patterns)]
    matchers = decontaminate.compile_matchers(items, window=4)
    got = sorted((m.length, at) for m in matchers for at, _ in m.find([c.encode() for c in text]))
    want = set()
    for p in patterns:
        n = min(4, len(p))
        want |= {(n, j) for i in range(len(p) - n + 1) for j in range(len(text) - n + 1) if text[j : j + n] == p[i : i + n]}
    assert got == sorted(want)


# ---- 2 sharding


def best_capacity(sizes, k):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        used, fill = 1, 0
        for x in sizes:
            used, fill = (used + 1, x) if fill + x > mid else (used, fill + x)
        low, high = (low, mid) if used <= k else (mid + 1, high)
    return low


@pytest.mark.parametrize(("sizes", "shards"), [([5, 9, 2, 7, 4, 4, 8, 1], 3), ([100, 1, 1, 1, 1, 1], 3), ([1] * 30, 7), ([3], 4), ([7, 7], 2), ([50, 40, 1, 2, 3, 4, 5, 6], 4)])
def test_minimax_plan(spark, sizes, shards):
    units = spark.createDataFrame(list(enumerate(sizes)), "unit int, bytes long")
    plan = {r.unit: r.shard for r in sharding.minimax_plan(units, shards).collect()}
    assert sorted(plan) == list(range(len(sizes)))
    loads = Counter()
    for u, s in plan.items():
        loads[s] += sizes[u]
    order, rest, giants = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), sum(sizes), []
    for i in order[: shards - 1]:
        if sizes[i] * (shards - len(giants)) < rest:
            break
        giants.append(i)
        rest -= sizes[i]
    others = [x for i, x in enumerate(sizes) if i not in giants]
    if others:
        assert max([v for s, v in loads.items() if s >= len(giants)]) == best_capacity(others, shards - len(giants))
    assert max(loads) < shards
    walk = [plan[i] for i in range(len(sizes)) if i not in giants]
    assert walk == sorted(walk)


def test_sharding(spark, tmp_path):
    rows = brute.corpus(3, 150) + [(900 + i, "the same text again", "en", "a") for i in range(120)]
    got = sharding.op2_shard(spark, table_of(spark, tmp_path, rows)).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots, homes = defaultdict(list), defaultdict(set)
    for r in got:
        assert 0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        homes[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    again = sharding.op2_shard(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    whole = sharding.shard_corpus(brute.frame(spark, rows))
    assert whole.count() == len(rows) and whole.columns[-2:] == ["_shard", "slot"]
    assert sharding.shard(brute.frame(spark, rows[:0])).count() == 0


def test_large_groups_under_one_prefix(spark):
    """Two large groups whose digests begin alike are units of their own, so each gets a shard of its own."""
    seen, texts = {}, None
    while texts is None:
        t = f"text {len(seen)}"
        head = hashlib.md5(t.encode()).hexdigest()[: sharding.UNIT_DIGITS]
        texts = (seen[head], t) if head in seen else None
        seen.setdefault(head, t)
    rows = brute.corpus(3, 60) + [(2000 + i, texts[i % 2], "en", "a") for i in range(8000)]
    got = sharding.shard(brute.frame(spark, rows)).collect()
    homes = defaultdict(set)
    for r in got:
        homes[r.shard].add(r.text_crc32)
    own = [zlib.crc32(t.encode()) for t in texts]
    assert sorted(next(iter(c)) for c in homes.values() if c & set(own)) == sorted(own) and all(len(c) == 1 for c in homes.values() if c & set(own))
    assert sharding.unit_starts(spark.createDataFrame([], "digest long, size long")).count() == 0
    sizes = spark.createDataFrame([(5, 100), (5, 100), (6, 100), (9, 1), (1 << 50, 3)], "digest long, size long")
    assert [(r.prefix, sorted(r.starts)) for r in sharding.unit_starts(sizes, 1).collect()] == [(0, [5, 6, 6, 7])]


# ---- 3 near duplicates


@pytest.mark.parametrize(("seed", "broadcast"), [(4, 200_000), (5, 0)])
def test_near_duplicates(spark, tmp_path, monkeypatch, seed, broadcast):
    monkeypatch.setattr(neardup, "BROADCAST_IDS", broadcast)
    rows = brute.corpus(seed, 120)
    got = neardup.op3_neardup(spark, table_of(spark, tmp_path, rows)).collect()
    want = brute.near_components(rows)
    assert len(set(want.values())) < len(want) - 10
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((d, len(brute.shingles(t)), want[d], want[d] == d) for d, t, *_ in rows)


def test_near_duplicate_edges(spark):
    rows = [(1, "a b c d e f g h", "en", "a"), (None, "a b c d e f g h", "en", "a"), (2, "A B C D E F G H", "en", "a"), (3, "a b", "en", "a"), (4, "a  b", "en", "a"), (5, None, None, None), (6, None, None, None), (7, " ", "en", "a"), (8, "", "en", "a")]
    got = {(r.id, r.n_shingles, r.component) for r in neardup.near_duplicates(brute.frame(spark, rows)).collect()}
    assert got == {(1, 4, 1), (None, 4, None), (2, 4, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8)}
    kept = neardup.keep_one(brute.frame(spark, rows))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 5), (False, 6), (False, 7), (False, 8), (True, 0)]
    assert neardup.near_duplicates(brute.frame(spark, rows).limit(0)).count() == 0


def test_large_group_without_all_pairs(spark, monkeypatch):
    """A cloud of near copies with chains and outsiders, in small blocks, gets the components of brute force."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    r = random.Random(11)
    base = [r.choice(brute.WORDS) for _ in range(150)]
    rows = []
    for i in range(150):
        t = base[:]
        for _ in range(r.choice([1, 3, 4, 5, 6, 8, 12])):
            t[r.randrange(len(t))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(t), "en", "a"))
    got = {x.id: x.component for x in neardup.near_duplicates(brute.frame(spark, rows)).collect()}
    want = brute.near_components(rows)
    assert got == want and 1 < len(set(want.values())) < 100


def test_registers_and_estimates():
    rng = np.random.default_rng(1)
    v = np.array([1, 2**63, 2**64 - 1, 2**40 + 12345, 3, 0], dtype=np.uint64)
    for x, got in zip(v.tolist(), neardup.registers(v).tolist(), strict=True):
        zeros = min(64 - x.bit_length() if x else 63, 61)
        assert got >> 10 == zeros and got & 1023 == (x << (zeros + 1) & 2**64 - 1) >> 54
    for n in (40, 200, 230, 2000):
        errors = []
        for share in (0.5, 0.75, 0.9):
            both = int(n * share)
            x = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            a, b = np.unique(x[:n]), np.unique(x[n - both :])
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(abs(neardup.estimate_pairs([(len(a), *neardup.sketch(a))], [(len(b), *neardup.sketch(b))])[0] - j))
        assert max(errors) < 0.16


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(30)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


# ---- 4 media


@given(st.binary(max_size=2000))
@settings(max_examples=60, deadline=None)
def test_stream_round_trip(data):
    payload = media.padded(data)
    x = media.demux(media.mux(payload))
    assert x["payload"] == payload and x["discontinuities"] == 0 and x["programs"] == {1: 0x1000} and x["streams"] == {0x100: 6}


@pytest.mark.parametrize("n", [192, 192 * 255, 192 * 256, 192 * 257, 192 * 1000])
def test_long_streams(n):
    payload = random.Random(n).randbytes(n)
    x = media.demux(media.mux(payload))
    units = -(-n // media.ACCESS_UNIT)
    assert x["payload"] == payload and x["pes"] == units and x["timestamps"] == [k * 3600 for k in range(units)] and x["random_access"] == [k * media.ACCESS_UNIT for k in range(units)]


def test_damaged_streams():
    s = media.mux(random.Random(1).randbytes(192 * 300))
    assert media.section_crc(b"123456789") == 0x0376E6E7
    repeated = s[: 188 * 5] + s[188 * 4 : 188 * 5] + s[188 * 5 :]
    assert media.demux(repeated)["payload"] == media.demux(s)["payload"]
    with pytest.raises(media.StreamError):
        media.demux(s[:-1])
    with pytest.raises(media.StreamError):
        media.demux(s[:10] + b"\0" + s[11:])
    lost = media.demux(s[: 188 * 300] + s[188 * 301 :])
    assert lost["discontinuities"] == 1 and len(lost["payload"]) < 192 * 300


def test_media(spark, tmp_path):
    rows = brute.corpus(6, 20)
    got = media.op4_media(spark, table_of(spark, tmp_path, rows)).collect()
    want = []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        pad = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        want.append((d, len(raw), len(pad), __import__("hashlib").sha256(pad).hexdigest(), zlib.crc32(pad[-16:])))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    by_text = defaultdict(set)
    for r in got:
        by_text[r.payload_sha256].add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    docs = brute.frame(spark, rows)
    parsed = media.parse_streams(media.to_streams(docs, "text"), "media")
    r = parsed.where("doc_id = 10503").first()
    assert bytes(r.parsed.payload).decode().rstrip(" ") == r.text and r.parsed.stream_pids == [0x100] and len(r.parsed.timestamps) == r.parsed.pes
    assert media.parse_streams(media.to_streams(docs.limit(0), "text"), "media").count() == 0


# ---- 5 URLs


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = brute.lower(rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1:] if fit else None


URLS = [
    None, "", "no scheme", "://", "http://", "http://com/en/", "http://COM/en/x", "https://a.example.com/en/7", "https://example.com/en/78?q#f", "https://notexample.com/en/7", "http://x.net/de/1", "http://x.example.net/de/8x",
    "http://example.net/de/9", "http://example.net/DE/8", "http://a.org/es/", "http://a.org/es", "http://a.org?x=/es/", "http://a.org#/es/", "x://b.com/en/://y", "http://u@com:80/en/", "http://www.cheap-pills.example.org/", "http://spam-farm/", "http://myspam-farm.net/",
    "http://a.com/en/\n", "http://é.com/en/", "http://a.com//en/", "http://net/de/", "http://.net/de/",
]


def plain(line):
    """A filter line as a regular expression, character by character."""
    body, out = line.removeprefix("@@"), ""
    if body.startswith("||"):
        body, out = body[2:], r"^(?:[^/]*\.)?"
    elif body.startswith("|"):
        body, out = body[1:], "^"
    end = body.endswith("|")
    for c in body[:-1] if end else body:
        out += {"*": ".*", "^": r"(?:[^0-9A-Za-z_.%-]|\Z)"}.get(c) or re.escape(c)
    return re.compile(out + (r"\Z" if end else ""), re.S)


SPAM_PLAIN = [(r, plain(r.line)) for r in urls.SPAM_RULES]


def other_verdict(host, path):
    fit = [r for r, p in SPAM_PLAIN if host and p.search(host + path)]
    return "block" if fit and not any(r.exception for r in fit) else "allow"


@pytest.mark.parametrize("inline", [500, 3])
def test_urls(spark, tmp_path, monkeypatch, inline):
    assert 200 < len(urls.SPAM_RULES) + len(urls.CONTRACT_RULES) <= 500
    monkeypatch.setattr(urls, "INLINE_RULES", inline)
    r = random.Random(3)
    made = []
    for _ in range(400):
        t, u = r.choice(urls.TRADES), r.choice(urls.TRADES)
        host = r.choice(["www.{}.net", "{}-x.org", "a-{}.com:80", "{}", "my{}.org", "www.best-{}s.de", "stop-{}.org", "plain.example", "best-{}.de"]).format(t)
        path = r.choice(["", "/", "/{}/", "/{}", "/{}s/", "/{}-new/offers", "/buy-{}?x=1", "/go/a/b/{}", "/{}-addiction", "/history-of-{}/x", "/é/{}/#f", "/A-{}/"]).format(u)
        made.append(f"http://{host}{path}")
    made += ["http://a.net/" + "poker-" * 20000 + "/offer", "http://" + "x" * 50000 + ".org/poker/"]
    rows = [(i, u, "x", "y") for i, u in enumerate([*URLS, *URLS[:5], *made])]
    spark.createDataFrame(rows, "page_id long, url string, html string, verdict2 string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in urls.op5_urls(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, u, *_ in rows:
        host, path, rule = judged(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule[0] if rule else None), u
        assert got[i].verdict == (rule[1] if rule else other_verdict(host, path)), u[:200]
    others = [x for x in got.values() if x.rule is None]
    assert sum(x.verdict == "block" for x in others) > 100 < sum(x.verdict == "allow" for x in others)


@pytest.mark.parametrize(("line", "tokens"), [("||a.b^", ["a", "b"]), ("/x/y*z/", ["x"]), ("foo", []), ("|www.best-x*.", ["best", "www"]), ("@@/a-b^", ["a", "b"]), ("/p|", ["p"]), ("x|", []), ("*", []), ("||*-q.", ["q"])])
def test_pattern_tokens(line, tokens):
    assert urls.Pattern(line).tokens == tokens


@pytest.mark.parametrize("inline", [500, 1])
def test_lines_of_a_filter_list(spark, monkeypatch, inline):
    """Every kind of mark, against plain expressions, each line alone and all together."""
    monkeypatch.setattr(urls, "INLINE_RULES", inline)
    lines_ = ["||a.b^", "/x/y*z/", "foo", "|www.", "@@/a-b^", "/p|", "||c", "*q*", "^k^", "|a.b|", "@@||d.e/x", "h*|"]
    hosts, paths = ["a.b", "x.a.b", "xa.b", "www.c", "c.d", "d.e", "foo.q", "a.b:8", "k"], ["", "/", "/x/yyz/", "/a-b", "/a-bc", "/p", "/p/", "/k/q", "/xq/foo", "/x\n"]
    df = spark.createDataFrame([(f"s://{h}{p}",) for h in hosts for p in paths], "url string")
    expect = {f"s://{h}{p}": {x for x in lines_ if plain(x).search(h + p)} for h in hosts for p in paths}
    for x in ([*lines_] if inline == 500 else []):
        got = {r.url for r in urls.judge(df, rule_sets=[[urls.Pattern(x)]]).where("rule is not null").collect()}
        assert got == {u for u, fit in expect.items() if x in fit}, x
    for r in urls.judge(df, rule_sets=[[urls.Pattern(x) for x in lines_]]).collect():
        best = max(expect[r.url], key=lambda x: (x.startswith("@@"), len(x), x), default=None)
        assert r.rule == best and r.verdict == ("allow" if best is None or best.startswith("@@") else "block")


def test_rarest_tokens(spark):
    r = urls.Rule("block", "example.com", "/en/7")
    assert r.tokens == ["com", "en", "example"]
    df = spark.createDataFrame([(["com", "en"],), (["com", "example"],), (["com"],), (["en"],), (["en"],)], "tokens array<string>")
    assert urls.rarest_tokens(df, [r])[r] == "example"


# ---- 6 languages


def speak(r, syllables, n):
    return " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_languages(spark, tmp_path):
    r = random.Random(1)
    tongues = {"aa": ["the", "ing", "er", "on"], "bb": ["der", "sch", "ung", "ß"], "cc": ["eau", "oi", "é", "ment"]}
    rows = [(i, speak(r, tongues[g], r.randrange(4, 80)), g, "s") for i in range(400) for g in [r.choice(list(tongues))]]
    rows += [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "12 -- !", "bb", "s"), (903, speak(r, tongues["cc"], 20000), None, "s"), rows[0]]
    got = langid.op6_langid(spark, table_of(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    truth = {d: g for d, _, g, _ in rows}
    held = [x for x in got if x.held_out and x.doc_id < 900]
    assert held and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    assert np.mean([x.lang_pred == truth[x.doc_id] for x in held]) > 0.95
    special = {x.doc_id: (x.lang_pred, x.score) for x in got}
    assert special[900] == special[901] == special[902] == ("und", 0.0) and special[903][0] == "cc"
    assert all(0 <= x.score <= 1 for x in got)
    assert langid.fit(brute.frame(spark, [])) is None
    assert {x.lang_pred for x in langid.predict(brute.frame(spark, rows[:3]), None).collect()} == {"und"}


def test_presence_is_the_set_of_ngrams():
    a, b = langid.presence([b"abc abc", b"ab", b"", None]), langid.presence([b"abc  ABC!"])
    assert (a[0] == b[0]).all() and a[1].sum() == 1 and a[2].sum() == a[3].sum() == 0
    x = langid.normalised(langid.presence([b"abcd", b"abcx"])).reshape(2, -1)
    assert abs(float(x[0] @ x[0]) / 3 - 1) < 1e-6 and abs(float(x[0] @ x[1]) / 3 - (2 / 3 + 1 / 2 + 0) / 3) < 1e-6


# ---- 7 toxicity


def test_toxicity(spark, tmp_path):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(700):
        words, bad = [r.choice(brute.WORDS) for _ in range(r.randrange(5, 60))], r.random() < 0.2
        if bad:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "vrelk", "vrelk,", "you", "m0ron"]))
            words.append(r.choice(["vrelk", "clown"]))
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, 1, int(bad)))
    rows += [(900, None, None, None), (901, "", "en", "a"), (902, "vrelk", "en", "a"), (903, "w1 " * 20000, "en", "a"), rows[0]]
    spark.createDataFrame([*labels, (901, 1, None), (999, 1, 1), (3, 0, labels[3][2])], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {x.doc_id: x for x in toxicity.op7_toxicity(spark, table_of(spark, tmp_path, rows)).collect()}
    held = [d for d, x in got.items() if x.held_out and d < 900]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in got) and len(held) > 100
    truth = {d: t for d, _, t in labels}
    assert np.mean([got[d].predicted == truth[d] for d in held]) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got.values())
    assert got[900].score == got[901].score < 0.7
    docs = brute.frame(spark, rows)
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert toxicity.drop_toxic(docs, None).count() == len(rows) and toxicity.drop_toxic(docs, None).columns == docs.columns


def test_isotonic_and_trees():
    iso = toxicity.Isotonic(np.array([0.0, 1, 2, 3, 4]), np.array([0.0, 1, 0, 1, 1]))
    y = iso(np.linspace(-1, 5, 50))
    assert (np.diff(y) >= 0).all() and 0 < y[0] < 0.05 and y[-1] > 0.95
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    label = ((x[:, 1] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    t = toxicity.Trees(x, label)
    fresh = rng.normal(size=(300, 4))
    assert ((t.margin(fresh) > 0) == ((fresh[:, 1] > 0) ^ (fresh[:, 2] > 0.5))).mean() > 0.9
    assert toxicity.Trees(x[:0], label[:0]).margin(x[:2]).tolist() == [0, 0]


def test_forms():
    assert toxicity.forms("idiot!") == ("idiot",) and "idiot" in toxicity.forms("1d10t") and "idiot" in toxicity.forms("i.d.i.o.t")


# ---- 8 lines


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_lines(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(lines, "BROADCAST_LINES", broadcast)
    r = random.Random(4)
    menu, rare = ["Home | About", "  All rights reserved ", "only four"], [f"line {i}" for i in range(60)]
    rows = []
    for i in range(120):
        body = [r.choice(rare) + f" {r.randrange(40)}" for _ in range(r.randrange(0, 5))]
        if r.random() < 0.5:
            body.insert(r.randrange(len(body) + 1), r.choice(menu[:2]))
        if i % 10 < 4:
            body.append(menu[2])
        rows.append((i, "\n".join([*body, "", body[0] if body else ""]), "en", f"site{i % 10}"))
    rows += [(500, None, None, "site1"), (501, "", "en", "site1"), (502, menu[0], "en", None), (None, menu[0] + "\nx", "en", "site2"), rows[5], (503, "\n".join([menu[0]] * 3000), "en", "site3")]
    got = lines.op8_lines(spark, table_of(spark, tmp_path, rows)).collect()
    sites = defaultdict(set)
    for _, t, _, s in rows:
        for x in (t or "").split("\n") if t is not None else []:
            if x.strip(" "):
                sites[x] |= {s} - {None}
    bad = {x for x, s in sites.items() if len(s) >= lines.MIN_SITES}
    assert set(menu[:2]) <= bad and menu[2] not in bad
    want = []
    for d, t, *_ in rows:
        own = t.split("\n") if t is not None else []
        kept = [x for x in own if x not in bad]
        want.append((str(d), len(own), len(own) - len(kept), brute.sha("\n".join(kept))))
    assert sorted((str(x.doc_id), x.n_lines, x.n_removed, x.kept_sha256) for x in got) == sorted(want)
    out, names = lines.remove_boilerplate(brute.frame(spark, rows))
    assert names["kept"] == "_kept" and out.where("doc_id = 500").first()._kept is None
    assert lines.remove_boilerplate(brute.frame(spark, rows[:0]))[0].count() == 0


def test_texts_with_many_boilerplate_lines(spark):
    """Every number of hits from none to many, in long texts."""
    menus = [f"menu {i}" for i in range(300)]
    rows = [(i, "\n".join(menus), "en", f"site{i}") for i in range(lines.MIN_SITES)]
    rows += [(100 + n, "\n".join(f"own {n} {i}\n{menus[(7 * i) % 300]}" if i < n else f"own {n} {i}" for i in range(max(n, 3))), "en", "a") for n in [*range(20), 63, 64, 65, 300, 2000]]
    out, names = lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = {r.doc_id: r[names["kept"]] for r in out.collect()}
    assert got == {d: "\n".join(x for x in t.split("\n") if x not in menus) for d, t, *_ in rows}


# ---- 9 passages


@pytest.mark.parametrize("seed", [7, 8])
def test_passages(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(passages, "SHARD_BYTES", 20_000)
    rows = brute.corpus(seed, 150)
    got = sorted(map(tuple, passages.op9_passages(spark, table_of(spark, tmp_path, rows)).collect()))
    assert got == brute.repeats(rows) and sum(x[2] > 0 for x in got) > 20


def test_passage_edges(spark):
    w = [f"a{i}" for i in range(120)]
    rows = [(1, " ".join(w[:60]), "en", "a"), (2, " ".join(w[11:61]), "en", "a"), (3, " ".join(["x", *w[9:59], "y", *w[20:69]]), "en", "a"), (4, " ".join(w), "en", "a"), (5, " ".join(w[40:100]), "en", "a"), (6, " ".join(["z"] * 130), "en", "a"), (7, " ".join(["z"] * 51), "en", "a"), (None, " ".join(w), "en", "a")]
    found, copies = passages.find_repeats(brute.frame(spark, rows))
    spans = {r.id: [(s.lo, s.hi) for s in r.spans] for r in found.collect()}
    assert spans == {3: [(1, 51)], 4: [(0, 61)], 5: [(0, 60)], 7: [(0, 51)]}
    again = [*rows[:6], (40, rows[0][1], "en", "a"), (41, rows[0][1], "en", "a"), (42, " ".join(w[:49]), "en", "a"), (43, " ".join(w[:49]), "en", "a")]
    found, copies = passages.find_repeats(brute.frame(spark, again))
    hits = {(r.id, r.copied): ([(s.lo, s.hi) for s in r.spans], r.kept) for r in found.collect()}
    # every removed word comes from a hit, a copy's too; texts below a window have none
    assert hits[41, True] == ([(0, 60)], "") and not {(1, False), (42, True), (43, True), (42, False)} & set(hits)
    assert passages.find_repeats(brute.frame(spark, rows[:0]))[0].count() == 0


@given(st.lists(st.sampled_from("ab"), max_size=40), st.lists(st.lists(st.sampled_from("ab"), min_size=4, max_size=16), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_automaton_against_brute_force(text, held):
    """Periodic texts too: the words covered by windows of four that stand in a passage."""
    windows = {tuple(p[i : i + 4]) for p in held for i in range(len(p) - 3)}
    want = {j for i in range(len(text) - 3) if tuple(text[i : i + 4]) in windows for j in range(i, i + 4)}
    made = passages.Automaton([(i, " ".join(p).encode()) for i, p in enumerate(held)], window=4)
    got = made.repeats(99, [c.encode() for c in text], set(range(9)))
    assert {j for a, b in got for j in range(a, b)} == want and all(x[1] < y[0] for x, y in zip(got, got[1:], strict=False))


@given(st.lists(st.integers(0, 1), max_size=200), st.integers(0, 250), st.integers(0, 5))
def test_common(xs, cut, skip):
    a, b = tuple(xs), tuple([*xs[:cut], 7, *xs[cut:]])
    i = min(skip, len(a))
    n = 0
    while i + n < len(a) and a[i + n] == b[i + n]:
        n += 1
    assert passages.common(a, i, b, i) == n


def test_every_removal_is_a_hit(spark, tmp_path):
    """Words that op9 removes are the words that automata located, row by row."""
    rows = [(d % 90 if d is not None else None, *x) for d, *x in brute.corpus(31, 120)] + [(None, x[1], "en", "a") for x in brute.corpus(31, 8)]
    docs = brute.frame(spark, rows)
    found, copies = passages.find_repeats(docs)
    hits = {(r.key, r.copied): sum(s.hi - s.lo for s in r.spans) for r in found.collect()}
    first = {r.key: r.first for r in copies.collect()}
    got = sorted((r.doc_id, r.n_removed) for r in passages.op9_passages(spark, table_of(spark, tmp_path, rows)).collect() if r.doc_id is not None)
    want = []
    for d, t, *_ in rows:
        if d is not None:
            key = hashlib.md5((t or "").encode()).hexdigest()
            want.append((d, hits.get((key, d > first[key]), 0) if t is not None else 0))
    assert got == sorted(want) and sum(n for _, n in got) > 1000
    brute_rows = [x for x in rows if x[0] is not None]
    assert got == sorted((d, n) for d, _, n, _ in brute.repeats(brute_rows))


def test_automaton_extends():
    a = passages.Automaton([(1, b"p q r s t u v w"), (5, b"r s t u x y")], window=4)
    assert a.repeats(9, b"a q r s t u z r s t".split(), {1, 5}) == [(1, 6)]
    assert a.repeats(9, b"a q r s t u z r s t".split(), {5}) == [(2, 6)]
    assert a.repeats(1, b"p q r s".split(), {1}) == [] and a.repeats(9, b"q r s".split(), {1}) == []
    assert passages.Automaton([]).repeats(3, b"a b".split(), {1}) == []


# ---- 10 mixing


@pytest.mark.parametrize("broadcast", [0, 20_000])
def test_mixing(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rows = brute.corpus(12, 200)
    got = mixing.op10_mix(spark, table_of(spark, tmp_path, rows)).collect()
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((d, len(brute.white_words(t))) for d, t, *_ in rows)
    sizes, source = Counter(), {d: s for d, _, _, s in rows}
    for d, t, _, s in rows:
        sizes[s] += len(brute.white_words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute.shares([sizes[s] for s in order]), strict=True))
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.op10_mix(spark, str(tmp_path)).collect()))


def test_splitting_tree(spark):
    quotas = spark.createDataFrame([(1, 40), (2, 25), (3, 0), (4, 1)], "rank int, blocks long")
    got = mixing.splitting_tree(quotas, 3).collect()
    assert Counter(r.rank for r in got) == {1: 40, 2: 25, 4: 1}
    loads = Counter(r.shard for r in got)
    assert len(got) == len({(r.rank, r.block) for r in got}) and set(loads.values()) <= {8, 9} and set(loads) == set(range(8))


def test_apply_mix(spark):
    rows = brute.corpus(13, 60)
    docs = brute.frame(spark, rows)
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    words = Counter()
    full = {(d, t) for d, t, *_ in rows}
    for r in out.collect():
        words[r.source] += len(brute.white_words(r.text))
        assert (r.doc_id, r.text) in full or any(d == r.doc_id and brute.white_words(t)[: len(brute.white_words(r.text))] == brute.white_words(r.text) for d, t in full)
    per = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    assert sum(words.values()) == per
    assert mixing.apply_mix(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_apply_mix_leaves_texts_where_they_are(spark):
    """Texts went through two shuffles: to their bucket, and again to number its rows."""
    out = mixing.apply_mix(brute.frame(spark, brute.corpus(14, 60)))
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("broadcast", [0, 20_000])
def test_apply_mix_takes_what_mix_draws(spark, monkeypatch, broadcast):
    """Also where the document that an epoch ends with has others of the same id and size beside it, and where ids or words are missing."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    r = random.Random(15)
    texts = [None, "", " \t", *(" ".join(r.choice("abcdefgh") for _ in range(k)) for k in (3, 3, 3, 5, 7))]
    rows = [(r.choice([None, None, 1, 2]), r.choice(texts), "en", r.choice(["a", "b", None])) for _ in range(80)]
    rows += [(7, "x y z " * 4 + str(i), "en", "one id and size") for i in range(50)] + [(i, f"w{i}", "en", "one word each") for i in range(9)] + [(8, None, "en", "no words")]
    docs = brute.frame(spark, rows).repartition(5)
    # a source's size tells it from the others
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(brute.white_words(t))
    assert len({*sizes.values()}) == len(sizes)
    want = Counter((d.id, d.source_size, n) for d in mixing.mix(docs).select("id", "source_size", "copies.words").collect() for n in d.words)
    out = mixing.apply_mix(docs).collect()
    assert Counter((d.doc_id, sizes[d.source], len(brute.white_words(d.text))) for d in out) == want
    # a text is taken once an epoch, or the first words of it
    assert max(Counter(d.text for d in out if d.source == "one id and size").values()) <= 2
    whole = {(d, t, s) for d, t, _, s in rows}
    cut = [d for d in out if (d.doc_id, d.text, d.source) not in whole]
    assert len(cut) <= 2 * len(sizes)
    assert all(any(d == c.doc_id and s == c.source and (t or "").startswith(c.text) for d, t, s in whole) for c in cut)


def test_neardup_repeated_id_with_sets_of_one_size(spark):
    one, two = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(0, " ".join(one)), (0, " ".join(two)), (1, " ".join([*one, "x"])), (2, " ".join([*two, "y"]))]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id, r.component) for r in out) == [(0, 0), (0, 0), (1, 0), (2, 0)]


def test_neardup_open_links_see_every_text_of_an_id(spark):
    import pyarrow as pa

    one, two = (np.arange(a, a + 50, dtype=np.uint64).tobytes() for a in (0, 100))
    group = pa.table({"rep": [0, 0, 1, 2], "partners": [[1, 2], [1, 2], [], []], "shingles": [one, two, one, two]})
    assert sorted(zip(*neardup._open_links(group).to_pydict().values(), strict=True)) == [(1, 0), (2, 0)]


def test_neardup_repeated_ids_with_different_texts(spark):
    """Classes that only a repeated id connects, one of its rows without words, are one component."""
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    rows = [(1, " ".join(a), "", ""), (2, " ".join(b), "", ""), (5, " ".join([*a, "x"]), "", ""), (5, " ".join([*b, "y"]), "", ""), (5, None, "", ""), (6, " ".join(c), "", ""), (6, "", "", ""), (7, " ".join([*c, "z"]), "", ""), (8, None, "", ""), (8, "a", "", ""), (9, "a", "", "")]
    out = neardup.near_duplicates(brute.frame(spark, rows)).collect()
    assert {r.id: r.component for r in out} == brute.near_components(rows) == {1: 1, 2: 1, 5: 1, 6: 6, 7: 6, 8: 8, 9: 8}
    assert sorted((r.id, r.n_shingles) for r in out) == sorted((d, len(brute.shingles(t))) for d, t, *_ in rows)


def test_neardup_repeated_ids_at_random(spark):
    rows = [(d % 40 if d is not None else None, *x) for d, *x in brute.corpus(21, 120)]
    out = neardup.near_duplicates(brute.frame(spark, rows)).collect()
    assert {r.id: r.component for r in out if r.id is not None} == brute.near_components(rows)


def test_open_band_ships_rows_in_proportion(spark, monkeypatch):
    """A band of near copies with one outsider: block rows grow with the band, not with its square."""
    from tidemark.llm.common import scratch_root

    monkeypatch.setattr(neardup, "BLOCK", 64)
    shipped = []
    real = neardup._open_pairs
    folder = scratch_root(spark).removeprefix("file://")

    def counted(key, group):
        with open(f"{folder}/shipped-{key[0]}-{key[1]}-{key[2]}", "w") as f:
            f.write(str(group.num_rows))
        return real(key, group)

    monkeypatch.setattr(neardup, "_open_pairs", counted)
    import glob
    import os

    n = 1500
    reps = spark.createDataFrame([(i, 200, bytes(256), None) for i in range(n)], "rep long, n long, small binary, large binary")
    members = spark.createDataFrame([(7, i, 200, 0, 0, n - 1) for i in range(n)], "band long, rep long, n long, place int, lo long, hi long")
    merged = spark.createDataFrame([(i, 0) for i in range(n) if i != 800], "node long, component long")
    docs = spark.createDataFrame([], "id long, text string")
    assert neardup._open_band_links(neardup.stored(members), neardup.stored(merged), neardup.stored(reps), docs).count() == 0
    for f in glob.glob(f"{folder}/shipped-7-*"):
        shipped.append(int(open(f).read()))
        os.remove(f)
    assert sum(shipped) == n + -(-n // 64) and max(shipped) < 130


def test_spread_join(spark):
    from tidemark.llm.common import spread_join

    many = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)] + [(None, -1)], "k long, v long")
    one = many.groupBy("k").agg(F.count("*").alias("n")).where("k % 2 = 1")
    counts = many.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = spread_join(many, one, ["k"], counts, ["v"], how)
        assert sorted(map(str, got.collect())) == sorted(map(str, many.join(one, "k", how).collect()))


def test_components_of_a_large_star(spark):
    links = [(i, 5) for i in range(6, 3000)] + [(3000 + i, 3001 + i) for i in range(40)] + [(3020, 17)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got.values()) == {5} and len(got) == 2995 + 41


@pytest.mark.parametrize("bound", [0, 3033, 3034])
def test_components_on_both_sides_of_the_bound(spark, monkeypatch, bound):
    """Stars and a path from high to low, with a loop and repeats: 3034 links merged in the driver or by steps."""
    monkeypatch.setattr(components, "DRIVER_LINKS", bound)
    links = [(i, 5) for i in range(6, 2000)] + [(5000 - i, 4999 - i) for i in range(40)] + [(2**40 + i, -7) for i in range(999)] + [(9, 9), (5, 8)]
    got = [(x.node, x.component) for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()]
    want = dict.fromkeys(range(5, 2000), 5) | dict.fromkeys(range(4960, 5001), 4960) | dict.fromkeys([-7, *range(2**40, 2**40 + 999)], -7)
    assert len(got) == len(want) and dict(got) == want
    assert components.components(spark.createDataFrame([(3, 3)], "a long, b long")).collect() == []


def test_components_of_few_links_take_few_stages(spark):
    """No step over all shuffle partitions where the links fit in the driver."""
    links = spark.createDataFrame([(i, i // 2) for i in range(1, 500)], "a long, b long")
    sc = spark.sparkContext
    sc.setJobGroup("few-links", "")
    try:
        found = components.components(links)
        assert {x.component for x in found.collect()} == {0}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    assert sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("few-links")) <= 6
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_neardup_above_the_bound_of_the_driver(spark, monkeypatch):
    monkeypatch.setattr(components, "DRIVER_LINKS", 0)
    rows = brute.corpus(7)
    got = {(r.id, r.component) for r in neardup.near_duplicates(brute.frame(spark, rows)).collect()}
    assert got == set(brute.near_components(rows).items())


OUT = ["n_words", "spans", "items", "shard", "slot", "media", "parsed", "host", "path", "rule", "verdict", "from_set", "lang_pred", "score", "n_lines", "n_removed", "kept", "lang_lettered"]
OWN = ["doc", "key", "n", "best", "hashes", "j_salt", "j_parts", "unit", "part", "id", "size", "rep", "band", "component", "n_shingles", "copies", "taken", "bucket", "fold", "label", "s_id", "s_class", "u_best", "line"]


@pytest.mark.parametrize("name", ["decontaminate", "drop_contaminated", "shard", "shard_corpus", "near", "keep_one", "streams", "urls", "langs", "toxic", "drop_toxic", "lines", "passages", "mix", "apply_mix"])
def test_clashing_names(spark, name):
    """Every operator takes a frame that holds its own names, gives it back unchanged and adds under other names."""
    rows = brute.corpus(41, 12) + [(None, "http://x.com/en/ w1", "en", "a"), (None, None, None, None)]
    docs = spark.createDataFrame([(d, t, g, s, len(t or "")) for d, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(f"mine {c}").alias(c) for c in OUT + OWN])
    benchmark, labels = spark.createDataFrame([(1, rows[0][1] or "w1"), (2, "w2 w3")], "item_id long, text string"), spark.createDataFrame([(d, i % 2) for i, (d, *_) in enumerate(rows)], "doc_id long, toxic int")
    run = {
        "decontaminate": lambda: decontaminate.find_contamination(docs, benchmark)[0], "drop_contaminated": lambda: decontaminate.drop_contaminated(docs, benchmark), "shard": lambda: sharding.shard(docs), "shard_corpus": lambda: sharding.shard_corpus(docs),
        "near": lambda: neardup.near_duplicates(docs), "keep_one": lambda: neardup.keep_one(docs), "streams": lambda: media.parse_streams(media.to_streams(docs, "text"), "_media"), "urls": lambda: urls.judge(docs, "text"),
        "langs": lambda: langid.predict(docs, langid.fit(docs)), "toxic": lambda: toxicity.score(docs, toxicity.fit(docs, labels)), "drop_toxic": lambda: toxicity.drop_toxic(docs, toxicity.fit(docs, labels)), "lines": lambda: lines.remove_boilerplate(docs)[0],
        "passages": lambda: passages.find_repeats(docs)[1], "mix": lambda: mixing.mix(docs), "apply_mix": lambda: mixing.apply_mix(docs),
    }
    out = run[name]()
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    got = out.collect()
    if set(docs.columns) <= set(out.columns):
        assert out.columns[: len(docs.columns)] == docs.columns and all(r[c] == f"mine {c}" for r in got for c in OUT + OWN)
        if name in ("decontaminate", "shard_corpus", "streams", "urls", "langs", "toxic", "lines"):
            assert sorted(str((r.doc_id, r.text, r.lang, r.source)) for r in got) == sorted(str(x) for x in rows)
    else:
        assert name in ("shard", "near", "passages", "mix") and got


def test_many_sources_and_a_source_of_each_row(spark):
    """Targets are computed in time that grows with the number of sources, not with its square."""
    sizes = spark.range(40_000).select(F.format_string("s%06d", "id").alias("source"), (F.col("id") % 97 + 1).alias("source_size"))
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    want = brute.shares([i % 97 + 1 for i in range(40_000)])
    assert all(abs(got[f"s{i:06d}"] - want[i]) < 1e-6 for i in range(40_000))


def test_sample_of_many_classes_is_bounded(spark):
    from tidemark.llm.samples import sample_ids

    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 600, F.concat(F.lit("g"), F.col("id") % 3)).otherwise(F.col("id").cast("string")).alias("lang"))
    rows = sample_ids(df, "doc_id", "lang", 50, 10).collect()
    by_hash = df.where("lang = 'g1'").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)), "doc_id").collect()
    assert [(r.doc_id, k) for k, r in enumerate(by_hash[:50], 1)] == [(r.s_id, r.s_at) for r in sorted(rows, key=lambda r: r.s_at) if r.s_class == "g1"]
    got = Counter(r.s_class for r in rows)
    assert len(got) == 10 and all(got[f"g{i}"] == 50 for i in range(3))


def test_scratch_folder_must_be_shared():
    from types import SimpleNamespace

    from tidemark.llm import common

    none = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://host:7077", _jsc=none))
    with pytest.raises(RuntimeError, match="share"):
        common.scratch_root(cluster)
