"""The pipeline against brute force, stage by stage on each stage's own input, over a small corpus."""

from collections import Counter

import brute
import corpus_pipeline
import pytest

from tidemark.llm import toxicity
from tidemark.llm.common import stored


@pytest.fixture(scope="module")
def corpus_dir(spark, tmp_path_factory):
    import random

    d = tmp_path_factory.mktemp("corpus")
    r = random.Random(21)
    rows = brute.corpus(21, 150)
    rows = [(i, t, g, s) for i, (_, t, g, s) in enumerate(rows)]
    labels = []
    for i in range(200, 420):
        bad = i % 4 == 0
        words = [r.choice(brute.WORDS) for _ in range(40)] + (["clown", "idiot"] if bad else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), "en", "abc"[i % 3]))
        labels.append((i, 1, int(bad)))
    items = [(i, " ".join(r.choice(brute.WORDS) for _ in range(20))) for i in range(5)]
    rows += [(500 + i, "so it says " + items[i][1] + " and more", "en", "a") for i in range(5)]
    docs = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), items, dict((i, t) for i, _, t in labels)


def test_stages(spark, corpus_dir):
    d, items, toxic = corpus_dir
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
        out = stored(stage(spark, docs, d), "test")
        after = [(r.doc_id, r.text, r.lang, r.source) for r in out.collect()]
        kept[name] = len(after)
        if name != "sharding":
            assert out.columns == columns
        if name == "toxicity":
            model = toxicity.fit(docs, toxicity.learned_rows(spark.read.parquet(f"{d}/labels.parquet")))
            scores = model.score([t for _, t, *_ in before])
            assert sorted(map(str, after)) == sorted(str(x) for x, s in zip(before, scores, strict=True) if s < toxicity.THRESHOLD)
            assert not [i for i, *_ in after if toxic.get(i) == 1] and len([i for i, *_ in after if toxic.get(i) == 0]) == 165
        elif name == "near_dedup":
            want = brute.near_components(before)
            assert sorted(map(str, after)) == sorted(str(x) for x in before if want[x[0]] == x[0])
        elif name == "decontamination":
            assert sorted(map(str, after)) == sorted(str(x) for x in before if not brute.contamination(x[1], items)[-1])
            assert not [i for i, *_ in after if i >= 500]
        elif name == "mixing":
            sizes, got = Counter(), Counter()
            for _, t, _, s in before:
                sizes[s] += len(brute.white_words(t))
            for _, t, _, s in after:
                got[s] += len(brute.white_words(t))
            order = sorted(sizes, key=lambda s: (s is None, s or ""))
            for s, want in zip(order, brute.shares([sizes[s] for s in order]), strict=True):
                assert got[s] == int(want + 1e-9)
            assert max(Counter(i for i, *_ in after).values()) <= 2
        else:
            assert sorted(map(str, after)) == sorted(map(str, before))
            slots = {}
            for r in out.collect():
                slots.setdefault(r.shard, []).append(r.slot)
            assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        docs = out
    assert kept["toxicity"] > kept["near_dedup"] > kept["decontamination"]


def test_run_is_the_stages(spark, corpus_dir):
    d, _, _ = corpus_dir
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, d), "test")
    assert sorted(map(str, corpus_pipeline.run(spark, d).collect())) == sorted(map(str, docs.collect()))
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_tables(spark, corpus_dir, tmp_path):
    d, _, _ = corpus_dir
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    from tidemark.llm.queries import QUERIES

    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    for name, fn in QUERIES.items():
        assert fn(spark, str(tmp_path)).count() == 0, name
