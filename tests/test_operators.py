import json
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions.exprs import close
from tidemark.functions.jsonform import ValueProblem, parse, render
from tidemark.functions.schema import Ref, parse_schema
from tidemark.functions.wire import Codec, WireError
from tidemark.operators import diff as D
from tidemark.operators import history as H
from tidemark.operators import spatial as S
from tidemark.sources.codec import StateColumns
from tidemark.sources.files import parse_json, read_binary, read_json, render_json, write_json
from tidemark.streaming import clients

ROOT = Path(__file__).resolve().parent.parent


def test_diff_then_patch(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, None, 3.0), (4, "d", 4.0)], "k int, s string, x double")
    new = spark.createDataFrame([(2, "b", 2.0005), (3, "c", 3.0), (4, None, 5.0), (5, "e", None)], "k int, s string, x double")
    fields = {"s": D.null_safe, "x": lambda a, b: F.coalesce(close(a, b), a.isNull() & b.isNull())}
    d = D.diff_tables(old, new, ["k"], fields, keep_same=True)
    assert {r.k: r.op for r in d.collect()} == {1: "del", 2: "same", 3: "upd", 4: "upd", 5: "add"}
    patched = D.patch_table(old, d, ["k"], ["s", "x"])
    assert sorted((r.k, r.s, r.x) for r in patched.collect()) == [(2, "b", 2.0), (3, "c", 3.0), (4, None, 5.0), (5, "e", None)]
    empty = old.limit(0)
    assert D.diff_tables(empty, empty, ["k"], fields).count() == 0
    assert D.diff_tables(empty, new, ["k"], fields).where("op = 'add'").count() == 4


def test_repeated_keys_fail(spark):
    with pytest.raises(PySparkException, match="repeated key"):
        D.require_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"]).collect()


@pytest.mark.parametrize(("a", "b"), [([1, 2, 3], [1, 5, 3]), ([1, 2, 3], [1]), ([1], [1, 2, 3]), ([], [1]), ([1, 2], []), ([], []), ([7, 8], [7, 8])])
def test_array_patch(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    x, y = F.col("a"), F.col("b")
    assert df.select(D.array_patch(x, F.size(y), D.array_updates(x, y), D.array_tail(x, y)).alias("p")).first().p == b


def test_map_patch(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2, "n": None}, {"b": 3, "c": 4, "n": None}), ({}, {"x": 1}), ({"x": 1}, {})], "a map<string,int>, b map<string,int>")
    x, y = F.col("a"), F.col("b")
    out = df.select("b", D.map_patch(x, D.map_deletions(x, y), D.map_updates(x, y), D.map_additions(x, y)).alias("p"), D.map_updates(x, y).alias("u")).collect()
    assert all(r.p == r.b for r in out) and out[0].u == {"b": 3}


def test_versions(spark):
    log = spark.createDataFrame([(1, "a", "set", 1), (1, "b", "set", 2), (1, "a", "del", 3), (1, "c", "set", 4), (1, "c", "del", 5), (1, "b", "set", 6)], "e int, k string, op string, version int")
    base = spark.createDataFrame([(1, "a"), (1, "b")], "e int, k string")
    assert sorted((r.k, r.kind) for r in H.classify_since(log, ["e", "k"], "op", "version", F.lit(2), base).collect()) == [("a", "del"), ("b", "upd")]
    snaps = spark.createDataFrame([(4,), (5,)], "at int")
    assert sorted(r.version for r in H.prune_tombstones(log, "op", "version", snaps, "at").collect()) == [1, 2, 4, 5, 6]
    assert sorted(r.version for r in H.prune_tombstones(log, "op", "version", snaps.limit(0), "at").collect()) == [1, 2, 4, 6]


def test_interpolation(spark):
    samples = spark.createDataFrame([(1, 0, 0.0), (1, 10, 5.0)], "e int, t long, v double")
    wanted = spark.createDataFrame([(1, -1), (1, 0), (1, 4), (1, 10), (1, 20), (2, 5)], "e int, at long")
    got = {(r.e, r["at"]): r.v for r in H.interpolate(samples, wanted, ["e"], "t", "v", "at").collect()}
    assert got == {(1, -1): None, (1, 0): 0.0, (1, 4): 2.0, (1, 10): 5.0, (1, 20): 5.0, (2, 5): None}


def test_near_pairs_match_brute_force(spark):
    import random

    r = random.Random(3)
    pts = [(i, r.uniform(-50, 50), r.uniform(-50, 50)) for i in range(200)] + [(200, 1.0, 1.0), (201, 1.0, 1.0)]
    got = {(x.key_a, x.key_b) for x in S.near_pairs(spark.createDataFrame(pts, "k int, x double, y double"), "k", "x", "y", 7.0).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and 0 < (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 < 49}


def test_near_pairs_of_copies_and_borders(spark):
    pts = [(i, x * 3.5, y * 3.5, g) for i, (x, y, g) in enumerate((x, y, g) for g in "ab" for x in range(-3, 4) for y in range(-3, 4))]
    pts += [(1000 - k, 0.5, -0.0, "a") for k in range(30)] + [(2000 + k, 0.5, 0.0, "a") for k in range(30)] + [(5, 1.0, 1.0, "a"), (6, 0.0, float("nan"), "a"), (7, 0.0, None, "a"), (None, 0.0, 0.0, "a"), (8, 0.0, 0.0, None)]
    got = Counter((x.g, x.key_a, x.key_b, x.d2) for x in S.near_pairs(spark.createDataFrame(pts, "k int, x double, y double, g string"), "k", "x", "y", 7.0, ["g"]).collect())
    whole = [p for p in pts if None not in p]
    d2 = lambda a, b: (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2
    assert got == Counter((a[3], a[0], b[0], d2(a, b)) for a in whole for b in whole if a[3] == b[3] and a[0] < b[0] and 0 < d2(a, b) < 49)


def test_near_pairs_join_spots_in_many_tasks(spark):
    """Copies are told apart after the join, and the few bytes that it reads aren't merged into few tasks."""
    pts = spark.range(80).selectExpr("id AS k", "id % 2 * 3.0D AS x", "id % 2 * -4.0D AS y")
    pairs = S.near_pairs(pts, "k", "x", "y", 7.0)
    assert len({(r.key_a, r.key_b) for r in pairs.collect()}) == 1600
    assert pairs.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism

    def nodes(p):
        kind = p.getClass().getSimpleName()
        below = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        return [p, *(n for b in below for n in nodes(b))]

    joined = [n.metrics().apply("numOutputRows").value() for n in nodes(pairs._jdf.queryExecution().executedPlan()) if "Join" in n.nodeName()]
    assert joined == [1], joined


TEXT = "Status: [UP, DOWN]\nA: {x: int}\nB: {name: string}\nAct: [A, B]\nItem: {id: uint, tags: '<string, int>', status: Status, act: 'Act?', kids: 'Item[]', note: 'string?'}"


def item(i, kids=()):
    return {"id": i, "tags": {"k": i}, "status": "UP", "act": {"_type": "B", "B": {"name": "n"}} if i % 2 else None, "kids": list(kids), "note": None}


def test_state_columns(spark):
    s = parse_schema(TEXT)
    c = StateColumns(s, "Item")
    codec = Codec(s, "Item")
    old, new = item(1, [item(2)]), item(1, [item(2), item(3)])
    df = spark.createDataFrame([(codec.encode(old), codec.encode(new)), (None, None)], "a binary, b binary").select(c.decode(F.col("a")).alias("x"), c.decode(F.col("b")).alias("y"))
    df = df.select("x", "y", c.encode_diff(F.col("x"), F.col("y")).alias("d")).select("d", c.encode(c.decode_diff(F.col("x"), F.col("d"))).alias("z"))
    first, second = df.collect()
    assert bytes(first.z) == codec.encode(new) and second.z is None and second.d is None
    deep = codec.encode(item(1, [item(2, [item(3, [item(4)])])]))
    with pytest.raises(PySparkException, match="nests deeper"):
        spark.createDataFrame([(deep,)], "a binary").select(c.decode(F.col("a"))).collect()
    bad = spark.createDataFrame([(b"\x01",)], "a binary")
    assert bad.select(StateColumns(s, "Item", lenient=True).decode(F.col("a")).alias("v")).first().v is None
    with pytest.raises(PySparkException):
        bad.select(c.decode(F.col("a"))).collect()


def test_json_columns(spark, tmp_path):
    s = parse_schema(TEXT)
    loose = {"id": "7", "tags": {"k": "3"}, "status": "down", "act": {"B": {"name": "n"}}, "kids": [{"id": 8, "tags": {}, "status": 0, "act": {"_type": "a", "x": 5}, "kids": [], "extra": 1}], "note": ""}
    df = spark.createDataFrame([(json.dumps(loose),)], "t string").select(parse_json(s, "Item", F.col("t")).alias("state"))
    text = json.loads(df.select(render_json(s, "Item", F.col("state")).alias("t")).first().t)
    want = {"id": 7, "tags": {"k": 3}, "status": "DOWN", "act": {"B": {"name": "n"}}, "kids": [{"id": 8, "tags": {}, "status": "UP", "act": {"A": {"x": 5}}, "kids": []}]}
    assert text == want == render(s, Ref("Item"), parse(s, Ref("Item"), loose))
    write_json(df, str(tmp_path / "j"), s, "Item")
    assert read_json(spark, str(tmp_path / "j"), s, "Item").first().state.id == 7
    (tmp_path / "one.bin").write_bytes(Codec(s, "Item").encode(item(4)))
    assert read_binary(spark, str(tmp_path / "one.bin"), s, "Item").first().state.tags == {"k": 4}


def test_json_too_deep(spark):
    s = parse_schema("N: {v: int, next: 'N?'}")
    for levels, ok in ((3, True), (4, False)):
        text = json.dumps({"v": 1})
        for _ in range(levels - 1):
            text = f'{{"v": 1, "next": {text}}}'
        df = spark.createDataFrame([(text,)], "t string").select(parse_json(s, "N", F.col("t")).alias("s"))
        if ok:
            assert df.first().s.next.next.v == 1
        else:
            with pytest.raises(PySparkException, match="nested too deep"):
                df.collect()


@pytest.mark.parametrize("v", [{"id": -1}, {"id": 1.5}, {"id": "x"}, {}, {"id": 1, "tags": []}, {"id": 1, "tags": {}, "status": "SIDEWAYS"}])
def test_json_refused(v):
    with pytest.raises(ValueProblem, match=r"^\$"):
        parse(parse_schema(TEXT), Ref("Item"), v)


def test_command_line(tmp_path):
    (tmp_path / "s.yml").write_text(TEXT)
    s = parse_schema(TEXT)
    for name, v in (("a", item(1)), ("b", item(1, [item(2)]))):
        (tmp_path / f"{name}.json").write_text(json.dumps(render(s, Ref("Item"), v)))

    def run(*args, ok=True):
        p = subprocess.run([sys.executable, "-m", "tidemark.sources.cli", *map(str, args)], cwd=ROOT, capture_output=True)
        assert (p.returncode == 0) == ok, p.stderr
        return p.stdout

    t = tmp_path
    run("encode", t / "s.yml", "-t", "Item", "-i", t / "a.json", "-o", t / "a.bin")
    assert json.loads(run("decode", t / "s.yml", "-t", "Item", "-i", t / "a.bin")) == json.loads((t / "a.json").read_text())
    run("encode-diff", t / "s.yml", "-t", "Item", "--old", t / "a.json", "--new", t / "b.json", "-o", t / "d.bin")
    assert json.loads(run("decode-diff", t / "s.yml", "-t", "Item", "--old", t / "a.json", "--diff", t / "d.bin")) == json.loads((t / "b.json").read_text())
    assert b"CREATE TABLE Item" in run("generate", t / "s.yml")
    run("encode", t / "s.yml", "-t", "Status", "-i", t / "a.json", ok=False)
    run("encode", t / "s.yml", "-t", "Nope", "-i", t / "a.json", ok=False)


def test_client_stream(spark, tmp_path):
    s = parse_schema("P: {x: int, name: string}")
    c = Codec(s, "P")
    states = {t: {"x": t * t, "name": f"n{t % 3}"} for t in range(1, 8)}
    rows = [(1, 1, 0, c.encode(states[1])), (1, 2, 1, c.encode_diff(states[1], states[2])), (1, 4, 3, c.encode_diff(states[3], states[4])), (1, 5, 2, c.encode_diff(states[2], states[5])), (1, 5, 2, c.encode_diff(states[2], states[5])), (2, 3, 9, b"\0"), (2, 4, 0, b"\xff")]
    spark.createDataFrame(rows, "client long, tick long, baseline long, payload binary").write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema("client long, tick long, baseline long, payload binary").parquet(str(tmp_path / "m"))
    out = clients.run_to_table(clients.fold_clients(stream, s, "P"), str(tmp_path / "o"), str(tmp_path / "c")).collect()
    assert sorted((r.client, r.tick, r.outcome) for r in out) == [(1, 1, "applied"), (1, 2, "applied"), (1, 4, "dropped"), (1, 5, "applied"), (1, 5, "stale"), (2, 3, "dropped"), (2, 4, "dropped")]
    assert c.decode(bytes(next(r.state for r in out if r.tick == 5 and r.outcome == "applied"))) == states[5]
    with pytest.raises(WireError):
        c.decode(b"\xff")


def test_dedupe_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:00:00", 1), ("2024-01-01 00:00:01", 1), ("2024-01-01 00:00:02", 2)], "t string, k int").select(F.col("t").cast("timestamp").alias("t"), "k").write.parquet(str(tmp_path / "i"))
    stream = spark.readStream.schema("t timestamp, k int").parquet(str(tmp_path / "i"))
    out = clients.run_to_table(clients.dedupe_stream(stream, "t", ["k"], "1 minute"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(r.k for r in out.collect()) == [1, 2]


def test_stream_that_has_not_ended(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "i"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "i"))
    with pytest.raises(TimeoutError):
        clients.run_to_table(stream, str(tmp_path / "o"), str(tmp_path / "c"), timeout=0.001)
    assert clients.run_to_table(stream, str(tmp_path / "p"), str(tmp_path / "d")).count() == 5


@pytest.mark.parametrize("name", ["stream_client_fold", "stream_bandwidth_tumbling"])
def test_streams_run_without_a_limit(spark, sf_dir, monkeypatch, name):
    from pyspark.sql.streaming import StreamingQuery

    from tidemark.plans import catalog

    limits, wait = [], StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: limits.append(timeout) or wait(self, timeout))
    catalog.QUERIES[name](spark, sf_dir)
    assert limits == [None]


def test_client_fold_of_a_table(spark):
    s = parse_schema("P: {x: int, name: string}")
    c = Codec(s, "P")
    states = {t: {"x": t * t, "name": f"n{t % 3}"} for t in range(1, 8)}
    change = {(a, b): c.encode_diff(states[a], states[b]) for a in states for b in states}
    rows = [(1, 1, 0, c.encode(states[1])), (1, 2, 1, change[1, 2]), (1, 4, 3, change[3, 4]), (1, 5, 2, change[2, 5]), (1, 5, 2, change[2, 5]), (1, 7, 1, change[1, 7]), (2, 3, 9, b"\0"), (2, 4, 0, b"\xff")]
    out = clients.fold_table(spark.createDataFrame(rows, "client long, tick long, baseline long, payload binary"), s, "P", keep=3).collect()
    assert sorted((r.client, r.tick, r.outcome) for r in out) == [(1, 1, "applied"), (1, 2, "applied"), (1, 4, "dropped"), (1, 5, "applied"), (1, 5, "stale"), (1, 7, "dropped"), (2, 3, "dropped"), (2, 4, "dropped")]
    assert c.decode(bytes(next(r.state for r in out if r.tick == 5 and r.outcome == "applied"))) == states[5]


def test_batch_client_fold_reads_payloads(spark, sf_dir, monkeypatch):
    from tidemark.plans import catalog

    messages = catalog.client_messages
    monkeypatch.setattr(catalog, "client_messages", lambda *a: messages(*a).withColumn("payload", F.when(F.col("baseline") == 0, F.unhex(F.lit("FF"))).otherwise(F.col("payload"))))
    assert {r.applied for r in catalog.QUERIES["batch_client_fold"](spark, sf_dir).collect()} == {0}


def test_interpolation_of_one_long_entity(spark):
    """In time that grows with the samples; ties count the greatest value before and the least after."""
    from pyspark.sql import functions as F

    from tidemark.operators import history as H

    n = 40_000
    samples = spark.range(n).select(F.lit(1).alias("e"), (F.col("id") * 10).alias("t"), (F.col("id") * 2.0).alias("v"))
    wanted = spark.range(n).select(F.lit(1).alias("e"), (F.col("id") * 10 + 5).alias("at"))
    out = H.interpolate(samples, wanted, ["e"], "t", "v", "at")
    assert out.where((F.col("at") < (n - 1) * 10) & (F.abs(F.col("v") - (F.col("at") / 5.0)) < 1e-6)).count() == n - 1
    assert out.where(f"at > {(n - 1) * 10}").first().v == 2.0 * (n - 1)
    ties = spark.createDataFrame([(1, 0, 1.0), (1, 0, 3.0), (1, 10, 5.0), (1, 10, 9.0)], "e int, t long, v double")
    asked = spark.createDataFrame([(1, 0), (1, 5), (1, 10), (1, -1), (2, 3)], "e int, at long")
    got = {(r.e, r.at): r.v for r in H.interpolate(ties, asked, ["e"], "t", "v", "at").collect()}
    assert got == {(1, 0): 3.0, (1, 5): 4.0, (1, 10): 9.0, (1, -1): None, (2, 3): None}


def test_datagrams(spark):
    from pyspark.sql import functions as F

    from tidemark.streaming import clients

    df = spark.createDataFrame([(0, b""), (1, b"\x00\xff"), (256, b"a"), (2**32 - 1, b"xyz"), (None, b"a"), (3, None)], "tick long, payload binary")
    out = df.withColumn("d", clients.frame(F.col("tick"), F.col("payload")))
    tick, payload = clients.unframe(F.col("d"))
    rows = out.select("*", tick.alias("t"), payload.alias("p")).collect()
    for r in rows:
        if r.tick is None or r.payload is None:
            assert r.d is r.t is r.p is None
        else:
            assert bytes(r.d) == r.tick.to_bytes(4, "little") + bytes(r.payload) and r.t == r.tick and bytes(r.p) == bytes(r.payload)
    short = spark.createDataFrame([(b"abc",)], "d binary")
    assert short.select(*clients.unframe(F.col("d"))).first() == (None, None)


def test_scratch_folder_must_be_shared():
    from types import SimpleNamespace

    import pytest

    from tidemark.plans import inputs

    with pytest.raises(RuntimeError, match="share"):
        inputs.scratch(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="yarn")), "x")
