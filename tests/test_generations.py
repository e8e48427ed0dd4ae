"""Committed generations under failures, and the outbox's replay in any order of arrival."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import governance
from tidemark.sources.generations import Conflict, GenerationError, Generations
from tidemark.streaming import outbox

NOW, LATER = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
CHUNK = "id string, source string, text string"


class Stop(Exception):
    pass


def failing(at):
    def hook(step):
        if step == at:
            raise Stop(step)

    return hook


def texts(store):
    return {r.id: r.text for r in store.read().collect()}


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


@pytest.mark.parametrize("step", ["written", "staged", "validated", "before swap", "swapped"])
def test_readers_see_one_generation_whatever_fails(spark, root, step):
    Generations(spark, root, "t").upsert("g1", spark.createDataFrame([("a", "s", "one"), ("b", "s", "two")], CHUNK), NOW)
    new = spark.createDataFrame([("b", "s", "TWO"), ("c", "s", "three")], CHUNK)
    with pytest.raises(Stop):
        Generations(spark, root, "t", failing(step)).upsert("g2", new, LATER)
    after = Generations(spark, root, "t")
    old, fresh = {"a": "one", "b": "two"}, {"a": "one", "b": "TWO", "c": "three"}
    assert texts(after) == (fresh if step == "swapped" else old)
    for _ in range(2):  # a retry goes on, and is done once
        after.upsert("g2", new, LATER)
        assert texts(after) == fresh
    assert after.log().active == "g2" and after.log().previous == "g1"
    gone = after.collect()
    assert len(gone) == (1 if step == "written" else 0) and texts(after) == fresh
    first = {r.id: str(r.first_indexed) for r in after.read().collect()}
    assert first == {"a": NOW, "b": NOW, "c": LATER}


def test_replace_rollback_and_promote_again(spark, root):
    store = Generations(spark, root, "t")
    store.upsert("g1", spark.createDataFrame([("a1", "a", "x"), ("a2", "a", "y"), ("b1", "b", "z")], CHUNK), NOW)
    store.replace_sources("g2", spark.createDataFrame([("a1", "a", "new")], CHUNK), spark.createDataFrame([("a",)], "source string"), LATER)
    assert texts(store) == {"a1": "new", "b1": "z"}
    assert store.rollback() == "g1" and texts(store) == {"a1": "x", "a2": "y", "b1": "z"}
    log = store.log()
    assert (log.active, log.previous, log.states) == ("g1", "g2", {"g1": "active", "g2": "ready"})
    with pytest.raises(GenerationError):
        store.abandon("g2", "a rollback returns to it")
    store.promote("g2")
    assert texts(store) == {"a1": "new", "b1": "z"} and store.log().states["g1"] == "retired"


def test_states_refuse_what_they_do_not_allow(spark, root):
    store = Generations(spark, root, "t")
    manifest = spark.createDataFrame([("u", "h")], "uri string, sha256 string")
    with pytest.raises(GenerationError):
        store.rollback()
    store.create("g", manifest)
    store.create("g", manifest)
    with pytest.raises(GenerationError):
        store.promote("g")
    store.stage("g", spark.createDataFrame([("u", "other")], "uri string, sha256 string"))
    assert store.validate("g") == "failed"
    with pytest.raises(GenerationError):
        store.stage("g", manifest)
    store.create("h", manifest)
    store.fail("h", "reader is gone")
    store.create("i", manifest)
    store.stage("i", manifest)
    store.stage("i", manifest)
    assert store.validate("i") == "ready"
    with pytest.raises(GenerationError):
        store.fail("i", "a ready one is abandoned")
    store.abandon("i", "not needed")
    assert store.log().states == {"g": "failed", "h": "failed", "i": "failed"} and len(store.collect()) == 2
    with pytest.raises(GenerationError):
        store.read()


def test_two_writers_cannot_take_one_number(spark, root):
    one, two = Generations(spark, root, "t"), Generations(spark, root, "t")
    log = two.log()
    one.create("g", spark.createDataFrame([("u", "h")], "uri string, sha256 string"))
    with pytest.raises(Conflict):
        two._append(log, action="create", generation_id="x", state="building")
    assert two.log().states == {"g": "building"}
    assert Generations(spark, root, "other").log().states == {}


def test_outbox_comes_out_in_turn(spark, tmp_path):
    rng = random.Random(1)
    events = [{"tenant_id": t, "sequence": s, "operation_id": f"{t}-{s}", "payload": f"p{s}"} for t in range(3) for s in range(40)]
    sent = events + rng.sample(events, 50)
    rng.shuffle(sent)
    (tmp_path / "in").mkdir()
    held = next(e for e in events if e["tenant_id"] == 1 and e["sequence"] == 5)
    sent = [e for e in sent if e != held]

    def write(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, rows)))

    def run():
        query = outbox.replay(outbox.operations(spark, f"file://{tmp_path}/in", 2), f"file://{tmp_path}/out", f"file://{tmp_path}/check")
        query.awaitTermination()
        rows = [r for r in spark.read.parquet(f"file://{tmp_path}/out").collect()]
        return sorted((r.tenant_id, r.sequence, r.operation_id, r.payload, r.batch) for r in rows)

    for i in range(4):
        write(f"{i}.json", sent[i::4])
    first = run()
    assert [r[:2] for r in first] == [(t, s) for t in range(3) for s in range(40 if t != 1 else 5)]
    write("5.json", [held, events[0], held])
    second = run()
    assert [r[:4] for r in second] == [tuple(e.values()) for e in events] and second[: len(first)][:40] == first[:40]
    for t in range(3):  # batches of a tenant follow its numbers
        batches = [r[4] for r in second if r[0] == t]
        assert batches == sorted(batches)
    assert run() == second


def test_replay_equals_walking_the_operations_in_order(spark):
    rng = random.Random(2)
    store = [(t, f"d{i}", f"s{i % 6}", "old") for t in range(2) for i in range(12)]
    ops = []
    for n in range(40):
        sources = rng.sample([f"s{i}" for i in range(8)], rng.randint(1, 3))
        chunks = [(f"c{n}{s}", s, f"t{n}") for s in sources if rng.random() < 0.8]
        ops.append((n % 2, f"op{n}", n, rng.choice(["index", "index", "delete"]), sources, chunks, rng.random() < 0.2))
    held = set(store)
    for t, _, _, kind, sources, chunks, done in ops:
        if not done:
            held = {r for r in held if not (r[0] == t and r[2] in sources)} | ({(t, *c) for c in chunks} if kind == "index" else set())
    rng.shuffle(ops)
    frame = spark.createDataFrame(ops, "tenant_id long, operation_id string, sequence long, kind string, sources array<string>, chunks array<struct<id:string,source:string,text:string>>, completed boolean")
    once = governance.replay(spark.createDataFrame(store, "tenant_id long, id string, source string, text string"), frame)
    assert {tuple(r) for r in once.collect()} == held
    assert {tuple(r) for r in governance.replay(once, frame).collect()} == held
    erased = spark.createDataFrame([(0, "s1"), (0, "s2"), (1, "s3")], "tenant_id long, source string")
    for r in governance.erase_pending(frame.withColumn("sources", F.when(F.col("sequence") % 5 == 0, F.lit(None)).otherwise(F.col("sources"))), erased).collect():
        gone = {"s1", "s2"} if r.tenant_id == 0 else {"s3"}
        was = next(o for o in ops if o[1] == r.operation_id)
        if was[6]:
            assert r.completed and [tuple(c) for c in r.chunks] == was[5]
        else:
            assert r.chunks is None or not {c.source for c in r.chunks} & gone
            named = set(was[4] if r.sequence % 5 else []) | {c[1] for c in was[5]}
            assert r.completed == (bool(named & gone) and not (set(was[4]) if r.sequence % 5 else named) - gone)
