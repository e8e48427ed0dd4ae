"""Conversation repair against a search over whole audit strings."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_repair

TURNS = "conv_id long, turn long, role string, text string"


def cheapest(turns):
    """(cost, audit, repaired) of turns (role, text, fault): every edit of every turn, kept by (state, whole strings)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(layer):
        best = dict(layer)
        for _ in range(3):
            for at, (cost, audit, lines) in list(best.items()):
                for name in ("user", "assistant"):
                    if (to := step.get((at, name[0]))) is not None:
                        way = (cost + 3, audit + "I", [*lines, f"{name}:"])
                        best[to] = min(best.get(to, way), way)
        return best

    layer = {"": (0, "", [])}
    for role, text, fault in turns:
        after = {}

        def put(to, way, after=after):
            after[to] = min(after.get(to, way), way)

        for at, (cost, audit, lines) in inserted(layer).items():
            put(at, (cost + 4, audit + "D", lines))
            if fault in (1, 2):
                continue
            more = 3 if fault == 3 else 0
            if (to := step.get((at, role[:1]))) is not None:
                put(to, (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            for name in ("user", "assistant"):
                if (to := step.get((at, name[0]))) is not None:
                    put(to, (cost + more + 3, audit + "R", [*lines, f"{name}:{text}"]))
        layer = after
    ends = inserted(layer)
    return min(ends[s] for s in ("", "a") if s in ends)


def brute(rows):
    """The report's rows by plain loops."""
    out = []
    for conv in {r[0] for r in rows}:
        mine = []
        for c, turn, role, text in rows:
            if c == conv:
                name = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
                fate, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
                text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
                mine += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns = set(), []
        for _, role, text in mine:
            bare = re.sub("[\x20\x09-\x0d]", "", text)
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            turns.append((role, text, fault))
        cost, audit, lines = cheapest(turns)
        at = [t for t, _, _ in mine if t is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:], strict=False)]
        out.append(
            (conv, max(at) - min(at) + 1 - len(set(at)) if at else 0, *(sum(f == k for _, _, f in turns) for k in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit)
            + (hashlib.sha256("\n".join(lines).encode()).hexdigest(),)
        )
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def found(spark, rows):
    df = spark.createDataFrame(rows, TURNS) if isinstance(rows, list) else rows
    got = chat_repair.report(chat_repair.repair(chat_repair.damage(df))).collect()
    return sorted(map(tuple, got), key=lambda r: (r[0] is not None, r[0] or 0))


def turns(seed, convs, most, roles=("user", "assistant", "system", "tool", "", None)):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "go on", "", " \t", None, "Why?\n", "x" * 30 + ".", "é?", "ok."]
    return [(c if c else None, rng.choice([t, t, t, max(0, t - 1), None]), rng.choice(roles), rng.choice(texts)) for c in range(convs) for t in range(rng.randint(1, most))]


def test_repair_equals_search_over_audits(spark):
    rows = turns(1, 120, 9) + turns(2, 40, 12, ("user", "assistant"))
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("size", [1, 3])
def test_long_conversations_in_segments_and_tasks(spark, monkeypatch, size):
    monkeypatch.setattr(chat_repair, "SEGMENT_TURNS", size)
    rng = random.Random(size)
    rows = [(7, t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", f"c{t}.", f"d{t}", ""])) for t in range(400)]
    rows += turns(3, 20, 6) + [(8, 3, "user", "same.")] * 500
    df = spark.createDataFrame(rows, TURNS).withColumn("audit", F.lit("clash")).withColumn("copies_", F.lit(1))
    assert found(spark, df.repartition(5)) == brute(rows)


def test_conversations_that_lose_all_rows_and_empty_table(spark):
    rows = [(c, t, "user", "Hi.") for c in range(300) for t in range(1 + c % 2)]
    got = found(spark, rows)
    assert got == brute(rows)
    lost = [r for r in got if r[-1] == hashlib.sha256(b"").hexdigest() and r[6] == 0]
    assert lost and all(r[1:8] == (0, 0, 0, 0, 0, 0, "") for r in lost)
    assert found(spark, []) == []


def test_repaired_turns_are_legal(spark):
    rows = turns(5, 60, 8)
    fixed = chat_repair.repair(spark.createDataFrame(rows, TURNS)).where("segments = 1").collect()
    assert fixed and all(re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in r.roles)) for r in fixed)
