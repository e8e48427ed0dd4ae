"""Supersession edges, walks, verdicts and abstention on small corpora that hold every case."""

from datetime import datetime

import pytest

from tidemark.operators import trust

CLAIM = "file string, supersedes string, first_indexed timestamp"


def claims(spark, rows):
    at = lambda day: datetime(2024, 1, day) if day else None
    return spark.createDataFrame([(f, s, at(d)) for f, s, d in rows], CLAIM)


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_references_resolve_dangle_or_are_ambiguous(spark):
    rows = [("b.md", "[[a]]", 1), ("a.md", None, 1), ("x/c.md", "gone.md", 1), ("one/d.md", None, 1), ("two/d.md", None, 1), ("e.md", "d", 1), (None, "a", 1), ("f.md", "", 1)]
    found = {r.file: (r.target, r.status) for r in trust.resolve_references(claims(spark, rows)).collect()}
    assert found == {"b.md": ("a.md", "resolved"), "x/c.md": ("gone.md", "dangling"), "e.md": (None, "ambiguous")}
    assert pairs(trust.ambiguous_files(claims(spark, rows)), "file") == [("one/d.md",), ("two/d.md",)]


def test_last_claim_in_order_wins(spark):
    rows = [("a.md", None, 1), ("b.md", "a", 5), ("c.md", "a", 2)]
    assert pairs(trust.edges(claims(spark, rows)), "target", "successor") == [("a.md", "c.md")]


def test_as_of_takes_the_latest_dated_claim(spark):
    rows = [("a.md", None, 1), ("b.md", "a", 5), ("c.md", "a", 2), ("d.md", "a", 20), ("z.md", "a", None)]
    at = lambda day: pairs(trust.edges(claims(spark, rows), f"2024-01-{day:02d}"), "target", "successor")
    assert at(10) == [("a.md", "b.md")]
    assert at(3) == [("a.md", "c.md")]
    assert at(1) == [("a.md", "z.md")]
    assert at(25) == [("a.md", "d.md")]


@pytest.mark.parametrize(
    "edges, expected",
    [
        ([("a", "b"), ("b", "c"), ("c", "d")], {"a": "d", "b": "d", "c": "d"}),
        ([("a", "b"), ("b", "a")], {"a": "b", "b": "a"}),
        ([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], {"a": "b", "b": "c", "c": "a", "x": "a"}),
        ([("a", "b"), ("b", "b")], {"a": "b"}),
        ([("a", "a")], {}),
        ([], {}),
    ],
)
def test_successor_walks(spark, edges, expected):
    live = spark.createDataFrame(edges, "target string, successor string")
    assert dict(pairs(trust.successors(live), "file", "successor")) == expected


def test_a_long_chain_ends_at_its_end(spark):
    live = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(100)], "target string, successor string")
    assert {r.successor for r in trust.successors(live).collect()} == {"n100"}


HIT = "query_id long, pos long, file string, score double, valid_from string, valid_until string, first_indexed timestamp, indexed_at timestamp"
SEEN = datetime(2024, 1, 1)


def hit(pos, file, score=0.9, start=None, end=None, first=SEEN, indexed=SEEN):
    return (1, pos, file, score, start, end, first, indexed)


def judged(spark, rows, succ=(), ambiguous=(), **more):
    hits = spark.createDataFrame(rows, HIT)
    edges = spark.createDataFrame(list(succ), "file string, successor string")
    unresolved = spark.createDataFrame([(a,) for a in ambiguous], "file string")
    return trust.evaluate(hits, edges, unresolved, now="2024-06-15 00:00:00", threshold=0.5, **more)


def test_every_verdict(spark):
    rows = [
        hit(1, "bad", start="2024-13-45"), hit(2, "late", first=datetime(2024, 6, 10)), hit(3, "amb"), hit(4, "old"), hit(5, "gone", end="2024-06-01"),
        hit(6, "soon", start="2024-07-01"), hit(7, "weak", 0.49), hit(8, "edge", 0.5), hit(9, "today", end="2024-06-15"), hit(10, "timeless", first=None, indexed=None),
    ]
    found = {r.file: r.verdict for r in judged(spark, rows, [("old", "new")], ["amb"], known_as_of="2024-06-01").collect()}
    assert found == {
        "bad": "invalid_metadata", "late": "not_yet_known", "amb": "ambiguous_supersession", "old": "superseded", "gone": "expired", "soon": "not_yet_valid",
        "weak": "low_confidence", "edge": "ok", "today": "ok", "timeless": "ok",
    }


def test_a_named_successor_is_promoted_only_by_a_confident_hit(spark):
    rows = [hit(1, "old", 0.8), hit(2, "new", 0.3), hit(3, "weak_old", 0.4), hit(4, "weak_new", 0.3)]
    out = {r.file: r for r in judged(spark, rows, [("old", "new"), ("weak_old", "weak_new")]).collect()}
    assert (out["new"].verdict, out["weak_new"].verdict) == ("ok", "low_confidence")
    assert out["new"].final_pos == 1 and out["old"].final_pos == 2
    assert out["old"].superseded_by == "new"


def test_abstention_gives_the_reason_of_the_best_hit(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    out = {r.query_id: (r.abstained, r.reason) for r in trust.abstentions(judged(spark, [hit(1, "old", 0.9), hit(2, "weak", 0.1)], [("old", "new")]), queries).collect()}
    assert out == {1: (True, "best hit old is superseded by new"), 2: (True, "nothing was retrieved")}
    fine = trust.abstentions(judged(spark, [hit(1, "good", 0.9)]), queries.where("query_id = 1")).first()
    assert (fine.abstained, fine.reason) == (False, "")


def test_empty_hits(spark):
    assert judged(spark, []).count() == 0


def test_bound_hits_need_generation_model_and_calibration(spark):
    from tidemark.operators import search

    hits = [(q, q, "ok" if n else "superseded", n + 1, 2 - n) for q in range(5) for n in range(2)]
    bindings = [(0, "g", "m", 64, "certified"), (1, "g", "m", 32, "certified"), (2, "g", "m", 64, "stale"), (3, "g", "m", 64, None)]
    df = spark.createDataFrame(hits, "query_id long, tenant_id long, verdict string, pos long, final_pos long")
    bound = spark.createDataFrame(bindings, "tenant_id long, generation_id string, embedder_model string, embedder_dimension int, status string")
    got = {(r.query_id, r.pos): (r.verdict, r.final_pos, r.failure_code, r.trust_state) for r in search.bound(df, bound, "m", 64).collect()}
    assert got[0, 1] == ("superseded", 2, None, "trusted") and got[0, 2] == ("ok", 1, None, "trusted")
    codes = {1: "LINEAGE_MISMATCH", 2: "CALIBRATION_STALE", 3: "CALIBRATION_MISSING", 4: "INDEX_NOT_READY"}
    assert all(got[q, p] == ("unverified", p, code, "degraded") for q, code in codes.items() for p in (1, 2))
    assert {r.query_id for r in search.bound(df, bound, "m", 64, strict=True).collect()} == {0}
    pool = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "query_id long, id long, pos long")
    scores = spark.createDataFrame([(1, 2, 0.5), (1, 4, 0.9), (1, 5, 0.5), (2, 1, 1.0)], "query_id long, id long, rerank double")
    assert [r.id for r in search.rerank(pool, scores).orderBy("pos").collect()] == [4, 2, 5, 1, 3]
