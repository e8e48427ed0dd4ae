"""Queries that SQL can't express, and rules of search, structure and governance, against plain Python."""

import hashlib
import itertools
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.functions import chunking
from tidemark.functions import text as T
from tidemark.operators import arms, corpus, governance, retrieval, search, structure
from tidemark.plans import catalog
from tidemark.sources import files

DATA = Path("/root/testdata/sf0.001")
tables_here = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables are not here")


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@tables_here
@pytest.mark.parametrize("name,cut", [("document_chunks", chunking.prose_chunks), ("code_chunks", chunking.code_chunks)])
def test_chunk_queries_equal_loops_over_all_documents(spark, name, cut):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {(i, k, md5(f"{i}:{k}"), md5(piece)) for i, t in docs for k, piece in enumerate(cut(t))}
    assert {tuple(r) for r in catalog.queries()[name](spark, str(DATA)).select("doc_id", "ord", "chunk_id", "text_md5").collect()} == want


@tables_here
def test_table_chunks_and_page_texts_cover_all_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = catalog.queries()["table_chunks"](spark, str(DATA)).select("doc_id", "ord", "row_start", "row_end", "numbers", "text_md5").collect()
    want = {(i, k, a, b, "|".join(n), md5(t)) for i, text in docs for k, (t, a, b, n) in enumerate(chunking.table_pieces(text))}
    assert {tuple(r) for r in got} == want
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    assert catalog.queries()["page_texts"](spark, str(DATA)).count() == pages.count()


@tables_here
def test_query_set_digest_of_turns(spark):
    got = {r.role: r for r in catalog.queries()["query_set_digests"](spark, str(DATA)).collect()}
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    for role in {r.role for r in turns}:
        own = [(r.text, r.turn % 2 == 0) for r in turns if r.role == role]
        assert got[role].n == len(own) and (got[role].problem is None) == (len(set(own)) == len(own) and all(t and t.strip() for t, _ in own))


def test_query_set_digest_needs_no_order(spark):
    rows = [("a", "q1", True), ("a", "q2", False), ("b", "q2", False), ("b", "q1", True), ("c", "q1", True), ("c", "q1", True), ("d", " ", True)]
    got = {r.k: r for r in governance.query_set_digest(spark.createDataFrame(rows, "k string, query string, answerable boolean"), ["k"]).collect()}
    assert got["a"].digest == got["b"].digest != got["c"].digest
    assert (got["a"].problem, got["c"].problem, got["d"].problem) == (None, "repeats a labelled query", "needs a query and a label")


def test_long_text_is_cut_as_the_rule_says():
    rng = random.Random(1)
    for _ in range(3000):
        text, most, overlap = "".join(rng.choice("ab  \n") for _ in range(rng.randrange(60))), rng.randrange(1, 30), rng.randrange(12)
        repeat, least, want, start = min(overlap, most // 4), most // 8, [], 0
        while len(text) - start > most:
            blanks = [i for i in range(start + 1, start + most) if text[i] in " \n" and i - start >= least]
            end = blanks[-1] if blanks else start + most
            want.append(text[start:end])
            shared = [i for i in range(max(start + 1, end - repeat), end) if text[i] in " \n"] if repeat else []
            start = shared[0] + 1 if shared and shared[0] - start >= least else end
        want.append(text[start:])
        assert chunking.cut_long(text, most, overlap) == [w.strip() for w in want if w.strip()]


def test_table_rows_stay_under_their_header():
    head = "Prices\n| item | cost |\n| --- | --- |"
    rows = [f"| thing {i} | {i},5 |" for i in range(60)]
    pieces = chunking.table_pieces(head + "\n" + "\n".join(rows), 200)
    assert all(t.startswith("Prices\n\n| item | cost |\n| --- | --- |\n| thing") and len(t) <= 200 for t, *_ in pieces)
    assert [i for _, a, b, _ in pieces for i in range(a, b + 1)] == list(range(60))
    assert pieces[0][3][:2] == ["0", "0.5"] and list(itertools.chain(*(t.split("\n")[4:] for t, *_ in pieces))) == rows
    assert chunking.table_pieces(None) == [] and chunking.table_pieces("| a |\n| - |")[0][0] == "| a |\n| - |"
    assert all(len(t) <= 30 for t, *_ in chunking.table_pieces("| a |\n| - |\n| " + "x " * 100 + "|", 30))


HIT = "query_id long, id long, file string, text string, score double, confidence double, final_pos long"


def test_slots_take_one_hit_each_and_name_open_ones(spark):
    hits = [(1, 10, "a", "limit and cache", 0.9, 0.9, 1), (1, 11, "b", "cache cache size", 0.8, 0.8, 2), (1, 12, "c", "owner is Ann", 0.7, 0.7, 3), (2, 10, "a", "limit", 0.9, 0.9, 1)]
    df = spark.createDataFrame(hits, HIT)
    slots = {"what": (["cache"], 1), "who": (["owner", "ann"], 2)}
    for mode in ("greedy", "beam"):
        got = {(r.query_id, r.id, r.missing) for r in search.slot_evidence(df, slots, mode=mode).collect()}
        assert got == {(1, 10, ""), (1, 12, "")} | ({(2, None, "what,who")} if mode == "greedy" else set())
    got = {(r.query_id, r.position, r.id, r.missing) for r in search.slot_evidence(df, slots, documents=1).collect()}
    assert got == {(1, 1, 10, "who"), (2, None, None, "what,who")}


def test_beam_equals_all_subsets_when_it_is_wide(spark):
    rng = random.Random(5)
    hits = [(1, i, rng.choice("abc"), rng.choice(["cache", "owner", "cache owner", "none"]), rng.random(), rng.random(), i + 1) for i in range(7)]
    slots = {"what": (["cache"], 1), "who": (["owner"], 1)}

    def worth(state):
        rows = [hits[i] for i in state]
        if len({r[2] for r in rows}) > 2:
            return -1e6
        covered = sum(any(w in r[3] for r in rows) for w in ("cache", "owner"))
        return 100.0 * covered + sum(r[5] + 0.1 * r[4] for r in rows) + 0.25 * len({r[2] for r in rows}) - 3.0 * sum(r[3] == "none" for r in rows) - 0.0001 * sum(state)

    best = max((s for n in range(4) for s in itertools.combinations(range(7), n)), key=worth)
    got = [r.id for r in search.slot_evidence(spark.createDataFrame(hits, HIT), slots, items=3, mode="beam", beam=500).orderBy("position").collect()]
    assert got == list(best)


def test_near_copies_give_way_to_newer_ones(spark):
    rows = [(1, 1, 10, [1.0, 0.0], None), (1, 2, 11, [1.0, 0.01], 5), (1, 3, 12, [0.0, 1.0], 3), (1, 4, 13, [0.01, 1.0], None), (1, 5, 14, [1.0, 0.0], 9)]
    df = spark.createDataFrame(rows, "query_id long, rank long, id long, vector array<double>, created long")
    assert [(r.position, r.id) for r in retrieval.collapse_near_copies(df, 0.9).orderBy("position").collect()] == [(1, 14), (2, 12)]


def test_cycles_of_all_lengths_with_tails(spark):
    edges, want = [], set()
    for n in (1, 2, 3, 7, 40):
        ring = [f"r{n}-{i:02d}" for i in range(n)]
        edges += [(ring[i], ring[(i + 1) % n]) for i in range(n)]
        want.add(ring[0])
    edges += [(f"tail{i}", f"tail{i + 1}") for i in range(90)] + [(f"r3-00", "branch0")] + [(f"branch{i}", f"branch{i + 1}") for i in range(50)]
    got = corpus.cycles(spark.createDataFrame(edges, "target string, successor string"))
    assert {r.file for r in got.collect()} == want
    assert corpus.cycles(spark.createDataFrame([], "target string, successor string")).count() == 0


def test_ledger_takes_the_last_line_written(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"question_id": "a", "v": "z"}\n{"question_id": "b", "v": 1}\n{broken\n{"question_id": "a", "v": "b"}\n')
    got = {r.question_id: r.line for r in files.read_ledger(spark, str(tmp_path)).collect()}
    assert got == {"a": '{"question_id": "a", "v": "b"}', "b": '{"question_id": "b", "v": 1}'}


def test_relational_questions(spark):
    asked = ["Why so?", "the cache size", "What changed", "perhaps", "what is the status", "tell me about THEM", None, "itinerary"]
    got = [r[0] for r in spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i long, q string").orderBy("i").select(T.relational(F.col("q"))).collect()]
    assert got == [True, False, True, False, True, True, False, False]


def test_names_are_quoted_data(spark):
    names = ['a"b\nc', None, "‮ \t", "x" * 130, "two  words"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, n string").orderBy("i").select(T.safe_reference(F.col("n"))).collect()]
    assert got == ["\"a'bc\"", "unknown", "unknown", '"' + "x" * 120 + '…"', '"two words"']


def test_reviews_step_in_turn(spark):
    events = [("p", 1, "review", "r", "n"), ("p", 2, "accept", "r", "n"), ("p", 3, "promote", "r", "n"), ("q", 1, "accept", "r", "n"), ("q", 2, "review", None, "n"), ("s", 1, "review", "r", "n"), ("s", 2, "reject", "r", "n"), ("s", 3, "accept", "r", "n")]
    df = spark.createDataFrame(events, "proposal_id string, seq long, action string, reviewer string, note string")
    got = {r.proposal_id: (r.state, r.trusted) for r in governance.review(spark.createDataFrame([("p", 1), ("q", 1), ("s", 1), ("t", 0)], "proposal_id string, n_evidence long"), df).collect()}
    assert got == {"p": ("promoted", True), "q": ("proposed", False), "s": ("rejected", False), "t": ("proposed", False)}


@pytest.mark.parametrize("fold", [1, 5, 4096])
def test_packing_equals_a_loop_beyond_the_fold(spark, monkeypatch, fold):
    monkeypatch.setattr(structure, "FOLD", fold)
    rng = random.Random(fold)
    rows = [("g", i, s) for i, s in enumerate([4, 4, 9, 1, 1, 1, 1, 12])] + [("h", i, rng.choice([0, 1, 3, 5, 9, 11, None])) for i in range(700)] + [(None, i, 3) for i in range(9)]
    want = []
    for g in ("g", "h", None):
        used, batch = 11, -1
        for _, o, s in (r for r in rows if r[0] == g):
            fits = used + 2 + (s or 0) <= 10
            used, batch = (used + 2 + (s or 0), batch) if fits else (s or 0, batch + 1)
            want.append((g, o, batch))
    df = spark.createDataFrame(rows, "g string, o long, s long").repartition(3)
    assert sorted(map(tuple, structure.packed(df, "g", "o", "s", 10, joint=2).collect()), key=str) == sorted(want, key=str)


def test_packing_numbers_batches_over_many_segments(spark):
    rows = spark.range(5000).selectExpr("'g' as g", "id as o", "100L as s")
    got = [r.batch for r in structure.packed(rows, "g", "o", "s", 300).orderBy("o").collect()]
    assert got == [i // 3 for i in range(5000)]


def test_cycles_through_files_with_several_targets(spark):
    edges = [("a", "b"), ("b", "a"), ("z", "b"), ("y", "z"), ("m", "k"), ("k", "n"), ("n", "m"), ("c", "n"), ("c", "d"), ("d", "c"), ("q", "q"), ("p", "q"), (None, "x"), ("a", "b")]
    assert {r.file for r in corpus.cycles(spark.createDataFrame(edges, "target string, successor string")).collect()} == {"a", "k", "c", "q"}


def test_recency_takes_the_newest_confident_hit(spark):
    rows = [(1, 1, "ok", None, 0.9, 1), (1, 2, "superseded", "x", 0.8, 5), (1, 3, "ok", None, 0.1, 9), (2, 1, "superseded", "x", 0.2, 1)]
    df = spark.createDataFrame(rows, "query_id long, pos long, verdict string, superseded_by string, score double, indexed_at long")
    r = arms.stale_trust(df, 0.5).first()
    assert (r.n, r.plain, r.recency, r.trusted, r.coverage) == (2, 0.5, 1.0, 0.0, 0.5)


def test_packing_many_small_groups_and_one_without_a_name(spark):
    rows = [(g if g else None, o, (g * 7 + o * 13) % 40) for g in range(1500) for o in range(1 + g % 4)] + [(None, o, 9) for o in range(1, 50)]
    got = structure.packed(spark.createDataFrame(rows, "g long, o long, s long").repartition(5), "g", "o", "s", 50)
    want, used, batch, last = [], 0, -1, "none"
    for g, o, s in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        used, batch = (s, 0) if g != last else (used + s, batch) if used + s <= 50 else (s, batch + 1)
        want.append((g, o, batch))
        last = g
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
