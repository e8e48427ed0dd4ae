"""Retrieval legs against plain Python, and the rules of fusion and expansion."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.functions import blockmax
from tidemark.operators import retrieval, text_index

TEXTS = {1: "The cache limit is 40 percent", 2: "cache cache limit", 3: "nothing here", 4: None, 5: "", 6: "Limit of 40 and of 50"}
ASKED = {10: "cache limit limit", 11: "what is 40", 12: "zebra", 13: None}


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "id long, text string")


@pytest.fixture
def index(docs, tmp_path):
    retrieval.write_index(docs, str(tmp_path / "index"))
    return retrieval.read_index(docs.sparkSession, str(tmp_path / "index"))


@pytest.fixture
def asked(spark):
    return spark.createDataFrame(list(ASKED.items()), "query_id long, text string")


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def ranked(rows):
    return {q: [i for _, i in sorted((-s, i) for i, s in found.items())] for q, found in rows.items() if found}


def got(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append(r.id)
    return dict(out)


def test_bm25_is_the_formula(index, asked):
    n, average = len(TEXTS), sum(len(words(t)) for t in TEXTS.values()) / len(TEXTS)
    df = Counter(w for t in TEXTS.values() for w in set(words(t)))
    expected = defaultdict(dict)
    for q, text in ASKED.items():
        for i, t in TEXTS.items():
            tf = Counter(words(t))
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(words(t)) / average)) for w in words(text) if tf[w])
            if s:
                expected[q][i] = round(s, 6)
    found = retrieval.bm25_topk(index, asked, 10)
    assert got(found) == ranked(expected)
    assert all(abs(r.score - expected[r.query_id][r.id]) < 2e-6 for r in found.collect())


def test_more_distinct_words_rank_higher_and_numbers_boost(index, asked):
    plain = got(retrieval.lexical_topk(index, asked, 10, boost=0.0))
    assert plain[10][0] in (1, 2) and set(plain[10]) == {1, 2, 6}
    boosted = {(r.query_id, r.id): r.score for r in retrieval.lexical_topk(index, asked, 10).collect()}
    without = {(r.query_id, r.id): r.score for r in retrieval.lexical_topk(index, asked, 10, boost=0.0).collect()}
    assert round(boosted[11, 6] - without[11, 6], 6) == 0.25
    assert boosted[10, 1] == without[10, 1]


def test_dense_topk_is_exact_and_leaves_zero_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0]), (5, None), (6, [5.0, 5.0])], "id long, vector array<double>")
    queries = spark.createDataFrame([(7, [1.0, 1.0]), (8, [0.0, 1.0]), (9, [0.0, 0.0]), (10, None)], "query_id long, vector array<double>")
    assert got(retrieval.dense_topk(corpus, queries, 3)) == {7: [3, 6, 1], 8: [2, 3, 6]}
    assert retrieval.dense_topk(corpus, queries.where("query_id = 10"), 3).count() == 0
    assert retrieval.dense_topk(corpus.where("id < 0"), queries, 3).count() == 0


def test_many_query_blocks_give_what_one_gives(spark, monkeypatch):
    rows = [(i, [math.sin(i * k + k) for k in range(1, 5)]) for i in range(60)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = corpus.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    whole = got(retrieval.dense_topk(corpus, queries, 4))
    monkeypatch.setattr(retrieval, "BLOCK", 2)
    monkeypatch.setattr(retrieval, "PASS_BLOCKS", 2)
    assert got(retrieval.dense_topk(corpus, queries, 4)) == whole


def test_terms_too_many_to_broadcast_give_the_same(index, asked, monkeypatch):
    few = got(retrieval.bm25_topk(index, asked, 10))
    monkeypatch.setattr(retrieval.small, "__defaults__", (1,))
    assert got(retrieval.bm25_topk(index, asked, 10)) == few


def test_search_skips_blocks_and_equals_all_scores(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(50)], k=rng.choice([0, 2, 9, 40]))) + rng.choice(["", " 7", " 8,5", " w49 7 8,5"])) for i in range(700)]
    docs = spark.createDataFrame([*rows, (9000, None), (None, "w1 w2")], "id long, text string")
    queries = spark.createDataFrame([(q, " ".join(rng.sample(vocabulary, 6)) + rng.choice([" 7", " 8.5 7", ""])) for q in range(12)] + [(90, "7"), (91, None), (92, "zz")], "query_id long, text string")
    monkeypatch.setattr(text_index, "SHARD_DOCS", 90)
    monkeypatch.setattr(text_index, "PASS_WORDS", 20)
    monkeypatch.setattr(blockmax, "FIRST_DOCS", 8)
    retrieval.write_index(docs, f"file://{tmp_path}/i")
    index = retrieval.read_index(spark, f"file://{tmp_path}/i")
    for boost in (0.0, 0.25, 3.0):
        every = retrieval.top_k(retrieval.lexical_scores(index, queries, boost), 7)
        assert sorted((r.query_id, r.rank, r.id, r.score) for r in retrieval.lexical_topk(index, queries, 7, boost).collect()) == sorted((r.query_id, r.rank, r.id, r.score) for r in every.collect())
    pairs = spark.createDataFrame([(0, 1), (0, 2), (3, 5), (3, 9000)], "query_id long, id long")
    some = {(r.query_id, r.id): r.score for r in retrieval.lexical_scores(index, queries, 0.25, pairs).collect()}
    whole = {(r.query_id, r.id): r.score for r in retrieval.lexical_scores(index, queries, 0.25).collect()}
    assert some == {k: v for k, v in whole.items() if k in {(0, 1), (0, 2), (3, 5), (3, 9000)}}
    assert index.stats.first()["n_docs"] == 702 and index.dictionary.where("term = 'w1'").first().df == sum("w1" in t.split() for _, t in rows)


def test_blocks_that_cannot_enter_are_not_read():
    rng = np.random.default_rng(1)
    n, lists, total = 20_000, [], np.zeros(20_000)
    for weight, share in ((0.2, 0.7), (3.0, 0.02), (6.0, 0.002)):
        docs = np.flatnonzero(rng.random(n) < share)
        values = rng.random(len(docs)) + 1.5 * (docs // 1000 % 10 == 3)
        ends = blockmax.even_blocks(docs, np.array([0]))
        lists.append((weight, blockmax.BlockList(docs, values, ends, np.maximum.reduceat(values, np.r_[0, ends[:-1] + 1]))))
        total[docs] += weight * values
    docs, scores, read = blockmax.best_documents(lists, n, 20, 0.0, 1e-6)
    assert docs[:20].tolist() == np.argsort(-total, kind="stable")[:20].tolist() and np.allclose(scores[:20], np.sort(total)[::-1][:20])
    assert read < 0.5 * sum(len(p.docs) for _, p in lists)


LEG = "query_id long, id long, rank long"


def test_fusion_sums_reciprocal_ranks_with_stable_ties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], LEG)
    b = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], LEG)
    rows = {r.id: r for r in retrieval.fuse([a, b], k=5).collect()}
    assert [i for i, _ in sorted(rows.items(), key=lambda x: x[1].rank)] == [11, 10, 12]
    assert rows[11].score == pytest.approx(2 / 62, abs=1e-9)
    assert (rows[12].first_leg, rows[12].first_rank) == (1, 1)
    heavier = retrieval.fuse([a, b], [1.0, 3.0], k=1).first()
    assert heavier.id == 11


def test_prune_keeps_the_heaviest_terms_ties_by_name(spark):
    from pyspark.sql import functions as F

    row = spark.sql("select map('b', 1.0d, 'a', 1.0d, 'c', 3.0d) as m").select(retrieval.prune_weights(F.col("m"), 2).alias("x")).first()
    assert [(e.term, e.weight) for e in row.x] == [("c", 3.0), ("a", 1.0)]


def test_gap_follows_dense_scores_and_no_hit_is_a_gap(spark):
    hits = spark.createDataFrame([(1, 0.9), (1, 0.2), (2, 0.1)], "query_id long, score double")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    assert {r.query_id: r.gap_warning for r in retrieval.gap_warning(hits, queries, 0.5).collect()} == {1: False, 2: True, 3: True}


def test_neighbours_are_near_or_last(spark):
    chunks = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)] + [("c", 0)], "file string, ord long")
    hits = spark.createDataFrame([(1, "a", 4, 1), (1, "b", 0, 2), (1, "c", 0, 3)], "query_id long, file string, ord long, rank long")
    found = sorted((r.file, r.ord) for r in retrieval.neighbours(hits, chunks, radius=1, sources=2).collect())
    assert found == [("a", 3), ("a", 4), ("a", 5), ("a", 9), ("b", 0), ("b", 1), ("b", 2)]


def test_interleaving_takes_documents_in_turns(spark):
    hits = spark.createDataFrame([(1, "a", o, o) for o in range(4)] + [(1, "b", 9, 7), (1, "c", 1, 8)], "query_id long, file string, ord long, rank long")
    rows = retrieval.interleave(hits, 3, 2).orderBy("position").collect()
    assert [(r.file, r.ord) for r in rows] == [("a", 0), ("a", 1), ("b", 9)]


def test_index_is_written_again_after_clear(spark):
    from tidemark.plans import retrieval as plans
    from tidemark.sources import shared

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables are not here")
    first = plans.bm25_topk(spark, sf).collect()
    shared.clear(spark)
    assert plans.bm25_topk(spark, sf).collect() == first


def test_products_of_queries_and_vectors_are_held_in_tiles():
    from types import SimpleNamespace
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(5)
    rows, queries = rng.normal(size=(10_000, 16)), rng.normal(size=(2048, 16))
    batch = pd.DataFrame({"id": np.arange(len(rows)), "vector": list(rows)})
    unit = queries / np.linalg.norm(queries, axis=1)[:, None]
    score = retrieval._block_scores(SimpleNamespace(value=[(np.arange(len(queries)), unit)]), 5)
    tracemalloc.start()
    found = pd.concat(score(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # all products at once are 164 MB, and were held three times
    for q in (0, 1000, 2047):
        exact = np.round(unit[q] @ (rows / np.linalg.norm(rows, axis=1)[:, None]).T, retrieval.ROUND)
        got = found[found.query_id == q].sort_values("score", ascending=False)
        assert got.id.tolist()[:5] == np.argsort(-exact, kind="stable")[:5].tolist()


def test_a_shard_holds_a_word_once():
    import tracemalloc

    words = [f"word{i:03d}" for i in range(400)]
    tracemalloc.start()
    shard = text_index._Shard()
    for i in range(1500):
        shard.add(i, " ".join(words[i % 7 :]), ["3.5"])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 12 << 20  # the words themselves are 600,000 objects, 28 MB and more
    lists = {r["term"]: r for part in shard.lists(9, rows_at_once=50) for r in part.to_pylist()}
    assert len(lists) == 401 and lists["#3.5"]["ids"] == list(range(1500)) and lists["word399"]["df"] == 1500
    assert lists["word000"]["ids"] == list(range(0, 1500, 7)) and lists["word000"]["shard"] == 9 and lists["word000"]["lens"][0] == 400


def test_a_search_has_tasks_for_the_shards(spark, index):
    many = text_index.TextIndex(index.lists, index.dictionary, spark.createDataFrame([(40 * text_index.SHARD_DOCS, 3.0)], "n_docs long, avgdl double"))
    asked = spark.createDataFrame([(1, "cache", 1.0)], "query_id long, term string, weight double")
    found = text_index.search(many, asked, 5, lambda tf, length: tf)
    assert found.rdd.getNumPartitions() == 40 and {r.id for r in found.collect()} == {1, 2}


def test_vocabulary_overlap_reads_no_postings(spark, monkeypatch, tmp_path):
    from tidemark.plans import evaluation

    spark.createDataFrame([(1, "a word and 7"), (2, "none")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    known = spark.createDataFrame([("word", 3), ("7", 1), ("#none", 1)], "term string, df long")
    monkeypatch.setattr(evaluation, "text_index", lambda *_: text_index.TextIndex(None, known, None))
    assert sorted(map(tuple, evaluation.vocabulary_overlap(spark, str(tmp_path)).collect())) == [(1, 4, 2), (2, 1, 0)]


def test_sparse_vectors_are_dealt_to_tasks_of_bounded_size(spark, index, monkeypatch):
    from tidemark.plans import retrieval as plans

    many = text_index.TextIndex(index.lists, index.dictionary, spark.createDataFrame([(40 * text_index.SHARD_DOCS, 3.0)], "n_docs long, avgdl double"))
    monkeypatch.setattr(plans, "text_index", lambda *_: many)
    found = plans.sparse_sidecar(spark, "")
    assert found.rdd.getNumPartitions() == 40 and {(r.id, r.term) for r in found.collect()} >= {(1, "cache"), (6, "limit")}
