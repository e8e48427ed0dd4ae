"""The vector index against exact search: equal rows in the exact mode, recall and cells read otherwise."""


import numpy as np
import pytest

from tidemark.operators import retrieval, vector_index

VECTORS = "id long, vector array<double>"


def frame(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


def clustered(seed, n, dim=8, centres=12):
    rng = np.random.default_rng(seed)
    around = rng.normal(size=(centres, dim))
    return [(i, (around[i % centres] + 0.3 * rng.normal(size=dim)).tolist()) for i in range(n)]


def rows(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in df.collect())


def index_of(spark, tmp_path, corpus, **more):
    vector_index.write_vector_index(corpus, f"file://{tmp_path}/index", **more)
    return vector_index.read_vector_index(spark, f"file://{tmp_path}/index")


@pytest.mark.parametrize("small", [False, True])
def test_exact_mode_has_the_rows_of_a_full_search(spark, tmp_path, monkeypatch, small):
    if small:  # cells and their queries in parts
        monkeypatch.setattr(vector_index, "CELL_ROWS", 20)
        monkeypatch.setattr(vector_index, "QUERY_ROWS", 5)
    data = clustered(1, 900) + [(5000, None), (5001, [0.0] * 8), (5002, clustered(1, 900)[0][1]), (5003, clustered(1, 900)[0][1])]
    corpus = frame(spark, data)
    queries = frame(spark, [r for r in data if r[0] % 30 == 0 or r[0] > 4999]).withColumnRenamed("id", "query_id")
    index = index_of(spark, tmp_path, corpus)
    want = rows(retrieval.dense_topk(corpus, queries, 10))
    assert rows(vector_index.indexed_topk(index, queries, 10, exact=True)) == want
    assert rows(vector_index.indexed_topk(index, queries, 10, probes=10**6)) == want
    assert rows(vector_index.indexed_topk(index, queries, 2000, probes=1, exact=True)) == rows(retrieval.dense_topk(corpus, queries, 2000))


@pytest.mark.parametrize("n", [600, 3000])
def test_recall_and_cells_read(spark, tmp_path, n):
    corpus = frame(spark, clustered(n, n))
    queries = corpus.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    index = index_of(spark, tmp_path, corpus)
    best = {(r[0], r[2]) for r in rows(retrieval.dense_topk(corpus, queries, 10))}
    found = {(r[0], r[2]) for r in rows(vector_index.indexed_topk(index, queries, 10))}
    assert len(best & found) >= 0.95 * len(best)
    read = vector_index.cells_read(index, queries).collect()
    assert sum(r.n_vectors for r in read) < 0.6 * n * len(read) and {r.n_cells for r in read} == {index.probes}


def test_only_probed_cells_are_read(spark, tmp_path):
    index = index_of(spark, tmp_path, frame(spark, clustered(4, 600)), cells=10)
    asked = vector_index.stored(vector_index.nearest_cells(index, frame(spark, clustered(4, 1)).withColumnRenamed("id", "query_id"), 2))
    plan = vector_index._in_cells(index, asked, 3)._jdf.queryExecution().toString()
    cells = sorted(r.cell for r in asked.collect())
    assert len(cells) == 2 and "PartitionFilters: [" in plan and all(str(c) in plan.split("PartitionFilters", 1)[1][:200] for c in cells)


def test_empty_and_constant_tables(spark, tmp_path):
    queries = frame(spark, [(1, [1.0, 0.0])]).withColumnRenamed("id", "query_id")
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    assert vector_index.indexed_topk(index_of(spark, tmp_path / "a", frame(spark, [])), queries, 3).count() == 0
    index = index_of(spark, tmp_path / "b", frame(spark, [(i, [2.0, 0.0]) for i in range(50)] + [(99, None)]))
    assert [r[2] for r in rows(vector_index.indexed_topk(index, queries, 3, exact=True))] == [0, 1, 2]
