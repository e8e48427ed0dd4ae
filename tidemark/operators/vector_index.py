"""An inverted-file index of vectors: cells around centroids, stored in folders by cell.

Centroids are fitted on a bounded sample; every vector is assigned to the nearest one and written in its cell's
folder. A query is sent to the cells of its nearest centroids only, and only their folders are read. Cells with many
vectors or many queries are split, so a task holds CELL_ROWS vectors and QUERY_ROWS queries at most. The exact mode
goes on to every further cell that can hold one of the k best, by the angle between query and centroid and the cell's
greatest angle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.retrieval import _unit_rows, best_products, tiles, top_k
from tidemark.sources.shared import stored

#: Cells at most; bytes of the sample that centroids are fitted on, vectors of it for each cell, rounds of the fit.
MOST_CELLS, SAMPLE_BYTES, SAMPLE_PER_CELL, FIT_ROUNDS = 4096, 1 << 26, 32, 8
#: Vectors and queries of a cell that one task compares.
CELL_ROWS, QUERY_ROWS = 1 << 16, 2048
#: Vectors of the sample whose neighbours there decide how many cells are probed, so that of their NEAREST the share
#: TARGET is found. A sample is sparser than the table, so neighbours in it lie further off and ask for more cells.
JUDGED, NEAREST, TARGET = 256, 10, 0.975
#: Room for rounding where bounds and scores are compared.
SLACK = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """(cell, split, id, vector) in folders by cell; centroids by cell, each cell's greatest angle and splits; the
    number of cells that a query probes."""

    cells: DataFrame
    centroids: np.ndarray
    angles: np.ndarray
    splits: np.ndarray
    probes: int


def _fit(rows: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means of unit rows; begins with rows spread over the sample."""
    centroids = rows[np.linspace(0, len(rows) - 1, cells).astype(int)].copy()
    for _ in range(FIT_ROUNDS):
        nearest = np.concatenate([(part @ centroids.T).argmax(axis=1) for part in np.array_split(rows, max(1, len(rows) * cells >> 24))])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, rows)
        size = np.linalg.norm(sums, axis=1)
        centroids[size > 0] = sums[size > 0] / size[size > 0, None]
    return centroids


def _probes(rows: np.ndarray, centroids: np.ndarray) -> int:
    """Cells that have to be probed for the TARGET share of the nearest neighbours of some sampled rows."""
    asked = np.linspace(0, len(rows) - 1, min(JUDGED, len(rows))).astype(int)
    scores = rows[asked] @ rows.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(NEAREST, len(rows) - 1)]
    cell = (rows @ centroids.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(rows[asked] @ centroids.T), axis=1), axis=1)
    ranks = np.take_along_axis(place, cell[best], axis=1).ravel()
    return int(np.quantile(ranks, TARGET, method="higher")) + 1 if len(ranks) else 1


def _found(vectors: pd.Series) -> np.ndarray:
    """Which vectors have a direction: null and zero ones are never found."""
    return np.array([v is not None and bool(np.any(np.asarray(v, dtype=float))) for v in vectors], dtype=bool)


def _cut(batches: Iterator[pd.DataFrame], cells: int) -> Iterator[pd.DataFrame]:
    """Batches so small that their products with the centroids are a tile."""
    return (b.iloc[some] for b in batches for some in tiles(len(b), cells))


def write_vector_index(corpus: DataFrame, folder: str, cells: int | None = None) -> None:
    """Index ``corpus`` (id, vector). About sqrt(n) cells, MOST_CELLS at most; the sample is taken by a hash of the id."""
    spark = corpus.sparkSession
    rows = corpus.where("vector is not null").select("id", "vector")
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    cells = max(1, min(MOST_CELLS, cells or int(np.sqrt(n or 0))))
    wanted = max(cells, min(SAMPLE_PER_CELL * cells, SAMPLE_BYTES // (8 * (dim or 1))))
    share = min(1.0, 1.2 * wanted / max(1, n))
    some = [r.vector for r in rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("id")).limit(wanted).collect()]  # the bounded sample
    some = [v for v in some if np.any(v)]
    sample = _unit_rows(some) if some else np.zeros((0, dim or 1))
    centroids = _fit(sample, min(cells, len(some))) if some else sample
    probes = _probes(sample, centroids) if some else 1
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _cut(batches, len(sent.value)):
            b = b[_found(b.vector)]
            if len(b):
                near = _unit_rows(b.vector.tolist()) @ sent.value.T
                cell = near.argmax(axis=1)
                yield pd.DataFrame({"cell": cell.astype(np.int32), "angle": np.arccos(np.clip(near[np.arange(len(b)), cell], -1, 1)), "id": b.id, "vector": b.vector})

    placed = stored(rows.mapInPandas(assign, f"cell int, angle double, id {rows.schema['id'].dataType.simpleString()}, vector {rows.schema['vector'].dataType.simpleString()}"))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle"))  # MOST_CELLS rows
    facts = sizes.select("cell", "angle", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("splits"))
    dealt = placed.join(F.broadcast(facts.select("cell", "splits")), "cell").withColumn("split", F.pmod(F.xxhash64("id"), F.col("splits")).cast("int"))
    dealt.select("cell", "split", "id", "vector").repartition("cell", "split").sortWithinPartitions("cell", "split").write.partitionBy("cell").parquet(f"{folder}/cells")
    known = {r.cell: (r.angle, r.splits) for r in facts.collect()}
    table = [(i, c.tolist(), *known.get(i, (0.0, 0)), probes) for i, c in enumerate(centroids)]
    spark.createDataFrame(table, "cell int, centroid array<double>, angle double, splits int, probes int").write.parquet(f"{folder}/centroids")


def read_vector_index(spark: SparkSession, folder: str) -> VectorIndex:
    table = spark.read.parquet(f"{folder}/centroids").orderBy("cell").collect()  # MOST_CELLS rows at most
    if not table:
        return VectorIndex(spark.createDataFrame([], "cell int, split int, id long, vector array<double>"), np.zeros((0, 1)), np.zeros(0), np.zeros(0, dtype=int), 1)
    centroids = np.array([r.centroid for r in table])
    return VectorIndex(spark.read.parquet(f"{folder}/cells"), centroids, np.array([r.angle for r in table]), np.array([r.splits for r in table]), table[0].probes)


_SENT = "query_id long, vector array<double>, cell int"


def nearest_cells(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, vector, cell): the ``probes`` cells whose centroids are nearest to each query."""
    sent = queries.sparkSession.sparkContext.broadcast((index.centroids, index.splits))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, splits = sent.value
        for b in _cut(batches, len(centroids)):
            b = b[_found(b.vector)]
            if len(b) and len(centroids):
                near = np.where(splits > 0, _unit_rows(b.vector.tolist()) @ centroids.T, -np.inf)
                best = np.argsort(-near, axis=1, kind="stable")[:, : min(probes, int((splits > 0).sum()))]
                yield pd.DataFrame({"query_id": np.repeat(b.query_id.to_numpy(), best.shape[1]), "vector": [v for v in b.vector for _ in range(best.shape[1])], "cell": best.ravel().astype(np.int32)})

    return queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).mapInPandas(route, _SENT)


def further_cells(index: VectorIndex, queries: DataFrame, found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vector, cell): cells that weren't ``asked`` and can hold a vector as good as the k-th ``found``."""
    kth = found.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("kth"))
    sent = queries.sparkSession.sparkContext.broadcast((index.centroids, index.angles, index.splits))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, angles, splits = sent.value
        for b in _cut(batches, len(centroids)):
            b = b[_found(b.vector)]
            if len(b) and len(centroids):
                between = np.arccos(np.clip(_unit_rows(b.vector.tolist()) @ centroids.T, -1, 1))
                bound = np.cos(np.maximum(between - angles, 0.0))
                q, cell = np.nonzero((splits > 0) & ((bound + SLACK >= b.kth.to_numpy()[:, None]) | b.kth.isna().to_numpy()[:, None]))
                yield pd.DataFrame({"query_id": b.query_id.to_numpy()[q], "vector": [b.vector.iloc[i] for i in q], "cell": cell.astype(np.int32)})

    rows = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).join(kth, "query_id", "left")
    return rows.mapInPandas(route, _SENT).join(asked.select("query_id", "cell"), ["query_id", "cell"], "left_anti").select("query_id", "vector", "cell")


def _in_cells(index: VectorIndex, routed: DataFrame, k: int) -> DataFrame:
    """The k best of each query in the cells that it is routed to. ``routed`` is a stored table."""
    spark = routed.sparkSession
    loads = {r.cell: r.n for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # MOST_CELLS rows at most
    if not loads:
        return spark.createDataFrame([], "query_id long, id long, score double, rank long")
    deal = [(int(c), s, q) for c, n in loads.items() for s in range(int(index.splits[c])) for q in range(-(-n // QUERY_ROWS))]
    plan = F.broadcast(spark.createDataFrame(deal, "cell int, split int, part int"))  # a row a task
    parts = F.broadcast(spark.createDataFrame([(int(c), -(-n // QUERY_ROWS)) for c, n in loads.items()], "cell int, parts int"))
    asked = routed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts").join(plan, ["cell", "part"])
    held = index.cells.where(F.col("cell").isin([int(c) for c in loads])).join(plan, ["cell", "split"])

    def compare(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64"})
        q, at, scores = best_products(_unit_rows(queries.vector.tolist()), _unit_rows(rows.vector.tolist()), k)
        return pd.DataFrame({"query_id": queries.query_id.to_numpy()[q], "id": rows.id.to_numpy()[at], "score": scores})

    key = ["cell", "split", "part"]
    return top_k(held.groupBy(key).cogroup(asked.groupBy(key)).applyInPandas(compare, "query_id long, id long, score double"), k)


def indexed_topk(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query_id, id, score, rank): cosine top-k of ``queries`` (query_id, vector) in the nearest ``probes`` cells.

    With ``exact`` the rows are those of ``retrieval.dense_topk``; cells that can't hold any of them are not read.
    """
    asked = stored(nearest_cells(index, queries, probes or index.probes))
    found = _in_cells(index, asked, k)
    if not exact:
        return found
    found = stored(found)
    more = stored(further_cells(index, queries, found, asked, k))
    return top_k(found.drop("rank").unionByName(_in_cells(index, more, k).drop("rank")), k)


def cells_read(index: VectorIndex, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """(query_id, n_cells, n_vectors): what a search reads for each query."""
    sizes = index.cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    asked = nearest_cells(index, queries, probes or index.probes)
    return asked.join(F.broadcast(sizes), "cell").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_vectors"))
