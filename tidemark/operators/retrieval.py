"""Retrieval legs, fusion and expansion for batches of queries.

Queries are the small side: a stated set, sent to the tasks in blocks of a checked size. Every leg returns
(query_id, id, score, rank), rank counting from 1; scores are rounded to ROUND digits before ranking so that ties
fall to the smallest id whatever the order of summation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.text import numeric_terms, tokens
from tidemark.operators.text_index import TextIndex, exploded, read_index, search, write_index  # noqa: F401
from tidemark.sources.shared import stored

ROUND = 9
#: Query vectors in a block and blocks in one pass over the corpus; terms of queries up to which they are broadcast.
BLOCK, PASS_BLOCKS, BROADCAST_TERMS = 2048, 8, 200_000
#: Products of a block of queries and a batch of vectors that a task holds at once.
TILE = 1 << 20
#: Bytes up to which the smaller side of a join is broadcast.
BROADCAST_BYTES = 1 << 26
RRF_K, CANDIDATES, RETURNED = 60, 20, 5
BM25_K1, BM25_B = 1.5, 0.75


def top_k(scored: DataFrame, k: int, *, by: tuple = ("query_id",), tie: str = "id") -> DataFrame:
    """The k best rows of each group; Spark keeps k a task before it shuffles (WindowGroupLimit)."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def small(df: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """``df`` marked for broadcast if it has no more than ``most`` rows and BROADCAST_BYTES bytes; else the join is
    shuffled. Texts count by their characters, arrays by 16 bytes an element."""
    width = F.lit(0)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        width += F.coalesce(F.length(f.name), F.lit(0)) if kind in ("string", "binary") else F.coalesce(F.size(f.name) * 16, F.lit(0)) if kind in ("array", "map") else F.lit(16)
    rows, size = df.limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= most and size <= BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as there are cores, if its files give fewer (one row group is one task)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _unit_rows(vectors: list) -> np.ndarray:
    rows = np.stack(vectors).astype(np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / np.linalg.norm(rows, axis=1)[:, None]


def tiles(n: int, width: int) -> Iterator[slice]:
    """Slices of n rows, each of which makes TILE products with ``width`` others at most."""
    step = max(1, TILE // max(1, width))
    return (slice(at, at + step) for at in range(0, n, step))


def best_products(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of rows, and rounded products, of all that can be among a query's k best; ties are kept."""
    parts = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    for some in tiles(len(queries), len(rows)):
        found = queries[some] @ rows.T
        np.round(found, ROUND, out=found)
        found[np.isnan(found)] = -np.inf
        bar = np.partition(found, -k, axis=1)[:, -k] if len(rows) > k else np.full(len(found), -np.inf)
        q, at = np.nonzero((found >= bar[:, None]) & np.isfinite(found))
        parts.append((some.start + q, at, found[q, at]))
    q, at, found = (np.concatenate(x) for x in zip(*parts, strict=True))
    return q, at, found


def _block_scores(sent, k: int):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b.vector.notna()]
            if not len(b):
                continue
            rows = _unit_rows(b.vector.tolist())
            for ids, queries in sent.value:
                q, at, found = best_products(queries, rows, k)  # what isn't among a batch's k best isn't among all
                yield pd.DataFrame({"query_id": ids[q], "id": b.id.to_numpy()[at], "score": found})

    return score


def _query_passes(queries: DataFrame, make) -> Iterator:
    """Passes over the corpus: broadcasts of PASS_BLOCKS blocks of BLOCK queries; the driver holds one pass."""
    rows = queries.where("vector is not null").orderBy("query_id").toLocalIterator()
    while block := list(islice(rows, BLOCK * PASS_BLOCKS)):
        parts = [block[at : at + BLOCK] for at in range(0, len(block), BLOCK)]
        yield queries.sparkSession.sparkContext.broadcast([(np.array([r.query_id for r in p], dtype=np.int64), make([r.vector for r in p])) for p in parts])


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Exact cosine top-k. ``corpus`` is (id, vector), ``queries`` (query_id, vector), identifiers long.

    Zero and null vectors are never found. Each task multiplies a batch with blocks of query vectors and passes on
    its k best, so what is shuffled is k rows a query and batch. The corpus is read once for each pass of queries.
    """
    schema, parts = "query_id long, id long, score double", []
    for sent in _query_passes(queries, _unit_rows):
        part = top_k(corpus.select("id", "vector").mapInPandas(_block_scores(sent, k), schema), k)
        if len(parts) == 1:
            parts[0] = stored(parts[0])
        parts.append(stored(part) if parts else part)
    return reduce(DataFrame.unionByName, parts) if parts else corpus.sparkSession.createDataFrame([], schema + ", rank long")


def max_sim_by_group(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(grp, score): late interaction of the query vectors with each group's vectors (grp, vector): for each query
    vector its best dot product in the group, summed. Batches give their maxima, so no group is gathered."""
    schema, best = "grp long, query_id long, best double", None

    def scores(sent):
        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b = b[b.vector.notna() & b.grp.notna()]
                for grp, part in b.groupby("grp"):
                    rows = np.stack(part.vector.tolist()).astype(np.float64)
                    for ids, q in sent.value:
                        yield pd.DataFrame({"grp": int(grp), "query_id": ids, "best": (q @ rows.T).max(axis=1)})

        return score

    for sent in _query_passes(queries, lambda vs: np.stack(vs).astype(np.float64)):
        part = corpus.select("grp", "vector").mapInPandas(scores(sent), schema)
        best = part if best is None else best.unionByName(part)
    if best is None:
        return corpus.sparkSession.createDataFrame([], "grp long, score double")
    return best.groupBy("grp", "query_id").agg(F.max("best").alias("best")).groupBy("grp").agg(F.sum("best").alias("score"))


def postings(docs: DataFrame) -> DataFrame:
    """(id, n_tokens, term, tf) of ``docs`` (id, text)."""
    words = docs.select("id", tokens(F.col("text")).alias("words")).select("id", F.size("words").alias("n_tokens"), F.explode("words").alias("term"))
    return words.groupBy("id", "n_tokens", "term").agg(F.count(F.lit(1)).alias("tf"))


def _query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term"))


def bm25_topk(index: TextIndex, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Okapi BM25 for ``queries`` (query_id, text); repeated query words count each. Blocks of postings that can't
    enter the k best are skipped (``text_index.search``)."""
    wanted = _query_terms(queries).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    n_docs, avgdl = index.stats.select("n_docs", F.coalesce("avgdl", F.lit(1.0))).first()
    idf = F.ln(1.0 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = wanted.join(index.dictionary, "term").select("query_id", "term", (F.col("times") * idf).alias("weight"))

    def value(tf, length):
        return tf * (BM25_K1 + 1.0) / (tf + BM25_K1 * (1.0 - BM25_B + BM25_B * (length / (avgdl or 1.0))))

    return top_k(search(index, weights, k, value).withColumn("score", F.round("score", 6)), k)


def lexical_topk(index: TextIndex, queries: DataFrame, k: int = CANDIDATES, boost: float = 0.25) -> DataFrame:
    """The best of ``lexical_scores``: OR semantics."""
    wanted = _query_terms(queries).distinct().withColumn("weight", F.lit(1.0))
    if boost:
        numbers = queries.select("query_id", F.explode(numeric_terms(F.col("text"))).alias("number")).distinct()
        wanted = wanted.unionByName(numbers.select("query_id", F.concat(F.lit("#"), "number").alias("term"), F.lit(float(boost)).alias("weight")))

    def value(tf, length):
        return 1.0 + tf / (tf + 1.0) / 1000.0

    return top_k(search(index, wanted, k, value).withColumn("score", F.round("score", ROUND)), k)


def lexical_scores(index: TextIndex, queries: DataFrame, boost: float = 0.25, pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score): distinct query words found, plus their saturated frequency, plus ``boost`` if a number
    of the query occurs in the text. More words always rank higher. A query without a word finds nothing. With
    ``pairs`` (query_id, id) only these are scored; postings of other documents are dropped before they meet words."""
    wanted = _query_terms(queries).distinct()
    found = exploded(index.lists.join(small(wanted.select("term").distinct()), "term", "left_semi"))
    if pairs is not None:
        found = found.join(small(pairs.select("id").distinct()), "id", "left_semi")
    hits = found.join(small(wanted), "term")
    if pairs is not None:
        hits = hits.join(small(pairs.select("query_id", "id").distinct()), ["query_id", "id"], "left_semi")
    base = hits.groupBy("query_id", "id").agg((F.count(F.lit(1)) + F.sum(F.col("tf") / (F.col("tf") + 1.0)) / 1000.0).alias("base"))
    if not boost:
        return base.select("query_id", "id", F.round("base", ROUND).alias("score"))
    numbers = queries.select("query_id", F.explode(numeric_terms(F.col("text"))).alias("number")).distinct()
    having = index.numbers.join(small(numbers), "number").select("query_id", "id").distinct().withColumn("boosted", F.lit(boost))
    scored = base.join(having, ["query_id", "id"], "left")
    return scored.select("query_id", "id", F.round(F.col("base") + F.coalesce("boosted", F.lit(0.0)), ROUND).alias("score"))


def prune_weights(weights: Column, k: int) -> Column:
    """The k largest entries of a map of weights, ties to the smaller term; an array of (term, weight)."""
    entries = F.transform(F.map_entries(weights), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("term")))
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(e["term"].alias("term"), (-e["w"]).alias("weight")))


def sparse_topk(index: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Inner product of sparse vectors as postings (id, term, weight) and (query_id, term, weight); only > 0."""
    terms = small(queries.withColumnRenamed("weight", "query_weight"))
    scored = index.join(terms, "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * F.col("query_weight")), 6).alias("score"))
    return top_k(scored.where("score > 0"), k)


def fuse(legs: list[DataFrame], weights: list[float] | None = None, k: int = RETURNED, damping: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (damping + rank); ties to the first leg, then the better rank there.

    Adds first_leg and first_rank. What the legs scored isn't used.
    """
    weights = weights or [1.0] * len(legs)
    named = [leg.select("query_id", "id", F.lit(i).alias("leg"), "rank", F.lit(float(w)).alias("weight")) for i, (leg, w) in enumerate(zip(legs, weights, strict=True))]
    parts = reduce(DataFrame.unionByName, named)
    fused = parts.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") / (damping + F.col("rank"))), 9).alias("score"), F.min(F.struct("leg", F.col("rank").cast("long").alias("rank"))).alias("first"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "first.leg", "first.rank", "id")
    ranked = fused.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return ranked.select("query_id", "id", "score", "rank", F.col("first.leg").alias("first_leg"), F.col("first.rank").alias("first_rank"))


def rerank_by_overlap(hits: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Reorder hits by the share of query words in the text; scores stay as they are."""
    words = docs.select("id", F.array_distinct(tokens(F.col("text"))).alias("words"))
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("asked"))
    scored = hits.join(words, "id").join(small(asked), "query_id").withColumn("overlap", F.round(F.size(F.array_intersect("asked", "words")) / F.greatest(F.size("asked"), F.lit(1)), 9))
    order = W.partitionBy("query_id").orderBy(F.desc("overlap"), "rank")
    return scored.select("query_id", "id", "score", "overlap", F.row_number().over(order).cast("long").alias("rank"))


def gap_warning(dense: DataFrame, queries: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(query_id, best, gap_warning): no dense hit at the threshold; dense scores only, none counts as a gap."""
    best = dense.groupBy("query_id").agg(F.max("score").alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").withColumn("gap_warning", F.coalesce(F.col("best") < threshold, F.lit(True)))


def neighbours(hits: DataFrame, chunks: DataFrame, radius: int = 2, sources: int = 2, most: int = 8) -> DataFrame:
    """Chunks near a hit in its document, or the document's last; of the first ``sources`` documents of a query.

    ``hits`` (query_id, file, ord, rank) and ``chunks`` (file, ord). The hits are the small side: their wanted
    places are listed and joined by equality, so no range join runs. Returns query_id, file, ord, nth (from 1).
    """
    first = hits.groupBy("query_id", "file").agg(F.min("rank").alias("best"))
    kept = first.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("best", "file")).cast("long")).where(F.col("place") <= sources)
    chosen = hits.join(kept.select("query_id", "file", "place"), ["query_id", "file"])
    last = chunks.join(kept.select("file").distinct(), "file", "left_semi").groupBy("file").agg(F.max("ord").alias("ord"))
    near = chosen.select("query_id", "file", "place", F.explode(F.sequence(F.col("ord") - radius, F.col("ord") + radius)).alias("ord"))
    ends = kept.join(last, "file").select("query_id", "file", "place", "ord")
    found = near.unionByName(ends).distinct().join(chunks.select("file", "ord").distinct(), ["file", "ord"])
    order = W.partitionBy("query_id", "file").orderBy("ord")
    return found.withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= most).select("query_id", "file", "ord", "nth")


def interleave(hits: DataFrame, max_items: int = 5, max_documents: int = 2) -> DataFrame:
    """Round robin over the first documents of a query: items in document order, taken in turns."""
    first = W.partitionBy("query_id").orderBy("best", "file")
    docs = hits.groupBy("query_id", "file").agg(F.min("rank").alias("best")).withColumn("doc", F.row_number().over(first).cast("long")).where(F.col("doc") <= max_documents)
    turn = F.row_number().over(W.partitionBy("query_id", "file").orderBy("ord", "rank")).cast("long")
    taken = hits.join(docs.select("query_id", "file", "doc"), ["query_id", "file"]).withColumn("turn", turn)
    picked = taken.withColumn("pick", F.row_number().over(W.partitionBy("query_id").orderBy("turn", "doc")).cast("long")).where(F.col("pick") <= max_items)
    return picked.select("query_id", "file", "ord", F.row_number().over(W.partitionBy("query_id").orderBy("doc", "ord", "rank")).cast("long").alias("position"))


def collapse_near_copies(hits: DataFrame, threshold: float) -> DataFrame:
    """Greedy collapse of each query's ranking: a hit within ``threshold`` of a kept one is dropped, and takes its
    place if it is newer; an undated one never does. ``hits`` (query_id, rank, id, vector, created) has the
    candidates of a query only, so a group is bounded by the pool size."""

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        v = np.stack(pdf.vector.to_numpy()).astype(float)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        slots: list[int] = []
        for i in range(len(pdf)):
            at = next((s for s, j in enumerate(slots) if v[i] @ v[j] >= threshold), None)
            if at is None:
                slots.append(i)
                continue
            mine, other = pdf.created[i], pdf.created[slots[at]]
            if pd.notna(mine) and (pd.isna(other) or mine > other):
                slots[at] = i
        return pd.DataFrame({"query_id": pdf.query_id[slots].to_numpy(), "id": pdf.id[slots].to_numpy(), "position": range(1, len(slots) + 1)})

    return hits.groupBy("query_id").applyInPandas(greedy, "query_id long, id long, position long")
