"""Trusted search for batches of queries: legs, fusion, expansion, verdicts and evidence in one plan.

A pool is (query_id, id, pos): hits of a query in order, pos from 1. Chunks are (id, file, ord, ...).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.stats import confidence
from tidemark.functions.text import relational, safe_reference
from tidemark.functions.vectors import dot
from tidemark.operators.retrieval import RETURNED, RRF_K, fuse, small

#: Sources of a query that are expanded, and chunks of each; evidence items; documents of a bundle; width of a beam.
SOURCES, CHUNKS, ITEMS, DOCUMENTS, BEAM = 2, 3, 5, 2, 4
ORDERINGS = ("pool", "promoted_first", "inherit")


def cosines_of(pairs: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds score: the cosine of each (query_id, id) by unit vectors (id, vector) and (query_id, vector); 0 without
    either. Only vectors of the pairs are joined."""
    asked = queries.select("query_id", F.col("vector").alias("_q"))
    joined = pairs.join(corpus.select("id", F.col("vector").alias("_v")), "id", "left").join(small(asked), "query_id", "left")
    return joined.withColumn("score", F.coalesce(F.round(dot(F.col("_q"), F.col("_v")), 9), F.lit(0.0))).drop("_q", "_v")


def expand_documents(pool: DataFrame, chunks: DataFrame, queries: DataFrame, legs: list[DataFrame], sources: int = SOURCES, most: int = CHUNKS) -> DataFrame:
    """The pool, and behind it for queries that ask how things relate the best chunks of its first ``sources`` files.

    ``legs`` are scores (query_id, id, score) of every chunk that a leg can find; a file's chunks are ranked by each
    leg within the file and fused, as a search of that file alone does. Chunks that the pool has are not repeated.
    """
    asking = small(queries.where(relational(F.col("text"))).select("query_id"))
    files = pool.join(chunks.select("id", "file"), "id").join(asking, "query_id").groupBy("query_id", "file").agg(F.min("pos").alias("best"))
    chosen = files.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("best"))).where(F.col("place") <= sources)
    scope = chosen.join(chunks.select("id", "file"), "file").select("query_id", "file", "place", "id")
    ranked = []
    for leg in legs:
        order = W.partitionBy("query_id", "file").orderBy(F.desc("score"), "id")
        found = scope.join(leg.select("query_id", "id", "score"), ["query_id", "id"])
        ranked.append(found.withColumn("rank", F.row_number().over(order)))
    named = [r.select("query_id", "file", "place", "id", F.lit(i).alias("leg"), "rank") for i, r in enumerate(ranked)]
    parts = named[0]
    for n in named[1:]:
        parts = parts.unionByName(n)
    fused = parts.groupBy("query_id", "file", "place", "id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    order = W.partitionBy("query_id", "file").orderBy(F.desc("score"), "first.leg", "first.rank", "id")
    best = fused.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    fresh = best.join(pool.select("query_id", "id"), ["query_id", "id"], "left_anti")
    last = pool.groupBy("query_id").agg(F.max("pos").alias("last"))
    added = fresh.join(last, "query_id").withColumn("pos", F.col("last") + F.row_number().over(W.partitionBy("query_id").orderBy("place", "nth")))
    return pool.select("query_id", "id", "pos").unionByName(added.select("query_id", "id", "pos"))


def hybrid_pool(legs: list[DataFrame], k: int = RETURNED) -> DataFrame:
    """The fused legs (query_id, id, rank) as a pool of k."""
    return fuse(legs, k=k).select("query_id", "id", F.col("rank").alias("pos"))


def order_promoted(evaluated: DataFrame, ordering: str = "pool") -> DataFrame:
    """Adds final_pos: ok hits first, in pool order, or with files that superseded hits of the query name in front
    (promoted_first) or at the best place of those that name them (inherit); the rest as it is."""
    if ordering not in ORDERINGS:
        raise ValueError(f"ordering must be one of {', '.join(ORDERINGS)}")
    named = evaluated.where("superseded_by is not null").groupBy("query_id", F.col("superseded_by").alias("file")).agg(F.min("pos").alias("_named"))
    joined = evaluated.join(named, ["query_id", "file"], "left")
    ok = F.col("verdict") == "ok"
    own = {"pool": F.col("pos"), "promoted_first": F.when(F.col("_named").isNull(), 1).otherwise(0), "inherit": F.coalesce("_named", "pos")}[ordering]
    order = W.partitionBy("query_id").orderBy((~ok).cast("int"), F.when(ok, own).otherwise(F.col("pos")), "pos")
    return joined.withColumn("final_pos", F.row_number().over(order).cast("long")).drop("_named")


def demote_not_entailed(evaluated: DataFrame, entailed: Column) -> DataFrame:
    """ok hits for which the judge says no (false or null) become not_entailed; what is left of ok stays in front."""
    judged = evaluated.withColumn("verdict", F.when((F.col("verdict") == "ok") & ~F.coalesce(entailed, F.lit(False)), "not_entailed").otherwise(F.col("verdict")))
    order = W.partitionBy("query_id").orderBy((F.col("verdict") != "ok").cast("int"), "final_pos")
    return judged.withColumn("final_pos", F.row_number().over(order).cast("long"))


def degrade(evaluated: DataFrame) -> DataFrame:
    """Without any calibration no verdict was earned: every hit is unverified, and keeps its place in the pool."""
    return evaluated.withColumn("verdict", F.lit("unverified")).withColumn("final_pos", F.col("pos"))


def failure_code(status: Column, mismatch: Column, generation_id: Column) -> Column:
    """Why a search can't be trusted, or null: no generation before another lineage before the calibration's state."""
    named = F.when(mismatch, "LINEAGE_MISMATCH").when(status != "certified", F.concat(F.lit("CALIBRATION_"), F.upper(status)))
    return F.when(named.isNotNull() & generation_id.isNull(), "INDEX_NOT_READY").otherwise(named)


def marked_text(verdict: Column, superseded_by: Column, text: Column) -> Column:
    """The text of a hit, with a warning in front unless it is ok: a reader that sees only texts must see it."""
    by = F.when((verdict == "superseded") & superseded_by.isNotNull(), F.concat(F.lit(" by "), safe_reference(superseded_by))).otherwise("")
    unjudged = F.lit("[WARNING: this memory was not judged, as no certified calibration was at hand; do not rely on it.]\n")
    warned = F.concat(F.lit("[WARNING: this memory is "), verdict, by, F.lit(" and did not pass the trust layer; do not rely on it.]\n"))
    return F.when(verdict == "ok", text).when(verdict == "unverified", F.concat(unjudged, text)).otherwise(F.concat(warned, text))


def evidence(evaluated: DataFrame, queries: DataFrame, items: int = ITEMS, budget: int | None = None) -> DataFrame:
    """(query_id, items, decision, reason_code): the ids of the first ok hits in order, as far as their tokens fit.

    The bundle is a prefix: the first hit over the budget ends it. ``evaluated`` has final_pos and n_tokens.
    """
    ok = evaluated.where("verdict = 'ok'")
    order = W.partitionBy("query_id").orderBy("final_pos")
    placed = ok.withColumn("nth", F.row_number().over(order)).withColumn("used", F.sum("n_tokens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    fits = F.col("nth") <= items if budget is None else (F.col("nth") <= items) & (F.col("used") <= budget)
    # What is gathered is bounded by ``items``.
    bundles = placed.where(fits).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "id"))), lambda s: s["id"]).alias("items"))
    had = ok.select("query_id", F.lit(True).alias("had")).distinct()
    joined = queries.select("query_id").join(bundles, "query_id", "left").join(had, "query_id", "left")
    reason = F.when(F.col("items").isNotNull(), F.lit(None)).when(F.col("had"), "evidence_budget_exhausted").otherwise("no_trusted_evidence")
    return joined.select("query_id", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.when(F.col("items").isNull(), "abstain").otherwise("answer").alias("decision"), reason.alias("reason_code"))


def slot_matches(text: str, terms: list[str]) -> int:
    return sum(re.search(rf"(?<!\w){re.escape(t.strip().casefold())}(?!\w)", text.casefold()) is not None for t in terms)


#: What a bundle of hits is worth.
SLOT_WORTH, DOCUMENT_WORTH, COSINE_SHARE, IDLE_COST, PLACE_COST, TOO_MANY = 100.0, 0.25, 0.1, 3.0, 0.0001, -1_000_000.0


def best_bundle(covers: np.ndarray, documents: np.ndarray, quality: np.ndarray, items: int, most_documents: int, beam: int) -> np.ndarray:
    """The places of the best bundle of ``items`` hits or fewer; ``covers`` says which slots a hit covers.

    All bundles of a level are rows of a few arrays: which hits, slots and documents are in them, and what counts for
    and against them. A hit doubles the rows that have room, and the ``beam`` best stay.
    """
    taken, slots, docs = (np.zeros((1, n), dtype=bool) for n in (len(covers), covers.shape[1], len(covers)))
    sums = np.zeros((1, 3))  # quality, hits that cover nothing, places
    for i in range(len(covers)):
        room = taken.sum(axis=1) < items
        more = [x[room].copy() for x in (taken, slots, docs, sums)]
        more[0][:, i] = True
        more[1] |= covers[i]
        more[2][:, documents[i]] = True
        more[3] += (quality[i], not covers[i].any(), i)
        taken, slots, docs, sums = (np.concatenate(x) for x in zip((taken, slots, docs, sums), more, strict=True))
        spread = docs.sum(axis=1)
        worth = SLOT_WORTH * slots.sum(axis=1) + sums[:, 0] + DOCUMENT_WORTH * spread - IDLE_COST * sums[:, 1] - PLACE_COST * sums[:, 2]
        best = np.argsort(-np.where(spread > most_documents, TOO_MANY, worth), kind="stable")[:beam]
        taken, slots, docs, sums = (x[best] for x in (taken, slots, docs, sums))
    return np.flatnonzero(taken[0]) if slots[0].all() else np.zeros(0, dtype=np.int64)


def slot_evidence(hits: DataFrame, slots: dict[str, tuple[list[str], int]], items: int = ITEMS, documents: int = DOCUMENTS, mode: str = "greedy", beam: int = BEAM) -> DataFrame:
    """(query_id, position, id, missing): hits that cover answer slots, {name: (terms, least matches)}.

    greedy takes for each slot the hit with the most matches, confidence and cosine of a document that is taken or
    still fits; slots for which there is none are named in ``missing``, with commas, and a query without any hit has
    one row with nulls. beam keeps the best ``beam`` subsets by coverage, quality and diversity, and returns none if
    a slot is open. ``hits`` (query_id, id, file, text, score, confidence, final_pos) are the ok hits of a query: a
    group is bounded by the pool size.
    """
    wanted = list(slots.values())

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("final_pos", ignore_index=True)
        counts = np.array([[slot_matches(t or "", terms) for terms, _ in wanted] for t in pdf.text]).reshape(len(pdf), len(wanted))
        covers = counts >= np.array([least for _, least in wanted])
        files = pd.factorize(pdf.file)[0]
        if mode == "greedy":
            taken, missing = greedy(pdf, counts, covers, files)
        else:
            n = min(len(pdf), 4 * items)
            quality = (pdf.confidence + COSINE_SHARE * pdf.score).to_numpy()
            taken, missing = best_bundle(covers[:n], files[:n], quality[:n], items, documents, beam).tolist(), []
        rows = [(pdf.query_id.iloc[0], n + 1, pdf.id[i]) for n, i in enumerate(taken)] or [(pdf.query_id.iloc[0], None, None)] * bool(missing)
        return pd.DataFrame(rows, columns=["query_id", "position", "id"]).astype({"position": "Int64", "id": "Int64"}).assign(missing=",".join(missing))

    def greedy(pdf, counts, covers, files) -> tuple[list[int], list[str]]:
        taken, used, missing = [], set(), []
        for s, name in enumerate(slots):
            rows = pd.DataFrame({"n": -counts[:, s], "confidence": -pdf.confidence, "score": -pdf.score})[covers[:, s]].sort_values(["n", "confidence", "score"], kind="stable").index
            fitting = [i for i in rows if files[i] in used or len(used) < documents][:1]
            missing += [] if fitting else [name]
            used.update(files[fitting].tolist())
            taken += [i for i in fitting if i not in taken]
        return taken, missing

    return hits.groupBy("query_id").applyInPandas(pick, "query_id long, position long, id long, missing string")


def adaptive_depth(pool: DataFrame, queries: DataFrame, base: int, expanded: int, feature: str, threshold: float) -> DataFrame:
    """(query_id, value, depth): ``expanded`` where the feature is under the threshold: the best dense score, or the
    eighth; ``base`` where it isn't, or isn't there."""
    rule = {"max_dense_score": F.max("score"), "eighth_dense_score": F.max(F.when(F.col("pos") == 8, F.col("score")))}[feature]
    value = pool.groupBy("query_id").agg(rule.alias("value"))
    return queries.select("query_id").join(value, "query_id", "left").withColumn("depth", F.when(F.col("value") < threshold, expanded).otherwise(base))


def trusted_confidence(score: Column, threshold: float, scale: float) -> Column:
    return F.round(confidence(score, F.lit(threshold), F.lit(scale)), 6)


def bound(evaluated: DataFrame, bindings: DataFrame, model: str, dimension: int, strict: bool = False) -> DataFrame:
    """``evaluated`` hits (query_id, tenant_id, verdict, pos, final_pos, ...) as far as their tenant's state lets verdicts
    stand, with failure_code and trust_state.

    ``bindings`` is (tenant_id, generation_id, embedder_model, embedder_dimension, status), a row a tenant at most. A
    verdict needs a generation, made by the ``model`` and ``dimension`` that queries are embedded with, and a certified
    calibration of it. Without these a strict search has no hits; another gives them in the pool's order, unverified.
    """
    other = (F.col("embedder_model") != model) | (F.col("embedder_dimension") != dimension)
    joined = evaluated.join(bindings, "tenant_id", "left")
    code = failure_code(F.coalesce("status", F.lit("missing")), F.coalesce(other, F.lit(False)), F.col("generation_id"))
    judged = joined.withColumn("failure_code", code).withColumn("trust_state", F.when(code.isNull(), "trusted").otherwise("degraded"))
    if strict:
        return judged.where("failure_code is null")
    held = F.col("failure_code").isNull()
    return judged.withColumn("verdict", F.when(held, F.col("verdict")).otherwise("unverified")).withColumn("final_pos", F.when(held, F.col("final_pos")).otherwise(F.col("pos")))


def rerank(pool: DataFrame, scores: DataFrame) -> DataFrame:
    """``pool`` (query_id, id, pos, ...) in the order of a reranker's ``scores`` (query_id, id, rerank); hits that it
    didn't score stay behind those it did, in the order they had. What hits score otherwise doesn't change."""
    joined = pool.join(scores.select("query_id", "id", "rerank"), ["query_id", "id"], "left")
    order = W.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank"), "pos")  # a pool is bounded by its size
    return joined.withColumn("_pos", F.row_number().over(order).cast("long")).drop("pos", "rerank").withColumnRenamed("_pos", "pos")
