"""Arms side by side: text legs over documents, trust rules over memos, rings, tasks and snapshots over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import arms, calibration, evaluation, lifecycle, retrieval, search
from tidemark.plans.calibration import BASE as SAMPLED
from tidemark.plans.calibration import samples as calibrated
from tidemark.plans.evaluation import HALF, _metrics, _ranking, _supported
from tidemark.plans.lifecycle import NEW, OLD, _o, _sql
from tidemark.plans.retrieval import FUSE, LEX, TEXT, _docs, _legs, _legs_sql, _vector_queries, _vectors
from tidemark.plans.search import POOL, K, _hashed
from tidemark.plans.trust import EDGES, THRESHOLD, _evaluated, _verdict_sql
from tidemark.sources import tables
from tidemark.sources.shared import stored


def _stored_legs(spark, sf):
    return [stored(leg) for leg in _legs(spark, sf)]


def ablation_arms(spark, sf):
    """bm25, lexical and their fusion against documents that hold a rare word of the item."""
    legs = _stored_legs(spark, sf)
    found = arms.by_arm({"bm25": legs[0], "lexical": legs[1], "fused": retrieval.fuse(legs, k=20)}, stored(_supported(spark, sf).select("query_id", "id")), 10)
    return found.select("arm", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


def topologies_differ(spark, sf):
    """Whether flat and nested fusion return other documents, or only another order."""
    legs = _stored_legs(spark, sf)
    nested = retrieval.fuse([retrieval.fuse(legs, k=20), legs[1]], k=10)
    return evaluation.arms_differ(retrieval.fuse(legs, k=10), nested)


def added_gold(spark, sf):
    legs = _stored_legs(spark, sf)
    rel = stored(_supported(spark, sf).select("query_id", "id"))
    return arms.added_gold(retrieval.fuse(legs, k=20), legs[0].where("rank <= 5"), rel)


def document_recall(spark, sf):
    rel = stored(_supported(spark, sf).select("query_id", "id"))
    file_of = _docs(spark, sf).select("id", F.expr("id div 3").alias("file"))
    return arms.document_recall(_legs(spark, sf)[0], rel, file_of, 10)


def ring_sets(spark, sf):
    """Documents that each ring takes away: an item's first hit and its 0, 2 or 5 next neighbours."""
    leg = stored(_legs(spark, sf)[0])
    return arms.rings(leg, leg.where("rank = 1").select("query_id", "id"), [0, 2, 5])


def fractional_rings(spark, sf):
    """Shares of each item's twenty hits that go with its first one: the next ones, or drawn ones."""
    leg = stored(_legs(spark, sf)[0])
    gold, shares = leg.where("rank = 1").select("query_id", "id"), [0.0, 0.25, 0.5, 0.75, 1.0]
    both = {"bm25": arms.fractional_rings(leg, gold, shares), "random": arms.fractional_rings(leg, gold, shares, "ring-1")}
    return both["bm25"].withColumn("kind", F.lit("bm25")).unionByName(both["random"].withColumn("kind", F.lit("random")))


def gold_and_negatives(spark, sf):
    rel = _supported(spark, sf).select("query_id", "id")
    return arms.with_negatives(rel, _docs(spark, sf), 100, "neg-1")


def embedding_disagreement(spark, sf):
    """The first ten by all dimensions and by half of them."""
    cut = F.slice("vector", 1, HALF).alias("vector")
    half = retrieval.dense_topk(_vectors(spark, sf).select("id", cut), _vector_queries(spark, sf).select("query_id", cut), 21).where("id <> query_id")
    return arms.disagreement(_ranking(spark, sf), retrieval.top_k(half.select("query_id", "id", "score"), 20), 10)


def stale_trust(spark, sf):
    got = arms.stale_trust(_evaluated(spark, sf), THRESHOLD)
    return got.select("n", *[F.round(c, 6).alias(c) for c in ("plain", "recency", "trusted", "coverage")])


def near_miss_arms(spark, sf):
    """Users stand for queries; their number modulo 3 says answerable, gap or near miss."""
    judged = _evaluated(spark, sf).withColumn("kind", F.col("query_id") % 3)
    entailed = F.conv(F.substring(F.md5("file"), 1, 2), 16, 10).cast("int") % 5 == 0
    return arms.confident_by_arm(judged, entailed, "kind").withColumn("rate", F.round("rate", 6))


KINDS = """SELECT s.id, CASE WHEN s.id % 4 = 3 THEN 'near_miss' WHEN s.label THEN 'answerable' ELSE 'gap' END AS kind, s.score, coalesce(l.quality = 1, false) AS entailed FROM s JOIN {labels} l ON l.doc_id = s.id"""


def near_misses(spark, sf):
    """Labelled documents as queries: a quarter are near misses that no threshold is fitted to; quality judges."""
    labels = tables.table(spark, sf, "labels")
    rows = spark.sql(f"WITH s AS (SELECT * FROM {{samples}} WHERE score IS NOT NULL) {KINDS}", samples=calibrated(spark, sf), labels=labels)
    got = arms.near_misses(rows.select("kind", "score", "entailed"))
    return got.select("arm", *[F.round(c, 6).alias(c) for c in ("near_miss_fcr", "gap_fcr", "false_abstain")])


def labelled_arms(spark, sf):
    """bm25, sparse, dense and hybrid on the held half of the items, against documents that hold a rare word of them."""
    bm25, sparse = _stored_legs(spark, sf)
    docs, asked = _hashed(spark, sf)
    dense = stored(retrieval.dense_topk(docs, asked, 20))
    hybrid = search.hybrid_pool([dense, sparse], K).withColumnRenamed("pos", "rank")
    found = arms.held_out_arms({"bm25": bm25, "sparse": sparse, "dense": dense, "hybrid": hybrid}, stored(_supported(spark, sf).select("query_id", "id")), asked.select("query_id"), 5)
    return found.select("arm", "n", *[F.round(c, 6).alias(c) for c in ("hit_rate", "mrr")])


def task_deltas(spark, sf):
    runs = _sql(spark, sf, "SELECT user_id AS task, CASE WHEN event_id % 2 = 0 OR user_id % 11 = 3 THEN 'off' ELSE 'on' END AS arm, event_id % 5 < 2 AS passed FROM {events}")
    got = arms.task_deltas(runs)
    return got.select("task", *[F.round(c, 6).alias(c) for c in ("off", "on", "delta")], "change")


def admitted_sessions(spark, sf):
    rows = _sql(spark, sf, "SELECT event_id, event_id DIV 4 AS task, CASE WHEN event_id % 2 = 0 OR event_id DIV 4 % 7 = 2 THEN 'off' ELSE 'on' END AS arm, event_id % 13 <> 5 AS ok FROM {events}")
    return arms.admitted(rows).select("event_id", "task", "arm")


def ladder_costs(spark, sf):
    rows = _sql(spark, sf, "SELECT event_type, event_id % 3 <> 0 AS answerable, event_id % 7 < 3 AS abstained FROM {events}")
    return arms.ladder_costs(rows, "event_type", [1.0, 2.0, 5.0]).withColumn("correct_abstain", F.round("correct_abstain", 6))


def latency_windows(spark, sf):
    return arms.latency_windows(tables.table(spark, sf, "events").where("value is not null"), "event_type", "event_id", "value")


def corpus_census(spark, sf):
    """Addresses whose stored digest is, isn't, or has no counterpart on disk."""
    return lifecycle.manifest_diff(_sql(spark, sf, OLD), _sql(spark, sf, NEW)).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def snapshot_drift(spark, sf):
    """Each snapshot of a corpus against the first: its delta and what that asks for."""
    base = _sql(spark, sf, OLD).select("uri", "sha256")
    parts = []
    for k in (0, 100, 20, 3):
        changed = base if not k else base.withColumn("sha256", F.when(F.substring("uri", 3, 20).cast("long") % k == 0, "new").otherwise(F.col("sha256")))
        parts.append(lifecycle.corpus_delta(base, changed).select(F.lit(k).alias("snapshot"), "delta"))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rows.select("snapshot", F.round("delta", 6).alias("delta"), calibration.drift_verdict(F.col("delta"), F.lit(True), F.lit(False), F.lit(False)).alias("verdict"))


def predictor_correlations(spark, sf):
    """Two predictors of a document's length share, by rank."""
    rows = tables.table(spark, sf, "documents").where("text is not null and n_chars > 0").selectExpr("n_chars as gap", "doc_id % 101 + n_chars div 500 as volume", "doc_id % 37 as noise")
    parts = [evaluation.spearman(rows, c, "gap").select(F.lit(c).alias("predictor"), "n", F.round("rho", 6).alias("rho")) for c in ("volume", "noise")]
    return parts[0].unionByName(parts[1])


QUERIES = {f.__name__: f for f in (
    ablation_arms, topologies_differ, added_gold, document_recall, ring_sets, fractional_rings, gold_and_negatives, embedding_disagreement, stale_trust, near_miss_arms, near_misses, labelled_arms, task_deltas,
    admitted_sessions, ladder_costs, latency_windows, corpus_census, snapshot_drift, predictor_correlations,
)}

REL = f"t AS (SELECT DISTINCT query_id, term FROM qterms), dt AS (SELECT DISTINCT id, unnest(words) AS term FROM docs), rare AS (SELECT term FROM dt GROUP BY 1 HAVING count(*) <= 0.02 * (SELECT count(*) FROM docs)), rel AS (SELECT DISTINCT query_id, id FROM dt JOIN rare USING (term) JOIN t USING (term))"
FLAT = FUSE.format(legs=_legs_sql("bm25", "lex", 1, 1), k=20)
NESTED = f"inner_fused AS ({FLAT}), nested AS ({FUSE.format(legs=_legs_sql('inner_fused', 'lex', 1, 1), k=10)})"
HALVES = f"""p AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS a, round(list_cosine_similarity(c.embedding[1:{HALF}]::DOUBLE[], q.embedding[1:{HALF}]::DOUBLE[]), 9) AS b FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
 r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, id) AS x, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, id) AS y FROM p)"""
ORACLES = {k: _o(v) for k, v in {
    "ablation_arms": f"WITH {TEXT} {LEX}, {REL}, fu AS ({FLAT}) SELECT arm, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM (SELECT 'bm25' AS arm, * FROM ({_metrics('bm25')}) UNION ALL SELECT 'lexical', * FROM ({_metrics('lex')}) UNION ALL SELECT 'fused', * FROM ({_metrics('fu')})) GROUP BY 1",
    "topologies_differ": f"""WITH {TEXT} {LEX}, {NESTED}, a AS (SELECT query_id, list(id ORDER BY rank) AS x FROM inner_fused WHERE rank <= 10 GROUP BY 1), b AS (SELECT query_id, list(id ORDER BY rank) AS y FROM nested GROUP BY 1)
        SELECT query_id, CASE WHEN coalesce(x, []) = coalesce(y, []) THEN 'IDENTICAL' WHEN list_sort(coalesce(x, [])) = list_sort(coalesce(y, [])) THEN 'SET_IDENTICAL' ELSE 'DIFFERS' END AS verdict FROM a FULL JOIN b USING (query_id)""",
    "added_gold": f"""WITH {TEXT} {LEX}, {REL}, fu AS ({FLAT}), g AS (SELECT f.query_id, f.rank - 1 AS place FROM fu f JOIN rel USING (query_id, id) WHERE (f.query_id, f.id) NOT IN (SELECT query_id, id FROM bm25 WHERE rank <= 5)), o AS (SELECT *, row_number() OVER (ORDER BY place) - 1 AS i, count(*) OVER () AS n FROM g)
        SELECT count(DISTINCT query_id) AS queries, count(*) AS documents, count(*) FILTER (place < 5) AS top5, count(*) FILTER (place < 10) AS top10, count(*) FILTER (place >= 10) AS buried, max(place) FILTER (i = n // 4) AS q1, max(place) FILTER (i = n // 2) AS median, max(place) FILTER (i = 3 * n // 4) AS q3 FROM o""",
    "document_recall": f"""WITH {TEXT} {LEX}, {REL}, w AS (SELECT DISTINCT query_id, id // 3 AS file FROM rel), g AS (SELECT DISTINCT query_id, id // 3 AS file FROM bm25 WHERE rank <= 10)
        SELECT w.query_id, count(*) AS n_files, count(g.file) AS found, count(*) = count(g.file) AS exact FROM w LEFT JOIN g ON g.query_id = w.query_id AND g.file = w.file GROUP BY 1""",
    "ring_sets": f"""WITH {TEXT} {LEX}, w AS (SELECT unnest([0, 1, 2])::INT AS ring, unnest([0, 2, 5]) AS width) SELECT query_id, ring, id FROM bm25, w WHERE rank <= width + 1""",
    "fractional_rings": f"""WITH {TEXT} {LEX}, o AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS a, row_number() OVER (PARTITION BY query_id ORDER BY md5('ring-1|' || query_id || '|' || id), id) AS b, count(*) OVER (PARTITION BY query_id) AS n FROM bm25 WHERE rank > 1),
        f AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS f) SELECT query_id, (f * 10000)::INT AS ring, id, 'bm25' AS kind FROM o, f WHERE a <= round_even(f * n, 0) UNION ALL SELECT query_id, (f * 10000)::INT, id, 'random' FROM o, f WHERE b <= round_even(f * n, 0)
        UNION ALL SELECT query_id, (f * 10000)::INT, id, k FROM bm25, f, (SELECT unnest(['bm25', 'random']) AS k) WHERE rank = 1""",
    "gold_and_negatives": f"""WITH {TEXT} {LEX}, {REL}, g AS (SELECT DISTINCT id FROM rel) SELECT id, true AS gold FROM g UNION ALL SELECT id, false FROM (SELECT id FROM docs WHERE id NOT IN (FROM g) ORDER BY md5('neg-1|' || id), id LIMIT 100)""",
    "embedding_disagreement": f"WITH {HALVES} SELECT query_id, bool_and(x = y) AS same_order, count(*) FILTER ((x > 10) <> (y > 10)) AS n_other FROM r WHERE x <= 10 OR y <= 10 GROUP BY 1",
    "stale_trust": _verdict_sql(EDGES, None) + f"""SELECT count(*) AS n, round(avg(plain::INT), 6) AS plain, round(avg(coalesce(newest, plain)::INT), 6) AS recency, round(avg(trusted::INT), 6) AS trusted, round(avg(covered::INT), 6) AS coverage FROM (
        SELECT query_id, arg_min(superseded_by IS NOT NULL, f.pos) AS plain, first(superseded_by IS NOT NULL ORDER BY h.indexed_at DESC, f.pos) FILTER (f.score >= {THRESHOLD}) AS newest, bool_or(superseded_by IS NOT NULL AND verdict = 'ok') AS trusted, bool_or(verdict = 'ok') AS covered FROM final f JOIN (SELECT query_id, file, indexed_at FROM placed) h USING (query_id, file) GROUP BY 1)""",
    "near_miss_arms": _verdict_sql(EDGES, None) + """SELECT kind, arm, count(*) AS n, round(avg(yes::INT), 6) AS rate FROM (SELECT query_id % 3 AS kind, query_id, unnest(['threshold', 'threshold+entail', 'entail-only']) AS arm, unnest([bool_or(verdict = 'ok'), bool_or(verdict = 'ok' AND e), bool_or(verdict IN ('ok', 'low_confidence') AND e)]) AS yes FROM (SELECT *, ('0x' || left(md5(file), 2))::INT % 5 = 0 AS e FROM final) GROUP BY query_id) GROUP BY 1, 2""",
    "near_misses": f"""WITH {SAMPLED}, q AS ({KINDS.format(labels='labels')}), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score, id) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM q WHERE kind <> 'near_miss'),
        w AS (SELECT max(score) FILTER (kind = 'answerable' AND i = least(n - 1, floor(0.05 * n))) AS f, max(score) FILTER (kind = 'gap' AND i = least(n - 1, floor(0.95 * n))) AS c FROM r),
        p AS (SELECT *, least(n - 2, floor(CASE kind WHEN 'gap' THEN 0.95 ELSE 0.05 END * (n - 1))) AS p FROM r), o AS (SELECT x.*, (SELECT score FROM r y WHERE y.kind = x.kind AND y.i = x.p + (x.i <= x.p)::INT) AS own FROM p x),
        t AS (SELECT kind, score, entailed, floor((CASE kind WHEN 'gap' THEN w.f + own ELSE own + w.c END) / 2 * 1000) / 1000 AS cut FROM o, w UNION ALL SELECT kind, score, entailed, floor((f + c) / 2 * 1000) / 1000 FROM q, w WHERE kind = 'near_miss'),
        a AS (SELECT kind, unnest(['threshold', 'threshold+entail', 'entail-only']) AS arm, unnest([score >= cut, score >= cut AND entailed, entailed]) AS yes FROM t)
        SELECT arm, round(avg(yes::INT) FILTER (kind = 'near_miss'), 6) AS near_miss_fcr, round(avg(yes::INT) FILTER (kind = 'gap'), 6) AS gap_fcr, round(avg((NOT yes)::INT) FILTER (kind = 'answerable'), 6) AS false_abstain FROM a GROUP BY 1""",
    "labelled_arms": f"""WITH {POOL}, {REL}, k AS (SELECT 'bm25' AS arm, query_id, id, rank FROM bm25 UNION ALL SELECT 'sparse', query_id, id, rank FROM lex UNION ALL SELECT 'dense', query_id, id, rank FROM dense UNION ALL SELECT 'hybrid', query_id, id, pos FROM pool),
        h AS (SELECT query_id FROM (SELECT item_id AS query_id, row_number() OVER (ORDER BY item_id) AS n FROM (SELECT DISTINCT item_id FROM benchmark)) WHERE n % 2 = 0 AND query_id IN (SELECT query_id FROM rel)), f AS (SELECT arm, query_id, min(rank) AS first FROM k JOIN rel USING (query_id, id) GROUP BY 1, 2)
        SELECT arm, count(*) AS n, round(avg(coalesce(first <= 5, false)::INT), 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM (SELECT arm, query_id FROM (SELECT DISTINCT arm FROM k), h) LEFT JOIN f USING (arm, query_id) GROUP BY 1""",
    "task_deltas": """WITH r AS (SELECT user_id AS task, event_id % 2 = 0 OR user_id % 11 = 3 AS off, (event_id % 5 < 2)::INT AS p FROM events), a AS (SELECT task, avg(p) FILTER (off) AS o, avg(p) FILTER (NOT off) AS n FROM r GROUP BY 1)
        SELECT task, round(o, 6) AS off, round(n, 6) AS "on", round(n - o, 6) AS delta, CASE WHEN n > o THEN 'improved' WHEN n < o THEN 'worsened' ELSE 'same' END AS change FROM a WHERE o IS NOT NULL AND n IS NOT NULL""",
    "admitted_sessions": """WITH s AS (SELECT event_id, event_id // 4 AS task, CASE WHEN event_id % 2 = 0 OR event_id // 4 % 7 = 2 THEN 'off' ELSE 'on' END AS arm, event_id % 13 <> 5 AS ok FROM events) SELECT event_id, task, arm FROM s WHERE task IN (SELECT task FROM s GROUP BY 1 HAVING count(DISTINCT arm) = 2 AND bool_and(ok))""",
    "ladder_costs": """WITH c AS (SELECT event_type, count(*) FILTER (event_id % 3 = 0 AND event_id % 7 < 3) AS ca, count(*) FILTER (event_id % 3 = 0 AND event_id % 7 >= 3) AS fa, count(*) FILTER (event_id % 3 <> 0 AND event_id % 7 < 3) AS fb FROM events GROUP BY 1)
        SELECT event_type, weight, round(ca::DOUBLE / (ca + fa), 6) AS correct_abstain, weight * fa + fb AS cost FROM c, (SELECT unnest([1.0, 2.0, 5.0]::DOUBLE[]) AS weight)""",
    "latency_windows": """WITH l AS (SELECT event_type, value FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 1024), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM l)
        SELECT event_type, max(n) AS n, max(value) FILTER (i = ceil(0.5::DOUBLE * n)) AS p50, max(value) FILTER (i = ceil(0.95::DOUBLE * n)) AS p95, max(value) FILTER (i = ceil(0.99::DOUBLE * n)) AS p99 FROM r GROUP BY 1""",
    "corpus_census": "SELECT change, count(*) AS n FROM (SELECT CASE WHEN a.uri IS NULL THEN 'added' WHEN b.uri IS NULL THEN 'removed' WHEN a.sha256 <> b.sha256 THEN 'modified' ELSE 'same' END AS change FROM <OLD> a FULL JOIN <NEW> b ON a.uri = b.uri) GROUP BY 1",
    "snapshot_drift": """WITH b AS (SELECT substring(uri, 3)::BIGINT AS i FROM <OLD>), k AS (SELECT unnest([0, 100, 20, 3])::INT AS k), d AS (SELECT k, avg((k > 0 AND i % greatest(k, 1) = 0)::INT) AS delta FROM b, k GROUP BY 1)
        SELECT k AS snapshot, round(delta, 6) AS delta, CASE WHEN delta < 0.05 THEN 'stable' ELSE 'recalibration_recommended' END AS verdict FROM d""",
    "predictor_correlations": """WITH d AS (SELECT n_chars AS g, doc_id % 101 + n_chars // 500 AS v, doc_id % 37 AS o FROM documents WHERE text IS NOT NULL AND n_chars > 0), r AS (SELECT rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2.0::DOUBLE AS g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS v, rank() OVER (ORDER BY o) + (count(*) OVER (PARTITION BY o) - 1) / 2.0::DOUBLE AS o FROM d)
        SELECT 'volume' AS predictor, count(*) AS n, round(corr(v, g), 6) AS rho FROM r UNION ALL SELECT 'noise', count(*), round(corr(o, g), 6) FROM r""",
}.items()}
