"""Trusted search over documents: benchmark items ask, three documents make a file, files supersede and expire."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import text as T
from tidemark.functions import vectors as V
from tidemark.operators import retrieval, search, trust
from tidemark.plans.governance import BUILT, calibration_statuses
from tidemark.plans.governance import ORACLES as GOVERNED
from tidemark.plans.lifecycle import _sql
from tidemark.plans.retrieval import LEX, TEXT, TOKENS, _asked, _docs, _legs, _vector_queries, _vectors, text_index
from tidemark.plans.trust import _evaluated, _verdict_sql, EDGES
from tidemark.sources import tables
from tidemark.sources.shared import stored

NOW, THRESHOLD, SCALE, K = "2024-06-01 00:00:00", 0.6, 0.05, 10
CHUNKS = """SELECT doc_id AS id, 'f' || CAST(doc_id DIV 3 AS STRING) || '.md' AS file, doc_id % 3 AS ord, CASE WHEN (doc_id DIV 3) % 4 = 1 THEN '[[f' || CAST(doc_id DIV 3 - 1 AS STRING) || ']]' ELSE NULL END AS supersedes,
 CAST(NULL AS STRING) AS valid_from, CASE WHEN (doc_id DIV 3) % 11 = 5 THEN '2024-01-31' ELSE NULL END AS valid_until, TIMESTAMP '2024-03-01 00:00:00' AS indexed_at, CAST(NULL AS TIMESTAMP) AS first_indexed FROM {documents}"""


def _chunks(spark, sf):
    return spark.sql(CHUNKS, documents=tables.table(spark, sf, "documents").select("doc_id"))


def _hashed(spark, sf):
    docs = stored(V.hashed_vectors(_docs(spark, sf), "id").select("id", F.col("embedding").alias("vector")))
    asked = V.hashed_vectors(_asked(spark, sf), "query_id").select("query_id", F.col("embedding").alias("vector"))
    return docs, asked


def _pool(spark, sf):
    """Ten fused hits of the dense and the lexical leg, and the vectors that their scores come from."""
    docs, asked = _hashed(spark, sf)
    dense = retrieval.dense_topk(docs, asked, 20)
    lexical = retrieval.lexical_topk(text_index(spark, sf), _asked(spark, sf), 20, boost=0.0)
    return stored(search.hybrid_pool([dense, lexical], K)), docs, asked  # K rows a query; what follows rereads them


def hybrid_search(spark, sf):
    """The fused pool, each hit with its dense cosine."""
    pool, docs, asked = _pool(spark, sf)
    return search.cosines_of(pool, docs, asked).select("query_id", "id", "pos", F.round("score", 6).alias("score"))


def relational_queries(spark, sf):
    """Which conversation turns ask how things relate."""
    return tables.table(spark, sf, "conversations").select("conv_id", "turn", T.relational(F.col("text")).alias("relational"))


def _expanded(spark, sf):
    pool, docs, asked = _pool(spark, sf)
    chunks, queries = _chunks(spark, sf), _asked(spark, sf)
    files = pool.join(chunks.select("id", "file"), "id").select("query_id", "file").distinct()
    scope = stored(files.join(chunks.select("file", "id"), "file").select("query_id", "id"))  # chunks of a pool's files
    lexical = retrieval.lexical_scores(text_index(spark, sf), queries, 0.0, scope)
    near = search.cosines_of(scope, docs, asked)
    return search.expand_documents(pool, chunks, queries, [near, lexical]), docs, asked, chunks


def document_expansion(spark, sf):
    """The pool with the best chunks of its first two files, for queries that ask how things relate."""
    return _expanded(spark, sf)[0]


def _trusted(spark, sf):
    pool, docs, asked, chunks = _expanded(spark, sf)
    chain = trust.successors(trust.edges(chunks.select("file", "supersedes", "first_indexed")))
    hits = search.cosines_of(pool, docs, asked).join(chunks, "id")
    unresolved = trust.ambiguous_files(chunks.select("file", "supersedes"))
    return trust.evaluate(hits, chain, unresolved, now=NOW, threshold=THRESHOLD, scale=SCALE)


def trusted_search(spark, sf):
    """Legs, fusion, expansion, supersession, verdicts, promotion and order, in one plan."""
    return _trusted(spark, sf).select("query_id", "id", "pos", F.round("score", 6).alias("score"), "verdict", "superseded_by", F.round("confidence", 6).alias("confidence"), "final_pos")


def trusted_evidence(spark, sf):
    """The citable bundle of each item: five ok hits in order, 400 tokens at most, or why there are none."""
    sizes = _docs(spark, sf).select("id", F.size(T.tokens(F.col("text"))).alias("n_tokens"))
    found = search.evidence(_trusted(spark, sf).join(sizes, "id"), _asked(spark, sf), budget=400)
    return found.select("query_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "decision", "reason_code")


def promoted_orders(spark, sf):
    """The other two orders of ok hits: named successors first, or at the place of what they supersede."""
    judged = _evaluated(spark, sf)
    orders = [search.order_promoted(judged, o).select("query_id", "file", "final_pos", F.lit(o).alias("ordering")) for o in ("promoted_first", "inherit")]
    return orders[0].unionByName(orders[1])


def entailed_hits(spark, sf):
    """ok hits that a judge rejects are demoted: the judge here is a rule on the file's digest."""
    judged = search.demote_not_entailed(_evaluated(spark, sf), F.conv(F.substring(F.md5("file"), 1, 2), 16, 10).cast("int") % 3 != 0)
    return judged.select("query_id", "file", "verdict", "final_pos")


def servable_hits(spark, sf):
    return trust.servable(_evaluated(spark, sf)).select("query_id", "file", "final_pos")


def merged_rounds(spark, sf):
    """Two rounds of hits of each user: every memo once, from the first round that has it."""
    rows = _evaluated(spark, sf).select("query_id", "id", F.col("pos").alias("rank"), "verdict")
    late = rows.withColumn("rank", F.col("rank") + 1)
    return trust.union_first([rows.where("rank <= 4"), late.where("rank <= 8")]).select("query_id", "id", "rank", F.col("round").cast("long").alias("round"))


def marked_texts(spark, sf):
    """What a reader of texts alone sees of each hit."""
    judged = _evaluated(spark, sf)
    return judged.select("query_id", "file", F.md5(search.marked_text(F.col("verdict"), F.col("superseded_by"), F.col("file"))).alias("marked_md5"))


def safe_references(spark, sf):
    """Document openings as if they were names from a corpus."""
    return tables.table(spark, sf, "documents").select("doc_id", T.safe_reference(F.col("text")).alias("reference"))


def refusal_codes(spark, sf):
    rows = tables.table(spark, sf, "events").selectExpr("event_id % 5 as s", "event_id % 7 = 0 as mismatch", "case when event_id % 11 = 0 then null else event_id end as generation_id")
    status = F.element_at(F.array(*map(F.lit, ("certified", "uncertified", "draft", "stale", "missing"))), (F.col("s") + 1).cast("int"))
    return rows.groupBy(search.failure_code(status, F.col("mismatch"), F.col("generation_id")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def adaptive_depths(spark, sf):
    hits = retrieval.dense_topk(_vectors(spark, sf), _vector_queries(spark, sf), 10).withColumnRenamed("rank", "pos")
    asked = _vector_queries(spark, sf)
    parts = [search.adaptive_depth(hits, asked, 5, 20, f, t).withColumn("feature", F.lit(f)) for f, t in (("max_dense_score", 1.5), ("eighth_dense_score", 0.3))]
    return parts[0].unionByName(parts[1]).select("query_id", "feature", F.round("value", 6).alias("value"), "depth")


#: The model that queries are embedded with; generations of pipeline 2 were made by another.
MODEL, DIMENSION = "hashing-64", 64


def bound_verdicts(spark, sf):
    """Verdicts of every hit as far as its tenant's newest generation has a certified calibration and the same model."""
    rows = calibration_statuses(spark, sf)
    newest = _sql(spark, sf, BUILT).groupBy("tenant_id").agg(F.max("generation_id").alias("generation_id"), F.max_by("pipeline", "generation_id").alias("pipeline"))
    model = F.when(F.col("pipeline") == 2, "other-64").otherwise(MODEL)
    bindings = newest.join(rows, ["tenant_id", "generation_id"], "left").select("tenant_id", "generation_id", model.alias("embedder_model"), F.lit(DIMENSION).alias("embedder_dimension"), "status")
    judged = _evaluated(spark, sf).withColumn("tenant_id", F.col("query_id") % 220)
    return search.bound(judged, bindings, MODEL, DIMENSION).select("query_id", "file", "verdict", "final_pos", "trust_state", "failure_code")


def reranked_pool(spark, sf):
    """The fused pool in the order of shared query words; every fourth hit is left as it was, behind."""
    pool, _, _ = _pool(spark, sf)
    docs, asked = _docs(spark, sf), _asked(spark, sf)
    scores = retrieval.rerank_by_overlap(pool.where("pos % 4 <> 0").withColumn("score", F.lit(0.0)).withColumn("rank", F.col("pos")), docs, asked)
    return search.rerank(pool, scores.withColumnRenamed("overlap", "rerank")).select("query_id", "id", "pos")


SLOTS = {"first": (["the", "of"], 1), "second": (["and", "in"], 1)}


def _slot_hits(spark, sf):
    hits = _pool(spark, sf)
    scored = search.cosines_of(*hits).join(_chunks(spark, sf).select("id", "file"), "id").join(_docs(spark, sf), "id")
    return scored.withColumn("confidence", search.trusted_confidence(F.col("score"), THRESHOLD, SCALE)).withColumn("final_pos", F.col("pos"))


def slot_evidence(spark, sf):
    return search.slot_evidence(_slot_hits(spark, sf), SLOTS)


def beam_evidence(spark, sf):
    return search.slot_evidence(_slot_hits(spark, sf), SLOTS, mode="beam")


def near_copies_collapsed(spark, sf):
    """Each query vector's ranking without near copies: the newer of two stays, in the older one's place."""
    dated = _vectors(spark, sf).select("id", "vector", F.when(F.col("id") % 7 != 0, F.col("id") * 37 % 1000).alias("created"))
    hits = retrieval.dense_topk(_vectors(spark, sf), _vector_queries(spark, sf), 20).join(dated, "id")
    return retrieval.collapse_near_copies(hits, 0.5)


QUERIES = {f.__name__: f for f in (
    hybrid_search, relational_queries, document_expansion, trusted_search, trusted_evidence, promoted_orders, entailed_hits, servable_hits, merged_rounds, marked_texts,
    safe_references, refusal_codes, adaptive_depths, slot_evidence, beam_evidence, near_copies_collapsed, bound_verdicts, reranked_pool,
)}

RELATIONAL = T.RELATIONAL_QUERY.replace("'", "''")
CHUNKS_SQL = CHUNKS.replace("doc_id DIV 3", "doc_id // 3").format(documents="documents")
POOL = f"""{TEXT} {LEX},
hb AS (SELECT src, id, ('0x' || right(md5(t), 2))::INT % 64 AS bucket, count(*)::DOUBLE AS n FROM (
    SELECT 'd' AS src, id, unnest(words) AS t FROM docs UNION ALL SELECT 'q', query_id, term FROM qterms) GROUP BY ALL),
hv AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY src, id)) AS x FROM hb),
cosines AS (SELECT q.id AS query_id, d.id, round(sum(q.x * d.x), 9) AS score FROM hv q JOIN hv d ON q.bucket = d.bucket AND q.src = 'q' AND d.src = 'd' GROUP BY ALL),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cosines QUALIFY rank <= 20),
both_legs AS (SELECT query_id, id, 0 AS leg, rank FROM dense UNION ALL SELECT query_id, id, 1, rank FROM lex),
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS s, min(leg * 1000 + rank) AS first FROM both_legs GROUP BY ALL),
pool AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, first, id) AS pos FROM fused QUALIFY pos <= {K})"""
EXPANDED = rf"""{POOL}, chunks AS ({CHUNKS_SQL}),
asking AS (SELECT item_id AS query_id FROM benchmark WHERE regexp_matches(coalesce(text, ''), '{RELATIONAL}')),
files AS (SELECT query_id, file, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS place FROM pool JOIN chunks USING (id) WHERE query_id IN (FROM asking) GROUP BY query_id, file QUALIFY place <= 2),
scope AS (SELECT f.query_id, f.file, f.place, c.id FROM files f JOIN chunks c USING (file)),
inner_legs AS (
  SELECT s.*, 0 AS leg, row_number() OVER (PARTITION BY s.query_id, s.file ORDER BY coalesce(c.score, 0) DESC, s.id) AS rank FROM scope s LEFT JOIN cosines c ON c.query_id = s.query_id AND c.id = s.id
  UNION ALL SELECT s.*, 1, row_number() OVER (PARTITION BY s.query_id, s.file ORDER BY l.score DESC, s.id) FROM scope s JOIN lexs l ON l.query_id = s.query_id AND l.id = s.id),
inner_fused AS (SELECT query_id, file, place, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS s, min(leg * 1000 + rank) AS first FROM inner_legs GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, file ORDER BY s DESC, first, id) AS nth FROM inner_fused QUALIFY nth <= 3),
added AS (SELECT b.query_id, b.id, (SELECT max(pos) FROM pool p WHERE p.query_id = b.query_id) + row_number() OVER (PARTITION BY b.query_id ORDER BY place, nth) AS pos FROM best b WHERE (b.query_id, b.id) NOT IN (SELECT query_id, id FROM pool)),
expanded AS (SELECT query_id, id, pos FROM pool UNION ALL SELECT query_id, id, pos FROM added)"""
#: A file's successor is the next file, which has none itself: numbers that leave 1 modulo 4.
TRUSTED = f"""{EXPANDED}, judged AS (
  SELECT e.query_id, e.id, e.pos, coalesce(c.score, 0) AS score, k.file, s.file AS successor,
    CASE WHEN s.file IS NOT NULL THEN 'superseded' WHEN k.valid_until IS NOT NULL THEN 'expired' WHEN coalesce(c.score, 0) < {THRESHOLD}::DOUBLE THEN 'low_confidence' ELSE 'ok' END AS v
  FROM expanded e JOIN chunks k USING (id) LEFT JOIN cosines c ON c.query_id = e.query_id AND c.id = e.id LEFT JOIN (SELECT DISTINCT file, 'f' || ((id // 3) - 1) || '.md' AS old FROM chunks WHERE supersedes IS NOT NULL) s ON s.old = k.file),
named AS (SELECT DISTINCT query_id, successor AS file FROM judged WHERE v = 'superseded' AND score >= {THRESHOLD}::DOUBLE),
final AS (SELECT j.*, CASE WHEN v = 'low_confidence' AND n.file IS NOT NULL THEN 'ok' ELSE v END AS verdict FROM judged j LEFT JOIN named n USING (query_id, file)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY verdict <> 'ok', pos) AS final_pos FROM final)"""
MEMO = _verdict_sql(EDGES, None) + ", placed_final AS (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY verdict <> 'ok', pos) AS final_pos FROM final f)"
ORACLES = {
    "hybrid_search": f"WITH {POOL} SELECT p.query_id, p.id, p.pos, round(coalesce(c.score, 0), 6) AS score FROM pool p LEFT JOIN cosines c USING (query_id, id)",
    "bound_verdicts": f"""{MEMO}, st AS ({GOVERNED['calibration_statuses']}), b AS (SELECT tenant_id, max(generation_id) AS generation_id, arg_max(pipeline, generation_id) AS p FROM ({BUILT.format(orders='orders')}) GROUP BY 1),
        j AS (SELECT f.*, CASE WHEN b.generation_id IS NULL THEN 'INDEX_NOT_READY' WHEN p = 2 THEN 'LINEAGE_MISMATCH' WHEN coalesce(status, 'missing') <> 'certified' THEN 'CALIBRATION_' || upper(coalesce(status, 'missing')) END AS failure_code
          FROM placed_final f LEFT JOIN b ON b.tenant_id = f.query_id % 220 LEFT JOIN st ON st.tenant_id = b.tenant_id AND st.generation_id = b.generation_id)
        SELECT query_id, file, CASE WHEN failure_code IS NULL THEN verdict ELSE 'unverified' END AS verdict, CASE WHEN failure_code IS NULL THEN final_pos ELSE pos END AS final_pos, CASE WHEN failure_code IS NULL THEN 'trusted' ELSE 'degraded' END AS trust_state, failure_code FROM j""",
    "reranked_pool": f"""WITH {POOL}, a AS (SELECT query_id, list(DISTINCT term) AS asked FROM qterms GROUP BY 1),
        o AS (SELECT p.query_id, p.id, p.pos, CASE WHEN p.pos % 4 <> 0 THEN round(len(list_intersect(a.asked, list_distinct(d.words)))::DOUBLE / greatest(len(a.asked), 1), 9) END AS ov FROM pool p JOIN docs d USING (id) JOIN a USING (query_id))
        SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY ov DESC NULLS LAST, pos) AS pos FROM o""",
    "relational_queries": f"SELECT conv_id, turn, regexp_matches(coalesce(text, ''), '{RELATIONAL}') AS relational FROM conversations",
    "document_expansion": f"WITH {EXPANDED} SELECT * FROM expanded",
    "trusted_search": f"WITH {TRUSTED} SELECT query_id, id, pos, round(score, 6) AS score, verdict, successor AS superseded_by, round(1 / (1 + exp(-greatest(-60, least(60, (score - {THRESHOLD}::DOUBLE) / {SCALE}::DOUBLE)))), 6) AS confidence, final_pos FROM ordered",
    "trusted_evidence": f"""WITH {TRUSTED}, placed AS (SELECT o.query_id, o.id, row_number() OVER w AS nth, sum(len(d.words)) OVER (PARTITION BY o.query_id ORDER BY final_pos ROWS UNBOUNDED PRECEDING) AS used FROM ordered o JOIN docs d USING (id) WHERE verdict = 'ok' WINDOW w AS (PARTITION BY o.query_id ORDER BY final_pos)),
        b AS (SELECT query_id, string_agg(id, ',' ORDER BY nth) AS items FROM placed WHERE nth <= 5 AND used <= 400 GROUP BY 1)
        SELECT i.item_id AS query_id, coalesce(items, '') AS items, CASE WHEN items IS NULL THEN 'abstain' ELSE 'answer' END AS decision, CASE WHEN items IS NOT NULL THEN NULL WHEN i.item_id IN (SELECT query_id FROM placed) THEN 'evidence_budget_exhausted' ELSE 'no_trusted_evidence' END AS reason_code
        FROM benchmark i LEFT JOIN b ON b.query_id = i.item_id""",
    "promoted_orders": f"""{MEMO}, inherits AS (SELECT query_id, superseded_by AS file, min(pos) AS named FROM final WHERE superseded_by IS NOT NULL GROUP BY 1, 2), j AS (SELECT f.*, i.named FROM final f LEFT JOIN inherits i USING (query_id, file))
        SELECT query_id, file, row_number() OVER (PARTITION BY query_id ORDER BY verdict <> 'ok', CASE WHEN verdict <> 'ok' THEN pos WHEN named IS NULL THEN 1 ELSE 0 END, pos) AS final_pos, 'promoted_first' AS ordering FROM j
        UNION ALL SELECT query_id, file, row_number() OVER (PARTITION BY query_id ORDER BY verdict <> 'ok', CASE WHEN verdict <> 'ok' THEN pos ELSE coalesce(named, pos) END, pos), 'inherit' FROM j""",
    "entailed_hits": f"""{MEMO}, j AS (SELECT query_id, file, final_pos AS p, CASE WHEN verdict = 'ok' AND ('0x' || left(md5(file), 2))::INT % 3 = 0 THEN 'not_entailed' ELSE verdict END AS verdict FROM placed_final)
        SELECT query_id, file, verdict, row_number() OVER (PARTITION BY query_id ORDER BY verdict <> 'ok', p) AS final_pos FROM j""",
    "servable_hits": f"{MEMO} SELECT query_id, file, final_pos FROM placed_final WHERE verdict = 'ok'",
    "merged_rounds": """WITH h AS (SELECT * FROM (<HITS>)), r AS (SELECT query_id, id, pos AS rank, 0 AS round FROM h WHERE pos <= 4 UNION ALL SELECT query_id, id, pos + 1, 1 FROM h WHERE pos + 1 <= 8)
        SELECT query_id, id, rank, round::BIGINT AS round FROM r QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY round, rank) = 1""",
    "marked_texts": rf"""{MEMO}, n AS (SELECT *, regexp_replace(superseded_by, '[\p{{Cc}}\p{{Cf}}"]', '', 'g') AS s FROM final) SELECT query_id, file, md5(CASE WHEN verdict = 'ok' THEN file ELSE '[WARNING: this memory is ' || verdict || CASE WHEN verdict = 'superseded' AND superseded_by IS NOT NULL THEN ' by "' || s || '"' ELSE '' END || ' and did not pass the trust layer; do not rely on it.]' || chr(10) || file END) AS marked_md5 FROM n""",
    "safe_references": r"""WITH p AS (SELECT doc_id, trim(regexp_replace(replace(regexp_replace(text, '[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]', '', 'g'), '"', chr(39)), '[\s\p{Z}]+', ' ', 'g')) AS s FROM documents)
        SELECT doc_id, CASE WHEN coalesce(s, '') = '' THEN 'unknown' ELSE '"' || CASE WHEN length(s) > 120 THEN left(s, 120) || '…' ELSE s END || '"' END AS reference FROM p""",
    "refusal_codes": """WITH r AS (SELECT ['certified', 'uncertified', 'draft', 'stale', 'missing'][event_id % 5 + 1] AS s, event_id % 7 = 0 AS m, event_id % 11 = 0 AS none FROM events), c AS (SELECT CASE WHEN m THEN 'LINEAGE_MISMATCH' WHEN s <> 'certified' THEN 'CALIBRATION_' || upper(s) END AS code, none FROM r)
        SELECT CASE WHEN code IS NOT NULL AND none THEN 'INDEX_NOT_READY' ELSE code END AS code, count(*) AS n FROM c GROUP BY 1""",
    "adaptive_depths": """WITH p AS (SELECT q.vec_id AS query_id, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, c.vec_id) AS pos FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0),
        v AS (SELECT query_id, max(s) AS a, max(s) FILTER (pos = 8) AS b FROM p GROUP BY 1) SELECT query_id, 'max_dense_score' AS feature, round(a, 6) AS value, CASE WHEN a < 1.5 THEN 20 ELSE 5 END AS depth FROM v UNION ALL SELECT query_id, 'eighth_dense_score', round(b, 6), CASE WHEN b < 0.3 THEN 20 ELSE 5 END FROM v""",
}
ORACLES["merged_rounds"] = ORACLES["merged_rounds"].replace("<HITS>", _verdict_sql(EDGES, None).replace("min(score) AS score\n", "min(score) AS score, min(id) AS id\n") + "SELECT query_id, id, pos FROM placed")
