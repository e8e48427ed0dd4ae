"""Generation, manifest and merge queries over orders, customers, documents and events.

Orders stand for generations of their customer's corpus, documents for the objects of two manifests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lifecycle
from tidemark.sources import tables

NOW = "2024-06-01 00:00:00"
OLD = "SELECT 'd/' || CAST(doc_id AS STRING) AS uri, md5(coalesce(text, '')) AS sha256, 's' || CAST(doc_id % 97 AS STRING) AS source FROM {documents} WHERE doc_id % 10 <> 3"
NEW = "SELECT 'd/' || CAST(doc_id AS STRING) AS uri, md5(CASE WHEN doc_id % 10 = 7 THEN 'new' ELSE coalesce(text, '') END) AS sha256, 's' || CAST(doc_id % 97 AS STRING) AS source FROM {documents} WHERE doc_id % 10 <> 5"
CHUNKS = "SELECT event_id AS id, 's' || CAST(user_id % 50 AS STRING) AS source, event_type AS text, ts AS indexed_at, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts - INTERVAL '1' DAY END AS first_indexed FROM {events} WHERE event_id % 4 <> 1"
FRESH = "SELECT event_id AS id, 's' || CAST(user_id % 50 AS STRING) AS source, event_type || '+' AS text FROM {events} WHERE event_id % 6 = 1"
GENERATIONS = "SELECT o_orderkey AS generation_id, o_custkey AS tenant_id, CASE o_orderstatus WHEN 'F' THEN 'retired' WHEN 'O' THEN 'ready' ELSE 'active' END AS state, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS retired_at, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS activated_at, o_orderpriority AS sha256 FROM {orders}"
OUTBOX = "SELECT user_id % 20 AS tenant_id, 'op' || CAST(event_id % 700 AS STRING) AS operation_id, event_id AS sequence, event_type AS payload, event_id % 5 = 0 AS completed FROM {events}"


def _sql(spark, sf, text):
    import re

    return spark.sql(text, **{t: tables.table(spark, sf, t) for t in re.findall(r"\{(\w+)\}", text)})


def manifest_diff(spark, sf):
    return lifecycle.manifest_diff(_sql(spark, sf, OLD), _sql(spark, sf, NEW))


def corpus_delta(spark, sf):
    return lifecycle.corpus_delta(_sql(spark, sf, OLD), _sql(spark, sf, NEW)).withColumn("delta", F.round("delta", 9))


def generation_parity(spark, sf):
    side = lambda q: _sql(spark, sf, q).select("source", F.col("sha256").alias("hash"))
    return lifecycle.parity(side(OLD), side(NEW))


def reusable_generations(spark, sf):
    gens = _sql(spark, sf, GENERATIONS).select(F.col("tenant_id").cast("string").alias("uri"), "sha256", F.lit("p1").alias("pipeline"), "generation_id", "activated_at", "created_at")
    wanted = gens.where("generation_id % 2 = 0").select("uri", "sha256", "pipeline")
    return lifecycle.reusable(gens, wanted)


def collectable_generations(spark, sf):
    return lifecycle.collectable(_sql(spark, sf, GENERATIONS), NOW)


def active_generations(spark, sf):
    """The newest active generation of each tenant, and the one that was active before it."""
    gens = _sql(spark, sf, GENERATIONS).where("state = 'active'")
    listed = gens.groupBy("tenant_id").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("created_at", "generation_id")))), 1, 2).alias("g"))
    return listed.select("tenant_id", F.col("g")[0]["generation_id"].alias("active_id"), F.get("g", F.lit(1))["generation_id"].alias("previous_id"))


def upserted_chunks(spark, sf):
    return lifecycle.upsert(_sql(spark, sf, CHUNKS), _sql(spark, sf, FRESH), NOW)


def replaced_sources(spark, sf):
    fresh = _sql(spark, sf, FRESH).where("source in ('s1', 's2', 's3')")
    return lifecycle.replace_sources(_sql(spark, sf, CHUNKS), fresh, fresh, NOW)


def touched_chunks(spark, sf):
    return lifecycle.touch(_sql(spark, sf, CHUNKS), _sql(spark, sf, FRESH).where("id % 5 = 0"), NOW)


def forgotten_chunks(spark, sf):
    chunks = _sql(spark, sf, CHUNKS).withColumn("tenant_id", F.col("id") % 3)
    stones = _sql(spark, sf, CHUNKS).where("id % 100 = 0").select((F.col("id") % 3).alias("tenant_id"), "source")
    return lifecycle.forget(chunks, stones).groupBy("tenant_id", "source").agg(F.count(F.lit(1)).alias("n"))


def prune_guard(spark, sf):
    return lifecycle.vanished(_sql(spark, sf, OLD).select(F.col("uri").alias("source")), _sql(spark, sf, NEW).select(F.col("uri").alias("source")))


def changed_sources(spark, sf):
    side = lambda q: _sql(spark, sf, q).select(F.col("uri").alias("source"), F.col("sha256").alias("fingerprint"))
    return lifecycle.changed_only(side(NEW), side(OLD))


def covered_sources(spark, sf):
    return lifecycle.covered_sources(_sql(spark, sf, CHUNKS), _sql(spark, sf, CHUNKS).where("id % 211 <> 0").select("id"))


def pending_operations(spark, sf):
    return lifecycle.pending(_sql(spark, sf, OUTBOX))


def generation_routes(spark, sf):
    gens = _sql(spark, sf, GENERATIONS)
    route = gens.groupBy("tenant_id").agg(F.max("generation_id").alias("active_id"), F.when(F.min("generation_id") % 2 == 0, F.min("generation_id")).otherwise(F.lit(-1).cast("long")).alias("shadow_id"))
    return lifecycle.routes(route, gens)


def matching_sources(spark, sf):
    chunks = tables.table(spark, sf, "documents").select(F.concat(F.lit("d/"), F.col("doc_id")).alias("source"), F.col("source").alias("file"))
    ids = spark.createDataFrame([("d/5",), ("src3",), ("d/77",), ("absent",)], "identifier string")
    return lifecycle.matching_sources(chunks, ids)


def corpus_freshness(spark, sf):
    return lifecycle.freshness(_sql(spark, sf, CHUNKS), NOW)


def tenant_chunk_counts(spark, sf):
    """Rows of each tenant, and those without a first-seen date."""
    rows = _sql(spark, sf, CHUNKS).withColumn("tenant_id", F.col("id") % 7)
    return rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first_indexed").isNull()).alias("undated"), F.max("indexed_at").alias("newest"))


def json_metadata(spark, sf):
    """Metadata keys of events, read from JSON."""
    key = F.get_json_object("props", "$.k").cast("long")
    return tables.table(spark, sf, "events").groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def digest_manifest(spark, sf):
    """One digest of a corpus whatever the order: of the sums of its entries' digests, in two lanes, and their number."""
    entry = F.md5(F.concat_ws("=", "uri", "sha256"))
    lane = lambda at: F.sum(F.conv(F.substring(entry, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    sums = _sql(spark, sf, OLD).agg(F.count(F.lit(1)).cast("string").alias("n"), lane(1).alias("a"), lane(17).alias("b"))
    return sums.select(F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("corpus_digest"))


QUERIES = {f.__name__: f for f in (
    manifest_diff, corpus_delta, generation_parity, reusable_generations, collectable_generations, active_generations, upserted_chunks, replaced_sources, touched_chunks,
    forgotten_chunks, prune_guard, changed_sources, covered_sources, pending_operations, generation_routes, matching_sources, corpus_freshness, tenant_chunk_counts, json_metadata, digest_manifest,
)}


def _o(text: str) -> str:
    for name, body in (("OLD", OLD), ("NEW", NEW), ("CHUNKS", CHUNKS), ("FRESH", FRESH), ("GENS", GENERATIONS), ("OUTBOX", OUTBOX)):
        text = text.replace(f"<{name}>", "(" + body.replace("{", "").replace("}", "") + ")")
    return text.replace("<NOW>", f"TIMESTAMP '{NOW}'")


DIFF = "SELECT coalesce(a.uri, b.uri) AS uri, CASE WHEN a.uri IS NULL THEN 'added' WHEN b.uri IS NULL THEN 'removed' WHEN a.sha256 <> b.sha256 THEN 'modified' ELSE 'same' END AS change FROM <OLD> a FULL JOIN <NEW> b ON a.uri = b.uri"
ORACLES = {k: _o(v) for k, v in {
    "manifest_diff": DIFF,
    "corpus_delta": f"WITH d AS ({DIFF}) SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified, round(count(*) FILTER (change <> 'same')::DOUBLE / count(*), 9) AS delta FROM d",
    "generation_parity": """WITH a AS (SELECT source, min(sha256) AS lo, max(sha256) AS hi, count(*) AS n FROM <OLD> GROUP BY 1), b AS (SELECT source, min(sha256) AS lo, max(sha256) AS hi, count(*) AS n FROM <NEW> GROUP BY 1)
        SELECT source, problem FROM (SELECT coalesce(a.source, b.source) AS source, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' WHEN a.lo <> b.lo OR a.hi <> b.hi THEN 'hash' WHEN a.n <> b.n THEN 'count' END AS problem FROM a FULL JOIN b USING (source)) WHERE problem IS NOT NULL""",
    "reusable_generations": "WITH g AS (SELECT * FROM <GENS>) SELECT tenant_id::VARCHAR AS uri, sha256, generation_id FROM g WHERE (tenant_id, sha256) IN (SELECT tenant_id, sha256 FROM g WHERE generation_id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY tenant_id, sha256 ORDER BY activated_at DESC NULLS LAST, created_at DESC, generation_id DESC) = 1",
    "collectable_generations": "SELECT tenant_id, generation_id FROM (SELECT *, coalesce(retired_at, created_at) AS t, row_number() OVER (PARTITION BY tenant_id ORDER BY coalesce(retired_at, created_at) DESC, generation_id DESC) AS n FROM <GENS> WHERE state = 'retired') WHERE n > 2 AND t < <NOW> - INTERVAL 7 DAY",
    "active_generations": "SELECT tenant_id, max(generation_id) FILTER (n = 1) AS active_id, max(generation_id) FILTER (n = 2) AS previous_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, generation_id DESC) AS n FROM <GENS> WHERE state = 'active') GROUP BY 1",
    "upserted_chunks": """SELECT coalesce(o.id, f.id) AS id, coalesce(f.source, o.source) AS source, coalesce(f.text, o.text) AS text, CASE WHEN f.id IS NOT NULL THEN <NOW> ELSE o.indexed_at END AS indexed_at,
        CASE WHEN f.id IS NULL THEN o.first_indexed WHEN o.id IS NULL THEN <NOW> ELSE least(coalesce(o.first_indexed, o.indexed_at), <NOW>) END AS first_indexed FROM <CHUNKS> o FULL JOIN <FRESH> f ON o.id = f.id""",
    "replaced_sources": """WITH f AS (SELECT * FROM <FRESH> WHERE source IN ('s1', 's2', 's3')), o AS (SELECT * FROM <CHUNKS>)
        SELECT id, source, text, indexed_at, first_indexed FROM o WHERE source NOT IN (SELECT source FROM f) AND id NOT IN (SELECT id FROM f)
        UNION ALL SELECT f.id, f.source, f.text, <NOW>, CASE WHEN o.id IS NULL THEN <NOW> ELSE least(coalesce(o.first_indexed, o.indexed_at), <NOW>) END FROM f LEFT JOIN o USING (id)""",
    "touched_chunks": "WITH s AS (SELECT DISTINCT source FROM <FRESH> WHERE id % 5 = 0) SELECT id, source, text, CASE WHEN source IN (SELECT source FROM s) THEN <NOW> ELSE indexed_at END AS indexed_at, CASE WHEN source IN (SELECT source FROM s) THEN least(coalesce(first_indexed, indexed_at), <NOW>) ELSE first_indexed END AS first_indexed FROM <CHUNKS>",
    "forgotten_chunks": "SELECT id % 3 AS tenant_id, source, count(*) AS n FROM <CHUNKS> c WHERE (id % 3, source) NOT IN (SELECT (id % 3, source) FROM <CHUNKS> WHERE id % 100 = 0) GROUP BY ALL",
    "prune_guard": "SELECT count(*) AS n_known, count(*) FILTER (b.uri IS NULL) AS n_vanished, count(*) >= 5 AND count(*) FILTER (b.uri IS NULL) / count(*) >= 0.5 AS refused FROM <OLD> a LEFT JOIN <NEW> b USING (uri)",
    "changed_sources": "SELECT uri AS source, sha256 AS fingerprint FROM <NEW> WHERE (uri, sha256) NOT IN (SELECT (uri, sha256) FROM <OLD>)",
    "covered_sources": "SELECT source, count(*) AS n FROM <CHUNKS> GROUP BY source HAVING count(*) FILTER (id % 211 = 0) = 0",
    "pending_operations": "SELECT tenant_id, operation_id, min(sequence) AS sequence, arg_min(payload, sequence) AS payload, row_number() OVER (PARTITION BY tenant_id ORDER BY min(sequence)) AS turn FROM <OUTBOX> GROUP BY tenant_id, operation_id HAVING NOT bool_or(completed)",
    "generation_routes": "WITH g AS (SELECT * FROM <GENS>), r AS (SELECT tenant_id, max(generation_id) AS active_id, CASE WHEN min(generation_id) % 2 = 0 THEN min(generation_id) ELSE -1 END AS shadow_id FROM g GROUP BY 1) SELECT r.tenant_id, active_id, shadow_id, a.state AS active_state, s.state AS shadow_state FROM r JOIN g a ON a.tenant_id = r.tenant_id AND a.generation_id = active_id LEFT JOIN g s ON s.tenant_id = r.tenant_id AND s.generation_id = shadow_id",
    "matching_sources": "SELECT DISTINCT 'd/' || doc_id AS source FROM documents WHERE 'd/' || doc_id IN ('d/5', 'd/77') OR source = 'src3'",
    "corpus_freshness": "SELECT max(indexed_at) AS newest, coalesce(max(indexed_at) < <NOW> - INTERVAL 2 DAY, true) AS stale FROM <CHUNKS>",
    "tenant_chunk_counts": "SELECT id % 7 AS tenant_id, count(*) AS n, count(*) FILTER (first_indexed IS NULL) AS undated, max(indexed_at) AS newest FROM <CHUNKS> GROUP BY 1",
    "json_metadata": "SELECT (props::JSON->>'$.k')::BIGINT AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "digest_manifest": "WITH e AS (SELECT md5(uri || '=' || sha256) AS d FROM <OLD>) SELECT sha256(count(*)::VARCHAR || ':' || sum(('0x' || d[1:15])::HUGEINT)::VARCHAR || ':' || sum(('0x' || d[17:31])::HUGEINT)::VARCHAR) AS corpus_digest FROM e",
}.items()}
