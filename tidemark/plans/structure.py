"""Sources, chunks, contexts, the supersession graph and proposals, over documents, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import chunking
from tidemark.functions import text as T
from tidemark.operators import corpus, lifecycle, lines, retrieval, structure
from tidemark.plans.corpus import BASE as DOCS_SQL
from tidemark.plans.corpus import LINTED, _docs, _linted
from tidemark.plans.lifecycle import GENERATIONS, NEW, OLD, _o, _sql
from tidemark.plans.retrieval import _vector_queries, _vectors
from tidemark.plans.trust import BASE, memos
from tidemark.sources import files, tables


def document_chunks(spark, sf):
    docs = retrieval.spread(tables.table(spark, sf, "documents").select("doc_id", "text"))
    return chunking.chunk(docs, "doc_id").select("doc_id", "ord", "chunk_id", F.md5("text").alias("text_md5"))


def code_chunks(spark, sf):
    docs = retrieval.spread(tables.table(spark, sf, "documents").select("doc_id", "text"))
    return chunking.chunk(docs, "doc_id", kind="code").select("doc_id", "ord", "chunk_id", F.md5("text").alias("text_md5"))


def table_chunks(spark, sf):
    """Documents read as table blocks: row groups under a repeated header, with the numbers of their cells."""
    docs = retrieval.spread(tables.table(spark, sf, "documents").select("doc_id", "text"))
    return chunking.table_chunk(docs, "doc_id").select("doc_id", "ord", "row_start", "row_end", F.array_join("numbers", "|").alias("numbers"), F.md5("text").alias("text_md5"))


def page_texts(spark, sf):
    """What a reader of each page sees."""
    pages = retrieval.spread(tables.table(spark, sf, "pages").select("page_id", "html"))
    return pages.select("page_id", F.md5(files.visible_text(F.col("html"))).alias("text_md5"))


def dispatched_pages(spark, sf):
    return tables.table(spark, sf, "pages").groupBy(structure.kind_of(F.regexp_replace(F.concat("url", F.when(F.col("page_id") % 4 == 0, ".MD").when(F.col("page_id") % 4 == 1, ".csv").when(F.col("page_id") % 4 == 2, ".exe").otherwise("")), "[?#].*$", "")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def markdown_table(spark, sf):
    return files.markdown_rows(tables.table(spark, sf, "nation"))


def conversation_memos(spark, sf):
    return files.conversation_memos(tables.table(spark, sf, "conversations"))


NOTES = "SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN '' ELSE '---' || chr(10) END || 'supersedes: ' || CASE WHEN event_id % 3 = 0 THEN '\"e' || CAST(event_id AS STRING) || '\"' ELSE 'x/e' || CAST(event_id AS STRING) || '.md' END || chr(10) || 'valid_from: 2024-01-0' || CAST(1 + event_id % 9 AS STRING) || chr(10) || 'title: t' || chr(10) || CASE WHEN event_id % 7 = 0 THEN '' ELSE '---' || chr(10) END || 'body ' || event_type AS text FROM {events}"


def frontmatter_fields(spark, sf):
    supersedes, start, end, body = files.frontmatter(F.col("text"))
    return _sql(spark, sf, NOTES).select("id", supersedes.alias("supersedes"), start.alias("valid_from"), end.alias("valid_until"), F.md5(body).alias("body_md5"))


def manifest_objects(spark, sf):
    """Objects of JSON manifests, each address once."""
    made = _sql(spark, sf, OLD).select(F.to_json(F.struct(F.array(F.struct("uri", "sha256"), F.struct("uri", "sha256")).alias("objects"))).alias("manifest"))
    return made.select(F.explode(F.from_json("manifest", "objects array<struct<uri string, sha256 string>>")["objects"]).alias("o")).select("o.*").distinct()


def verified_objects(spark, sf):
    have = tables.table(spark, sf, "documents").where("doc_id % 50 <> 7").select(F.concat(F.lit("d/"), "doc_id").alias("file"), F.md5(F.coalesce("text", F.lit(""))).alias("content_hash"), (F.length(F.coalesce("text", F.lit(""))) + F.when(F.col("doc_id") % 60 == 1, 1).otherwise(0)).alias("size"))
    manifest = tables.table(spark, sf, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("uri"), F.when(F.col("doc_id") % 70 == 3, "x").otherwise(F.md5(F.coalesce("text", F.lit("")))).alias("sha256"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    return files.verified_objects(have, manifest)


def pinned_chunks(spark, sf):
    """Chunks of the active generation of each tenant: the pointer is read once, rows are filtered by both."""
    pointers = _sql(spark, sf, GENERATIONS).where("state = 'active'").groupBy("tenant_id").agg(F.max("generation_id").alias("generation_id"))
    rows = tables.table(spark, sf, "lineitem").select((F.col("l_orderkey")).alias("generation_id"), F.col("l_linenumber").alias("chunk"))
    return rows.join(retrieval.small(pointers), "generation_id").select("tenant_id", "generation_id", "chunk")


def live_or_legacy_sources(spark, sf):
    """Sources known to either store, each once."""
    return lifecycle.known_sources([_sql(spark, sf, OLD), _sql(spark, sf, NEW)])


def _turns(spark, sf):
    return tables.table(spark, sf, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("ord"), F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("conversation "), "conv_id").alias("title"), F.concat(F.col("role"), F.lit(" > part of a long section name, "), F.col("role")).alias("section"))


def contextual_passages(spark, sf):
    got = structure.contexts(_turns(spark, sf), 60)
    return got.select("file", "ord", "rung", F.md5("passage").alias("passage_md5"))


STEPS = "SELECT user_id AS id, event_id AS pos, CASE WHEN event_id % 4 <> 0 THEN CAST(1 + event_id % 6 AS INT) END AS level, CASE WHEN event_id % 4 <> 0 THEN event_type || CAST(event_id AS STRING) END AS heading FROM {events}"


def heading_stacks(spark, sf):
    """The open headings at each event of a user, three of four events being headings of six levels."""
    return lines.sections(_sql(spark, sf, STEPS)).select("id", "pos", "section")


def sectioned_chunks(spark, sf):
    """Every chunk of a document with its place, its document's title and the headings that it stands under."""
    docs = retrieval.spread(tables.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("d/"), "doc_id", F.lit(".md")).alias("file"), "text"))
    return lines.sectioned_chunks(docs, chunking.prose_chunks).select(F.col("id").alias("doc_id"), "ord", "start", "title", "section")


def fenced_shares(spark, sf):
    return _linted(spark, sf).select("file", F.round(lines.fenced_share(F.col("text")), 6).alias("share")).distinct()


def broken_runs(spark, sf):
    """Extraction calls of each user in order: what the cache answers, what fails, and what a failing engine is spared."""
    calls = tables.table(spark, sf, "events").selectExpr("user_id as run", "event_id as seq", "event_id % 5 = 0 as cached", "event_id % 7 < 5 as failed")
    return lines.breaker(calls)


def typed_pages(spark, sf):
    """Texts, headings and tables of each page in order."""
    pages = retrieval.spread(tables.table(spark, sf, "pages").select("page_id", "html"))
    return files.page_blocks(pages).select("page_id", "ord", "kind", "heading", "table_index", F.md5("text").alias("text_md5"))


def packed_batches(spark, sf):
    """Turns of a conversation packed in order into batches of 300 characters."""
    return structure.packed(_turns(spark, sf).withColumn("size", F.length("text")), "file", "ord", "size", 300)


def graph_edges(spark, sf):
    return structure.graph_edges(memos(spark, sf).select("file", "supersedes", "first_indexed"), "t", "g")


def near_duplicate_pairs(spark, sf):
    hits = retrieval.dense_topk(_vectors(spark, sf), _vector_queries(spark, sf), 20).join(_vectors(spark, sf).select("id", "vector"), "id")
    return structure.near_pairs(hits, 0.3).withColumn("cosine", F.round("cosine", 6))


def unlinked_decisions(spark, sf):
    """Vectors stand for memos: label 1 is closed, every fifth references the next number."""
    hits = retrieval.dense_topk(_vectors(spark, sf), _vector_queries(spark, sf), 30)
    name = lambda c: F.concat(F.lit("v/n"), F.col(c), F.lit(".md"))
    known = _vectors(spark, sf).select(F.when(F.col("id") % 90 == 7, F.concat(F.lit("w/n"), F.col("id") - 1, F.lit(".md"))).otherwise(name("id")).alias("file"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("[[n"), F.col("id") + 1, F.lit("]]"))).alias("supersedes"), (F.col("label") % 2 == 1).alias("closed"))
    return structure.unlinked_chains(hits.select(name("query_id").alias("file"), name("id").alias("candidate"), F.col("score").alias("cosine")), known, 0.1).withColumn("cosine", F.round("cosine", 6))


def validity_ranges(spark, sf):
    """First and last validity of each file's rows."""
    return memos(spark, sf).groupBy("file").agg(F.min("valid_from").alias("earliest"), F.max("valid_until").alias("latest"))


def proposal_scores(spark, sf):
    docs = _docs(spark, sf)
    made = corpus.version_proposals(docs).unionByName(corpus.reference_proposals(docs)).unionByName(corpus.ordering_proposals(docs))
    expected = corpus.reference_proposals(docs).where("substring(md5(subject), 1, 1) < '8'").select("subject", "object")
    got = structure.proposal_scores(made, expected)
    return got.select("rule", "predicted", "true_positive", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "referral_rate")])


def coerced_proposals(spark, sf):
    rows = _sql(spark, sf, "SELECT event_id AS id, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE 'a' || CAST(event_id % 5 AS STRING) END AS subject, 'a' || CAST(event_id % 7 AS STRING) AS object, CASE WHEN event_id % 4 = 0 THEN 'likes' ELSE 'supersedes' END AS relation, CASE WHEN event_id % 10 = 1 THEN NULL ELSE CAST(event_id % 12 AS DOUBLE) / 10 END AS confidence, CASE WHEN event_id % 6 = 5 THEN array() ELSE array('e') END AS evidence FROM {events}")
    return structure.coerced(rows, ("supersedes", "contradicts"))


def cited_answers(spark, sf):
    rows = _sql(spark, sf, "SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'nothing' ELSE 'see [e' || CAST(event_id % 3 AS STRING) || '] and [e' || CAST(event_id % 4 AS STRING) || ']' END AS answer, array('e0', 'e1', 'e2') AS evidence FROM {events}")
    return structure.citations(rows).withColumn("cited", F.array_join("cited", "|"))


SAID = "SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN 'yesterday' ELSE CAST(1 + event_id % 12 AS STRING) || ':' || lpad(CAST(event_id % 60 AS STRING), 2, '0') || CASE WHEN event_id % 2 = 0 THEN ' am' ELSE ' pm' END || ' on ' || CAST(1 + event_id % 28 AS STRING) || CASE WHEN event_id % 3 = 0 THEN ' May' ELSE ' October' END || ', 2023' END AS said FROM {events}"


def session_times(spark, sf):
    return _sql(spark, sf, SAID).select("id", structure.session_time(F.col("said")).alias("at"))


def code_densities(spark, sf):
    return _linted(spark, sf).select("file", F.round(T.code_density(F.col("text")), 6).alias("density")).distinct()


QUERIES = {f.__name__: f for f in (
    document_chunks, code_chunks, table_chunks, page_texts, dispatched_pages, markdown_table, conversation_memos, frontmatter_fields, manifest_objects, verified_objects,
    pinned_chunks, live_or_legacy_sources, contextual_passages, packed_batches, graph_edges, near_duplicate_pairs, unlinked_decisions, validity_ranges, proposal_scores, coerced_proposals,
    cited_answers, session_times, code_densities, heading_stacks, sectioned_chunks, fenced_shares, broken_runs, typed_pages,
)}

KNN = "(SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, c.vec_id) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0)"
LINE = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"
NW = "len([w FOR w IN string_split_regex({0}, '\\s+') IF w <> ''])"
ORACLES = {k: _o(v) for k, v in {
    "dispatched_pages": r"""WITH p AS (SELECT regexp_replace(url || CASE page_id % 4 WHEN 0 THEN '.MD' WHEN 1 THEN '.csv' WHEN 2 THEN '.exe' ELSE '' END, '[?#].*$', '') AS f FROM pages), s AS (SELECT lower(regexp_extract(f, '\.([^./]+)$', 1)) AS s FROM p)
        SELECT CASE WHEN s IN ('md', 'txt', 'rst') THEN 'text' WHEN s IN ('html', 'htm') THEN 'html' WHEN s IN ('csv', 'tsv') THEN 'table' WHEN s = 'json' THEN 'json' WHEN s = 'py' THEN 'code' END AS kind, count(*) AS n FROM s GROUP BY 1""",
    "markdown_table": r"SELECT '| ' || n_nationkey || ' | ' || regexp_replace(regexp_replace(n_name, '\s+', ' ', 'g'), '\|', '\\|', 'g') || ' | ' || n_regionkey || ' |' AS line FROM nation",
    "conversation_memos": "SELECT conv_id, turn AS ord, coalesce(role, 'unknown') || ': ' || coalesce(text, '') AS text FROM conversations",
    "frontmatter_fields": "WITH n AS (SELECT event_id AS id, event_id % 5 <> 0 AND event_id % 7 <> 0 AS has, event_type FROM events) SELECT id, CASE WHEN has THEN CASE WHEN id % 3 = 0 THEN 'e' || id ELSE 'x/e' || id || '.md' END END AS supersedes, CASE WHEN has THEN '2024-01-0' || (1 + id % 9) END AS valid_from, NULL::VARCHAR AS valid_until, md5(CASE WHEN has THEN 'body ' || event_type ELSE t.text END) AS body_md5 FROM n JOIN (" + NOTES.replace("{events}", "events").replace('"e', '"e') + ") t USING (id)",
    "manifest_objects": "SELECT uri, sha256 FROM <OLD>",
    "verified_objects": "SELECT 'd/' || doc_id AS uri, CASE WHEN doc_id % 50 = 7 THEN 'missing' WHEN doc_id % 60 = 1 THEN 'size' WHEN doc_id % 70 = 3 THEN 'digest' ELSE 'ok' END AS status FROM documents",
    "pinned_chunks": "WITH p AS (SELECT tenant_id, max(generation_id) AS generation_id FROM <GENS> WHERE state = 'active' GROUP BY 1) SELECT tenant_id, generation_id, l_linenumber AS chunk FROM lineitem JOIN p ON generation_id = l_orderkey",
    "live_or_legacy_sources": "SELECT source FROM <OLD> UNION SELECT source FROM <NEW>",
    "contextual_passages": f"""WITH t AS (SELECT conv_id AS file, turn AS ord, coalesce(text, '') AS text, 'conversation ' || conv_id AS title, {LINE.format("role || ' > part of a long section name, ' || role")} AS section FROM conversations),
        n AS (SELECT *, right(coalesce(lag({LINE.format('text')}) OVER w, ''), 200) AS pr, left(coalesce(lead({LINE.format('text')}) OVER w, ''), 200) AS nx FROM t WINDOW w AS (PARTITION BY file ORDER BY ord)),
        p AS (SELECT file, ord, text, 'title: ' || title || chr(10) AS ti, 'section: ' || section || chr(10) AS se, 'section: ' || left(section, 60) || chr(10) AS sh, 'source: ' || file || chr(10) AS so, CASE WHEN pr <> '' THEN 'previous: ' || pr || chr(10) ELSE '' END AS pv, 'content: ' || text AS co, CASE WHEN nx <> '' THEN chr(10) || 'following: ' || nx ELSE '' END AS fo FROM n),
        l AS (SELECT file, ord, text, ti || se || so || pv || co || fo AS a, ti || se || so || co AS b, ti || sh || so || co AS c, ti || so || co AS d, so || co AS e FROM p),
        r AS (SELECT *, CASE WHEN {NW.format('a')} <= 60 THEN 'full' WHEN {NW.format('b')} <= 60 THEN 'drop-neighbor' WHEN {NW.format('c')} <= 60 THEN 'shorten-section' WHEN {NW.format('d')} <= 60 THEN 'drop-section' WHEN {NW.format('e')} <= 60 THEN 'drop-title' ELSE 'chunk-only' END AS rung FROM l)
        SELECT file, ord, rung, md5(CASE rung WHEN 'full' THEN a WHEN 'drop-neighbor' THEN b WHEN 'shorten-section' THEN c WHEN 'drop-section' THEN d WHEN 'drop-title' THEN e ELSE text END) AS passage_md5 FROM r""",
    "packed_batches": """WITH RECURSIVE t AS (SELECT conv_id AS file, turn AS ord, length(coalesce(text, '')) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
        w AS (SELECT file, ord, n, s AS used, 0::BIGINT AS batch FROM t WHERE n = 1 UNION ALL SELECT t.file, t.ord, t.n, CASE WHEN w.used + t.s <= 300 THEN w.used + t.s ELSE t.s END, CASE WHEN w.used + t.s <= 300 THEN w.batch ELSE w.batch + 1 END FROM w JOIN t ON t.file = w.file AND t.n = w.n + 1) SELECT file, ord, batch FROM w""",
    "graph_edges": f"""WITH {BASE}, c AS (SELECT target AS from_file, file AS to_file, min(supersedes) AS reference, CASE WHEN count(*) = count(first_indexed) THEN min(first_indexed) END AS asserted_at FROM resolved WHERE status <> 'ambiguous' GROUP BY 1, 2)
        SELECT md5('t|g|authored_supersedes|' || from_file || '|' || to_file || '|' || reference || '|' || coalesce(strftime(asserted_at, '%Y-%m-%d %H:%M:%S'), '')) AS edge_id, from_file, to_file, reference, asserted_at, count(*) OVER (PARTITION BY from_file) > 1 AS conflicting FROM c""",
    "near_duplicate_pairs": f"WITH k AS (SELECT * FROM {KNN} WHERE rank <= 20) SELECT a.query_id, a.id AS a, b.id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS cosine FROM k a JOIN k b ON a.query_id = b.query_id AND a.id < b.id JOIN embeddings x ON x.vec_id = a.id JOIN embeddings y ON y.vec_id = b.id WHERE round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) >= 0.3",
    "unlinked_decisions": f"""WITH k AS (SELECT * FROM {KNN} WHERE rank <= 30), m AS (SELECT vec_id, 'n' || CASE WHEN vec_id % 90 = 7 THEN vec_id - 1 ELSE vec_id END AS key, CASE WHEN vec_id % 5 = 0 THEN 'n' || (vec_id + 1) END AS ref, label % 2 = 1 AS closed FROM embeddings),
        s AS (SELECT key FROM m GROUP BY 1 HAVING count(*) = 1), l AS (SELECT key AS x, ref AS y FROM m WHERE ref IS NOT NULL AND key IN (FROM s)), c AS (SELECT key FROM m WHERE closed AND key IN (FROM s))
        SELECT 'v/n' || query_id || '.md' AS file, 'v/n' || id || '.md' AS candidate, round(score, 6) AS cosine FROM k WHERE score >= 0.1 AND id <> query_id AND 'n' || query_id IN (FROM s) AND 'n' || id IN (FROM c) AND ('n' || query_id, 'n' || id) NOT IN (SELECT (x, y) FROM l UNION SELECT (y, x) FROM l)""",
    "validity_ranges": f"WITH {BASE} SELECT file, min(valid_from) AS earliest, max(valid_until) AS latest FROM memos GROUP BY 1",
    "coerced_proposals": """SELECT event_id AS id, CASE WHEN event_id % 13 = 0 THEN 'names no two files' WHEN event_id % 5 = event_id % 7 THEN 'relates a file to itself' WHEN event_id % 4 = 0 THEN 'unknown relation' WHEN event_id % 10 = 1 OR event_id % 12 > 10 THEN 'confidence out of range' WHEN event_id % 6 = 5 THEN 'no evidence' END AS problem FROM events""",
    "cited_answers": """SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 3 = event_id % 4 THEN 'e' || (event_id % 3) ELSE 'e' || (event_id % 3) || '|e' || (event_id % 4) END AS cited, CASE WHEN event_id % 5 = 0 THEN 'cites nothing' WHEN event_id % 4 = 3 THEN 'cites what is not in evidence' END AS problem FROM events""",
    "session_times": "SELECT event_id AS id, CASE WHEN event_id % 9 <> 0 THEN make_timestamp(2023, CASE WHEN event_id % 3 = 0 THEN 5 ELSE 10 END, 1 + event_id % 28, (1 + event_id % 12) % 12 + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 12 END, event_id % 60, 0) END AS at FROM events",
    "fenced_shares": f"WITH x AS ({LINTED.format(events='events')}) SELECT DISTINCT file, round(CASE WHEN text LIKE '```%' THEN 0.5 ELSE 0.0 END, 6) AS share FROM x",
    "heading_stacks": f"""WITH e AS ({STEPS.format(events='events').replace('AS STRING', 'AS VARCHAR')}), h AS (SELECT * FROM e WHERE level IS NOT NULL), o AS (
        SELECT x.id, x.pos, h.pos AS hp, h.heading FROM e x JOIN h ON h.id = x.id AND h.pos <= x.pos WHERE NOT EXISTS (SELECT 1 FROM h k WHERE k.id = x.id AND k.pos > h.pos AND k.pos <= x.pos AND k.level <= h.level))
        SELECT e.id, e.pos, coalesce(string_agg(o.heading, ' > ' ORDER BY hp), '') AS section FROM e LEFT JOIN o ON o.id = e.id AND o.pos = e.pos GROUP BY 1, 2""",
    "broken_runs": """WITH c AS (SELECT user_id AS run, event_id AS seq, event_id % 5 = 0 AS cached, event_id % 7 < 5 AS failed FROM events), g AS (SELECT *, sum((NOT cached AND NOT failed)::INT) OVER (PARTITION BY run ORDER BY seq) AS island FROM c),
        r AS (SELECT *, sum((NOT cached AND failed)::INT) OVER (PARTITION BY run, island ORDER BY seq) AS n FROM g), t AS (SELECT run, min(seq) FILTER (n >= 5) AS trip FROM r GROUP BY 1)
        SELECT run, seq, CASE WHEN cached THEN 'cached' WHEN seq > trip THEN 'skipped' WHEN failed THEN 'failed' ELSE 'done' END AS status, CASE WHEN seq > trip THEN NULL ELSE n END::BIGINT AS in_a_row FROM r JOIN t USING (run)""",
    "code_densities": f"WITH x AS ({LINTED.format(events='events')}) SELECT DISTINCT file, round(CASE WHEN text LIKE '```%' THEN 0.5 ELSE 0.0 END, 6) AS density FROM x",
}.items()}
PROPOSED = (
    "v AS (<VERSIONS>), rf AS (<REFERENCES>), od AS (<ORDERS>), made AS (SELECT * FROM v UNION ALL SELECT * FROM rf UNION ALL SELECT * FROM od), ex AS (SELECT DISTINCT subject, object FROM rf WHERE md5(subject)[1] < '8'), "
    "a AS (SELECT DISTINCT rule, subject, object FROM made WHERE status = 'proposed'), s AS (SELECT rule, count(*) AS predicted, count(e.subject) AS tp FROM a LEFT JOIN ex e ON e.subject = a.subject AND e.object = a.object GROUP BY 1) "
    "SELECT m.rule, coalesce(max(predicted), 0) AS predicted, coalesce(max(tp), 0) AS true_positive, round(max(tp)::DOUBLE / max(predicted), 6) AS precision, round(coalesce(max(tp), 0)::DOUBLE / (SELECT count(*) FROM ex), 6) AS recall, round(avg((status = 'requires_review')::INT), 6) AS referral_rate FROM made m LEFT JOIN s USING (rule) GROUP BY 1"
)


def _proposed() -> str:
    from tidemark.plans.corpus import ORACLES as made

    body = {k: made[n].split(DOCS_SQL, 1)[1].lstrip(", ") for k, n in (("VERSIONS", "version_proposals"), ("REFERENCES", "reference_proposals"), ("ORDERS", "ordering_proposals"))}
    out = PROPOSED
    for k, sql in body.items():
        out = out.replace(f"<{k}>", "WITH " + sql)
    return f"WITH {DOCS_SQL}, {out}"


ORACLES["proposal_scores"] = _proposed()
