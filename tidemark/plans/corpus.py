"""Lint, graph, proposal, claim and drift queries over notes derived from events and revisions from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import corpus
from tidemark.plans.trust import KEY
from tidemark.sources import tables

#: A note: versions of topics, references to other notes, status words, dates in the body, validity windows.
NOTES = r"""
SELECT 'n/topic' || CAST(event_id % 400 AS STRING) || CASE WHEN event_id % 5 = 0 THEN '' ELSE '_v' || CAST(event_id % 7 AS STRING) END || '_' || event_type || CAST(user_id % 3 AS STRING) || CASE WHEN event_id % 2 = 0 THEN '.md' ELSE '' END AS name,
  event_id AS i, user_id AS u, ts,
  CASE event_id % 6 WHEN 0 THEN 'This replaces `n' || CAST(event_id - 1 AS STRING) || '.md` and is approved.' WHEN 1 THEN 'Status: ' || CASE WHEN event_id % 4 = 1 THEN 'Deprecated' ELSE 'unclear' END || ' plan, now disabled.'
    WHEN 2 THEN 'Effective from 2024-02-1' || CAST(event_id % 10 AS STRING) || ' the feature is enabled.' WHEN 3 THEN 'Updates n' || CAST(event_id + 3 AS STRING) || '; expires on 2024-05-0' || CAST(1 + event_id % 9 AS STRING) || '. Blocked.'
    WHEN 4 THEN 'It was superseded by a later note.' ELSE 'Nothing to see.' END AS text
FROM {events}
"""
DOCS = f"""WITH raw AS ({NOTES}) SELECT CASE WHEN i % 3 = 0 THEN 'doc' || CAST(i % 300 AS STRING) || '_v' || CAST(i % 5 + CASE WHEN i > 5000 THEN 5 ELSE 0 END AS STRING) || CASE WHEN i % 2 = 0 THEN '.md' ELSE '.txt' END ELSE 'n' || CAST(i AS STRING) || '.md' END AS file,
 i, u, text, ts AS valid_from, CASE WHEN i % 4 = 0 THEN NULL ELSE ts + INTERVAL '10' DAY END AS valid_until, 'subject' || CAST(u AS STRING) AS subject, CASE WHEN i % 5 = 0 THEN NULL ELSE 'e' || CAST(u AS STRING) END AS entity FROM raw"""
BASE = f"docs AS ({DOCS.format(events='events')})"
LINTED = """SELECT CASE WHEN event_id % 50 = 9 THEN 'dup/m' || CAST(event_id - 1 AS STRING) ELSE 'a/m' || CAST(event_id AS STRING) END || CASE WHEN event_id % 9 = 0 THEN '_v' || CAST(event_id % 4 AS STRING) ELSE '' END || '.md' AS file,
 CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 13 = 1 THEN '[[gone' || CAST(event_id AS STRING) || ']]' WHEN event_id % 17 = 2 THEN 'm' || CAST(event_id AS STRING) WHEN event_id % 11 = 3 THEN 'm' || CAST(event_id + 1 AS STRING) || '.md'
  WHEN event_id % 11 = 4 THEN 'm' || CAST(event_id - 1 AS STRING) WHEN event_id % 23 IN (5, 6) THEN 'x/m' || CAST(event_id + 1 AS STRING) WHEN event_id % 23 = 7 THEN 'm' || CAST(event_id - 2 AS STRING) WHEN event_id % 50 = 11 THEN 'm' || CAST(event_id - 3 AS STRING) ELSE NULL END AS supersedes,
 CASE WHEN event_id % 8 = 0 THEN 'This was replaced by another.' WHEN event_id % 8 = 1 THEN '```' || chr(10) || 'deprecated' || chr(10) || '```' || chr(10) || 'fine' ELSE 'plain' END AS text,
 CASE WHEN event_id % 31 = 0 THEN '2024-02-30' ELSE '2024-02-03' END AS valid_from, CASE WHEN event_id % 10 = 0 THEN '2024-09-01' ELSE NULL END AS valid_until FROM {events}"""


def _docs(spark, sf):
    return spark.sql(DOCS, events=tables.table(spark, sf, "events"))


def _linted(spark, sf):
    return spark.sql(LINTED, events=tables.table(spark, sf, "events"))


def version_proposals(spark, sf):
    return corpus.version_proposals(_docs(spark, sf))


def reference_proposals(spark, sf):
    return corpus.reference_proposals(_docs(spark, sf))


def subject_proposals(spark, sf):
    return corpus.subject_proposals(_docs(spark, sf))


def ordering_proposals(spark, sf):
    return corpus.ordering_proposals(_docs(spark, sf))


def contradiction_proposals(spark, sf):
    return corpus.contradiction_proposals(_docs(spark, sf))


def extracted_claims(spark, sf):
    return corpus.extract_claims(_docs(spark, sf))


def judged_claims(spark, sf):
    docs = _docs(spark, sf).groupBy("file").agg(F.max("text").alias("text"))
    claims = corpus.extract_claims(docs).join(docs, "file").withColumn("quote", F.when(F.length("value") % 5 == 0, "made up").otherwise(F.substring("text", 3, 12))).drop("text")
    return corpus.judge_claims(claims, docs).select("file", "kind", "value", "reason")


def lint_findings(spark, sf):
    return corpus.lint(_linted(spark, sf)).where("code <> 'supersession-cycle'")


def supersession_cycles(spark, sf):
    return corpus.lint(_linted(spark, sf)).where("code = 'supersession-cycle'")


def graph_diagnostics(spark, sf):
    return corpus.graph_diagnostics(_linted(spark, sf))


REVISIONS = """SELECT 'p' || CAST(conv_id AS STRING) AS path, turn AS rev, 'The limit of the service is ' || CAST(length(text) % 5 AS STRING) || ' requests.' || chr(10) || '  Latency was ' || CAST(length(text) % 3 AS STRING) || ',5% lower than before.' || chr(10) || 'v' || CAST(turn AS STRING)
 || CASE WHEN turn % 3 = 2 THEN chr(10) || 'The limit of the service is 77 requests.' ELSE '' END AS text FROM {conversations}"""


def _revisions(spark, sf):
    return spark.sql(REVISIONS, conversations=tables.table(spark, sf, "conversations"))


def claim_skeletons(spark, sf):
    return corpus.claim_lines(_revisions(spark, sf))


def claim_drift(spark, sf):
    return corpus.claim_drift(_revisions(spark, sf))


def skeleton_digests(spark, sf):
    turns = tables.table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", F.md5(T.skeleton(F.col("text"))).alias("digest"))


def numeric_terms(spark, sf):
    rows = _revisions(spark, sf).select("path", "rev", T.numeric_terms(F.col("text")).alias("terms"))
    return rows.select("path", "rev", F.array_join("terms", "|").alias("terms"))


QUERIES = {f.__name__: f for f in (
    version_proposals, reference_proposals, subject_proposals, ordering_proposals, contradiction_proposals, extracted_claims, judged_claims,
    lint_findings, supersession_cycles, graph_diagnostics, claim_skeletons, claim_drift, skeleton_digests, numeric_terms,
)}

VERSION = r"regexp_matches(split_part({0}, '/', -1), '^(.*?)[_\-. ]?v(\d+)(\.[^.]+)?$')"
VBASE = KEY.format(r"(regexp_extract(split_part({0}, '/', -1), '^(.*?)[_\-. ]?v(\d+)(\.[^.]+)?$', 1) || regexp_extract(split_part({0}, '/', -1), '^(.*?)[_\-. ]?v(\d+)(\.[^.]+)?$', 3))")
VNUM = r"regexp_extract(split_part({0}, '/', -1), '^(.*?)[_\-. ]?v(\d+)(\.[^.]+)?$', 2)::BIGINT"
PROPOSAL = "'{rule}' AS rule, {old} AS subject, {new} AS object, '{relation}' AS relation, {c}::DOUBLE AS confidence, '{status}' AS status"


def _prop(rule: str, old: str, new: str, relation: str = "supersedes") -> str:
    c = corpus.CONFIDENCE[rule]
    return PROPOSAL.format(rule=rule, old=old, new=new, relation=relation, c=c, status="proposed" if c >= 0.8 else "requires_review")


DIRECT = r"(?i)\b(?:replaces|supersedes|deprecates|updates|revises)\s+`?([\w./\-\[\]]+)`?"
NUMBER = r"[-+]?\d+(?:[.,]\d+)*%?"
LINES = rf"""rev AS ({REVISIONS.format(conversations='conversations')}), l AS (SELECT path, rev, trim(unnest(string_split(text, chr(10)))) AS line FROM rev),
sk AS (SELECT *, trim(regexp_replace(line, '{NUMBER}', '#', 'g')) AS skeleton FROM l WHERE regexp_matches(line, '\d')),
claims AS (SELECT path, rev, skeleton, min(line) AS line FROM sk WHERE length(skeleton) >= 12 GROUP BY ALL HAVING min(line) = max(line))"""
LSTEM = f"x AS ({LINTED.format(events='events')}), st AS (SELECT DISTINCT file, {KEY.format('file')} AS stem FROM x), cnt AS (SELECT stem, count(*) AS n, min(file) AS only_file FROM st GROUP BY 1), " \
    f"r AS (SELECT DISTINCT x.file, {KEY.format('x.file')} AS own, {KEY.format('supersedes')} AS k, n, only_file FROM x LEFT JOIN cnt ON stem = {KEY.format('supersedes')} WHERE supersedes IS NOT NULL AND supersedes <> '')"
ORACLES = {
    "version_proposals": f"WITH {BASE}, v AS (SELECT DISTINCT file, {VBASE.format('file')} AS base, {VNUM.format('file')} AS n FROM docs WHERE {VERSION.format('file')}), p AS (SELECT *, lead(file) OVER w AS newer, lead(n) OVER w AS nn FROM v WINDOW w AS (PARTITION BY base ORDER BY n, file)) SELECT {_prop('explicit_version_naming', 'file', 'newer')} FROM p WHERE n < nn",
    "reference_proposals": f"WITH {BASE}, names AS (SELECT {KEY.format('file')} AS key, max(file) AS target FROM docs GROUP BY 1), said AS (SELECT DISTINCT file, unnest(regexp_extract_all(text, '{DIRECT}', 1)) AS s FROM docs) SELECT DISTINCT {_prop('direct_textual_reference', 'target', 'file')} FROM said JOIN names ON key = {KEY.format(chr(114) + 'trim(s, ' + chr(39) + '.,;:)' + chr(39) + ')')} WHERE target <> file",
    "subject_proposals": f"WITH {BASE}, p AS (SELECT *, lead(file) OVER w AS newer, lead(valid_from) OVER w AS nf FROM docs WINDOW w AS (PARTITION BY subject ORDER BY valid_from NULLS LAST, file)) SELECT {_prop('repeated_decision_subject', 'file', 'newer')} FROM p WHERE newer IS NOT NULL AND newer <> file AND (valid_from IS NOT NULL OR nf IS NOT NULL)",
    "ordering_proposals": f"WITH {BASE}, p AS (SELECT *, lead(file) OVER w AS newer, lead(valid_from) OVER w AS nf FROM docs WHERE entity IS NOT NULL WINDOW w AS (PARTITION BY entity ORDER BY valid_from NULLS LAST, file)) SELECT {_prop('temporal_ordering', 'file', 'newer')} FROM p WHERE valid_from < nf AND newer <> file",
    "contradiction_proposals": rf"WITH {BASE}, d AS (SELECT *, regexp_matches(text, '(?i)\b(enabled|active|valid|approved|ship|on)\b') AS pos, regexp_matches(text, '(?i)\b(disabled|inactive|invalid|rejected|blocked|off)\b') AS neg FROM docs), w AS (SELECT *, CASE WHEN pos AND NOT neg THEN 1 WHEN neg AND NOT pos THEN -1 ELSE 0 END AS p FROM d) "
    + f"SELECT {_prop('contradictory_validity_windows', 'a.file', 'b.file', 'contradicts')} FROM w a JOIN w b ON a.subject = b.subject AND a.file < b.file AND a.p <> 0 AND a.p + b.p = 0 AND greatest(a.valid_from, b.valid_from) <= least(coalesce(a.valid_until, 'infinity'::TIMESTAMP), coalesce(b.valid_until, 'infinity'::TIMESTAMP))",
    "extracted_claims": rf"""WITH {BASE} SELECT DISTINCT file, kind, v AS value FROM (
        SELECT file, 'supersession' AS kind, unnest(regexp_extract_all(text, '{DIRECT}', 1)) AS v FROM docs
        UNION ALL SELECT file, 'valid_from', unnest(regexp_extract_all(text, '(?i)\b(?:valid[ _]from|effective(?:\s+from)?)\b[^\n]{{0,40}}?(\d{{4}}-\d{{2}}-\d{{2}})', 1)) FROM docs
        UNION ALL SELECT file, 'valid_until', unnest(regexp_extract_all(text, '(?i)\b(?:valid[ _]until|expires?(?:\s+on)?)\b[^\n]{{0,40}}?(\d{{4}}-\d{{2}}-\d{{2}})', 1)) FROM docs
        UNION ALL SELECT file, 'status', unnest(regexp_extract_all(text, '(?i)\bstatus\s*[:=]\s*([A-Za-z]+)', 1)) FROM docs)""",
    "judged_claims": rf"""WITH {BASE}, d AS (SELECT file, max(text) AS text FROM docs GROUP BY 1), c AS (<CLAIMS>), q AS (SELECT c.*, d.text, CASE WHEN length(value) % 5 = 0 THEN 'made up' ELSE substring(d.text, 3, 12) END AS quote,
        CASE WHEN kind = 'supersession' THEN {KEY.format("rtrim(value, '.,;:)')")} END AS k FROM c JOIN d USING (file)), names AS (SELECT {KEY.format('file')} AS k, count(*) AS n, min(file) AS only_file FROM d GROUP BY 1)
        SELECT file, kind, value, CASE WHEN NOT contains(text, quote) THEN 'quote_not_verbatim' WHEN kind = 'supersession' AND coalesce(n, 0) <> 1 THEN 'target_not_in_corpus' WHEN kind = 'supersession' AND only_file = file THEN 'self_reference'
          WHEN kind LIKE 'valid%' AND try_cast(value AS DATE) IS NULL THEN 'not_a_date' WHEN kind = 'status' AND lower(value) NOT IN {corpus.STATUSES} THEN 'unknown_status' ELSE 'accepted' END AS reason FROM q LEFT JOIN names USING (k)""",
    "lint_findings": rf"""WITH {LSTEM}, linked AS (SELECT DISTINCT k FROM r WHERE k <> own AND n IS NOT NULL), v AS (SELECT DISTINCT file, {VBASE.format('file')} AS base, {VNUM.format('file')} AS num FROM x WHERE {VERSION.format('file')}),
        sib AS (SELECT file, lag(file) OVER (PARTITION BY base ORDER BY num, file) AS older FROM v)
        SELECT DISTINCT file, 'error' AS level, 'invalid-date' AS code FROM x WHERE try_cast(valid_from AS DATE) IS NULL OR (valid_until IS NOT NULL AND try_cast(valid_until AS DATE) IS NULL)
        UNION SELECT file, 'error', 'self-supersedes' FROM r WHERE k = own UNION SELECT file, 'error', 'dangling-supersedes' FROM r WHERE k <> own AND n IS NULL UNION SELECT file, 'error', 'ambiguous-supersedes-target' FROM r WHERE k <> own AND n > 1
        UNION SELECT file, 'warning', 'version-sibling-unlinked' FROM sib WHERE older IS NOT NULL AND {KEY.format('older')} NOT IN (SELECT k FROM linked)
        UNION SELECT file, 'warning', 'closure-marker-unlinked' FROM x WHERE (supersedes IS NULL OR supersedes = '') AND valid_until IS NULL AND {KEY.format('file')} NOT IN (SELECT k FROM linked) AND text LIKE '%replaced by%'""",
    "supersession_cycles": f"""WITH RECURSIVE {LSTEM}, e AS (SELECT DISTINCT only_file AS a, file AS b FROM r WHERE k <> own AND n = 1), w AS (SELECT a AS s, b AS here, [b] AS seen FROM e UNION ALL SELECT s, e.b, list_append(seen, e.b) FROM w JOIN e ON e.a = w.here WHERE NOT list_contains(seen, e.b) AND here <> s),
        c AS (SELECT s, list_min(seen) AS m FROM w WHERE here = s) SELECT DISTINCT min(m) AS file, 'error' AS level, 'supersession-cycle' AS code FROM c GROUP BY s""",
    "graph_diagnostics": f"""WITH {LSTEM}, g AS (SELECT DISTINCT file, only_file FROM r WHERE n = 1) SELECT 'orphaned_node' AS kind, file FROM st WHERE file NOT IN (SELECT file FROM g UNION SELECT only_file FROM g)
        UNION SELECT 'duplicate_entity_candidate', file FROM st JOIN cnt USING (stem) WHERE n > 1 UNION SELECT 'unresolved_reference', file FROM r WHERE n IS NULL UNION SELECT 'ambiguous_reference', file FROM r WHERE n > 1
        UNION SELECT 'conflicting_authored_claim', only_file FROM g GROUP BY only_file HAVING count(DISTINCT file) > 1""",
    "claim_skeletons": f"WITH {LINES} SELECT * FROM claims",
    "claim_drift": rf"""WITH {LINES}, s AS (SELECT path, rev, lead(rev) OVER (PARTITION BY path ORDER BY rev) AS next_rev FROM (SELECT DISTINCT path, rev FROM rev)),
        p AS (SELECT a.path, a.rev, s.next_rev, a.line AS old_line, b.line AS new_line, regexp_extract_all(a.line, '{NUMBER}') AS x, regexp_extract_all(b.line, '{NUMBER}') AS y
          FROM claims a JOIN s ON s.path = a.path AND s.rev = a.rev JOIN claims b ON b.path = a.path AND b.rev = s.next_rev AND b.skeleton = a.skeleton),
        c AS (SELECT *, list_filter(range(1, len(x) + 1), lambda i: x[i] <> y[i]) AS changed FROM p WHERE len(x) = len(y))
        SELECT path, rev, next_rev, old_line, new_line FROM c WHERE len(changed) = 1 AND NOT (changed[1] = 1 AND regexp_matches(old_line, '^\d+[.)]\s') AND regexp_matches(new_line, '^\d+[.)]\s'))""",
    "skeleton_digests": rf"SELECT conv_id, turn, md5(trim(regexp_replace(trim(text), '{NUMBER}', '#', 'g'))) AS digest FROM conversations",
    "numeric_terms": rf"WITH r AS ({REVISIONS.format(conversations='conversations')}), t AS (SELECT path, rev, [replace(v, ',', '.') FOR v IN regexp_extract_all(' ' || replace(text, chr(10), '  '), '[^\w.]([+-]?\d+(?:[.,]\d+)?%?)', 1)] AS ts FROM r) SELECT path, rev, (SELECT string_agg(v, '|' ORDER BY i) FROM (SELECT v, min(i) AS i FROM (SELECT unnest(ts) AS v, generate_subscripts(ts, 1) AS i) GROUP BY v)) AS terms FROM t",
}
ORACLES["judged_claims"] = ORACLES["judged_claims"].replace("<CLAIMS>", ORACLES["extracted_claims"].split("SELECT DISTINCT", 1)[1].join(["SELECT DISTINCT", ""]).replace("FROM docs", "FROM d"))
