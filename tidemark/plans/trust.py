"""Supersession, verdict and abstention queries over memos that are derived from ``events``.

Every event is a memo e<id>; most claim to supersede the same user's previous one, in several spellings; some
claims are dangling, name themselves, run in a circle or name one of two files of a name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import supersedes_key
from tidemark.operators import retrieval, trust
from tidemark.sources import tables
from tidemark.sources.shared import stored

NOW, AS_OF, THRESHOLD = "2024-06-01 00:00:00", "2024-03-01 00:00:00", 0.5

MEMOS = """
WITH e AS (
  SELECT event_id AS i, user_id AS u, ts, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM {events}
), m AS (
  SELECT i, u, ts, p, 'f' || CAST(i % 3 AS STRING) || '/e' || CAST(i AS STRING) || CASE WHEN i % 2 = 0 THEN '.md' ELSE '' END AS file,
         CASE WHEN i % 29 = 3 THEN 'gone/missing_' || CAST(i AS STRING) WHEN i % 31 = 5 THEN 'e' || CAST(i AS STRING)
              WHEN p IS NULL OR i % 4 = 0 THEN NULL WHEN i % 3 = 0 THEN '[[e' || CAST(p AS STRING) || ']]'
              WHEN i % 3 = 1 THEN 'x/e' || CAST(p AS STRING) || '.md' ELSE ' [e' || CAST(p AS STRING) || '.MD] ' END AS supersedes
  FROM e
), r AS (
  SELECT i, u, ts, file, supersedes FROM m
  UNION ALL SELECT i, u, ts, 'copy/e' || CAST(i AS STRING) || '.md', CAST(NULL AS STRING) FROM m WHERE i % 40 = 7
  UNION ALL SELECT p, u, ts, 'f' || CAST(p % 3 AS STRING) || '/e' || CAST(p AS STRING) || CASE WHEN p % 2 = 0 THEN '.md' ELSE '' END, 'e' || CAST(i AS STRING) FROM m WHERE i % 53 = 2 AND p IS NOT NULL
)
SELECT i AS id, u AS user_id, file, supersedes, CASE WHEN i % 11 = 0 THEN NULL ELSE ts END AS first_indexed, ts AS indexed_at,
       CASE WHEN i % 37 = 1 THEN '2024-13-99' WHEN i % 5 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) + CAST(i % 30 AS INT) AS STRING) END AS valid_from,
       CASE WHEN i % 7 = 0 THEN CAST(CAST(ts AS DATE) + CAST(30 + i % 90 AS INT) AS STRING) ELSE NULL END AS valid_until,
       CAST((i * 7919) % 1000 AS DOUBLE) / 1000 AS score
FROM r
"""


def memos(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(MEMOS, events=tables.table(spark, sf, "events"))


def _hits(rows: DataFrame) -> DataFrame:
    """Each user is a query; all memos of the user are hits, best score first."""
    rows = rows.groupBy("file").agg(*[F.min(c).alias(c) for c in ("id", "user_id", "first_indexed", "indexed_at", "valid_from", "valid_until", "score")])
    found = rows.withColumnRenamed("user_id", "query_id")
    return retrieval.top_k(found, 10**9, tie="file").withColumnRenamed("rank", "pos")


def supersedes_keys(spark, sf):
    return memos(spark, sf).where("supersedes is not null").select("supersedes", supersedes_key(F.col("supersedes")).alias("key")).distinct()


def supersession_edges(spark, sf):
    return trust.resolve_references(memos(spark, sf)).select("file", "supersedes", "target", "status").distinct()


def ambiguous_targets(spark, sf):
    return trust.ambiguous_files(memos(spark, sf))


def latest_edges(spark, sf):
    return trust.edges(memos(spark, sf))


def as_of_edges(spark, sf):
    return trust.edges(memos(spark, sf), AS_OF)


def successor_closure(spark, sf):
    return trust.successors(trust.edges(memos(spark, sf)))


def as_of_successors(spark, sf):
    return trust.successors(trust.edges(memos(spark, sf), AS_OF))


def _evaluated(spark, sf, known_as_of=None):
    rows = stored(memos(spark, sf))  # read by hits, edges and stems
    chain = trust.successors(trust.edges(rows, known_as_of))
    return trust.evaluate(_hits(rows), chain, trust.ambiguous_files(rows), now=NOW, threshold=THRESHOLD, known_as_of=known_as_of)


def _shown(evaluated: DataFrame) -> DataFrame:
    return evaluated.select("query_id", "file", "pos", "verdict", "superseded_by", F.round("confidence", 6).alias("confidence"), "final_pos")


def verdicts(spark, sf):
    """Verdict, promotion and final order of every hit."""
    return _shown(_evaluated(spark, sf))


def verdicts_as_of(spark, sf):
    return _shown(_evaluated(spark, sf, AS_OF))


def abstentions(spark, sf):
    users = tables.table(spark, sf, "events").select(F.col("user_id").alias("query_id")).distinct()
    return trust.abstentions(_evaluated(spark, sf), users)


def validity_windows(spark, sf):
    start, end, bad = trust.validity(F.col("valid_from"), F.col("valid_until"))
    return memos(spark, sf).select("id", start.alias("valid_start"), end.alias("valid_end"), bad.alias("malformed")).distinct()


def successor_expansion(spark, sf):
    rows = stored(memos(spark, sf))
    chain = trust.successors(trust.edges(rows))
    hits = _hits(rows).where("pos <= 5")
    scored = rows.select(F.col("user_id").alias("query_id"), "file", "id", "score").distinct()
    return trust.expand_successors(hits, chain, scored, 2, 3).select("query_id", "file", "id", "score", "nth")


def stale_probe(spark, sf):
    """Whether each query's best hit is superseded, or nothing of it can be served."""
    judged = _evaluated(spark, sf)
    return judged.groupBy("query_id").agg(
        (F.max_by("verdict", F.struct("score", -F.col("pos"))) == "superseded").alias("top_superseded"), (F.max((F.col("verdict") == "ok").cast("int")) == 0).alias("abstained"),
    )


def verdict_counts(spark, sf):
    return _evaluated(spark, sf).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


KEY = "trim(split_part(regexp_replace(trim(regexp_replace(trim({0}), '^(?:\\[\\s*)+(.*?)(?:\\s*\\])+$', '\\1')), '\\.md$', '', 'i'), '/', -1))"
BASE = f"""
memos AS ({MEMOS.format(events='events')}),
stems AS (SELECT DISTINCT file, {KEY.format('file')} AS stem FROM memos),
counted AS (SELECT stem, count(*) AS n, min(file) AS only_file FROM stems GROUP BY stem),
resolved AS (
  SELECT m.file, m.supersedes, m.first_indexed, CASE WHEN c.n IS NULL THEN split_part(m.supersedes, '/', -1) WHEN c.n = 1 THEN c.only_file END AS target,
         CASE WHEN c.n IS NULL THEN 'dangling' WHEN c.n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status
  FROM memos m LEFT JOIN counted c ON c.stem = {KEY.format('m.supersedes')} WHERE m.supersedes IS NOT NULL AND m.supersedes <> ''
),
unresolved AS (SELECT DISTINCT s.file FROM stems s JOIN counted c USING (stem) WHERE c.n > 1 AND stem IN (SELECT {KEY.format('supersedes')} FROM memos WHERE supersedes IS NOT NULL))
"""
EDGES = """
edges AS (SELECT target, successor FROM (SELECT target, file AS successor, row_number() OVER (PARTITION BY target ORDER BY file DESC, supersedes DESC) AS n FROM resolved WHERE status <> 'ambiguous') WHERE n = 1)
"""
AS_OF_EDGES = f"""
claims AS (SELECT target, file, CASE WHEN count(*) = count(first_indexed) THEN min(first_indexed) END AS t, max(supersedes) AS last_text FROM resolved WHERE status <> 'ambiguous' GROUP BY target, file),
edges AS (SELECT target, successor FROM (
  SELECT target, file AS successor, row_number() OVER (PARTITION BY target ORDER BY (t IS NOT NULL) DESC, t DESC, file DESC, last_text DESC) AS n
  FROM claims WHERE t IS NULL OR t <= TIMESTAMP '{AS_OF}') WHERE n = 1)
"""
CHAIN = """
walk AS (
  SELECT target AS file, successor AS direct, successor AS here, [target, successor] AS seen FROM edges WHERE target <> successor
  UNION ALL
  SELECT w.file, w.direct, e.successor, list_append(w.seen, e.successor) FROM walk w JOIN edges e ON e.target = w.here WHERE NOT list_contains(w.seen, e.successor)
),
ends AS (SELECT file, any_value(direct) AS direct, arg_max(here, len(seen)) AS here FROM walk GROUP BY file),
chain AS (SELECT file, CASE WHEN here IN (SELECT target FROM edges) THEN direct ELSE here END AS successor FROM ends)
"""


def _verdict_sql(edges: str, as_of: str | None) -> str:
    known = f"WHEN coalesce(h.first_indexed, h.indexed_at) > TIMESTAMP '{as_of}' THEN 'not_yet_known'" if as_of else ""
    return f"""WITH RECURSIVE {BASE}, {edges}, {CHAIN},
hits AS (SELECT file, min(user_id) AS query_id, min(first_indexed) AS first_indexed, min(indexed_at) AS indexed_at, min(valid_from) AS valid_from, min(valid_until) AS valid_until, min(score) AS score
         FROM memos GROUP BY file),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file) AS pos FROM hits),
judged AS (SELECT h.*, c.successor, CASE WHEN (valid_from IS NOT NULL AND try_cast(valid_from AS DATE) IS NULL) OR (valid_until IS NOT NULL AND try_cast(valid_until AS DATE) IS NULL) THEN 'invalid_metadata' {known}
   WHEN h.file IN (SELECT file FROM unresolved) THEN 'ambiguous_supersession' WHEN c.successor IS NOT NULL THEN 'superseded'
   WHEN TIMESTAMP '{NOW}' >= try_cast(valid_until AS DATE) + INTERVAL 1 DAY THEN 'expired' WHEN TIMESTAMP '{NOW}' < try_cast(valid_from AS DATE) THEN 'not_yet_valid'
   WHEN score < {THRESHOLD} THEN 'low_confidence' ELSE 'ok' END AS v FROM placed h LEFT JOIN chain c USING (file)),
named AS (SELECT DISTINCT query_id, successor AS file FROM judged WHERE v = 'superseded' AND score >= {THRESHOLD}),
final AS (SELECT j.query_id, j.file, j.pos, j.score, CASE WHEN v = 'low_confidence' AND n.file IS NOT NULL THEN 'ok' ELSE v END AS verdict,
   CASE WHEN v = 'superseded' THEN successor END AS superseded_by FROM judged j LEFT JOIN named n USING (query_id, file))
"""


FINAL = f"""SELECT query_id, file, pos, verdict, superseded_by, round(1 / (1 + exp(-greatest(-60, least(60, (score - {THRESHOLD}) / 0.05)))), 6) AS confidence,
 row_number() OVER (PARTITION BY query_id ORDER BY verdict <> 'ok', pos) AS final_pos FROM final"""
ABSTAIN = """, best AS (SELECT query_id, bool_or(verdict = 'ok') AS any_ok, first(file ORDER BY score DESC, pos) AS f, first(verdict ORDER BY score DESC, pos) AS v, first(superseded_by ORDER BY score DESC, pos) AS s FROM final GROUP BY query_id)
SELECT u.query_id, coalesce(NOT any_ok, true) AS abstained, CASE WHEN any_ok THEN '' WHEN any_ok IS NULL THEN 'nothing was retrieved' WHEN v = 'superseded' THEN 'best hit ' || f || ' is superseded by ' || s
 WHEN v = 'expired' THEN 'best hit ' || f || ' has expired' WHEN v = 'not_yet_valid' THEN 'best hit ' || f || ' is not yet valid' WHEN v = 'not_yet_known' THEN 'best hit ' || f || ' was written after the as-of time'
 WHEN v = 'invalid_metadata' THEN 'best hit ' || f || ' has malformed validity dates' WHEN v = 'ambiguous_supersession' THEN 'best hit ' || f || ' shares its name with another superseded file'
 ELSE 'no hit reaches the confidence threshold' END AS reason FROM (SELECT DISTINCT user_id AS query_id FROM events) u LEFT JOIN best USING (query_id)"""

QUERIES = {f.__name__: f for f in (
    supersedes_keys, supersession_edges, ambiguous_targets, latest_edges, as_of_edges, successor_closure, as_of_successors, verdicts, verdicts_as_of,
    abstentions, validity_windows, successor_expansion, stale_probe, verdict_counts,
)}
ORACLES = {
    "supersedes_keys": f"WITH {BASE} SELECT DISTINCT supersedes, {KEY.format('supersedes')} AS key FROM memos WHERE supersedes IS NOT NULL",
    "supersession_edges": f"WITH {BASE} SELECT DISTINCT file, supersedes, target, status FROM resolved",
    "ambiguous_targets": f"WITH {BASE} SELECT file FROM unresolved",
    "latest_edges": f"WITH {BASE}, {EDGES} SELECT * FROM edges",
    "as_of_edges": f"WITH {BASE}, {AS_OF_EDGES} SELECT * FROM edges",
    "successor_closure": f"WITH RECURSIVE {BASE}, {EDGES}, {CHAIN} SELECT * FROM chain",
    "as_of_successors": f"WITH RECURSIVE {BASE}, {AS_OF_EDGES}, {CHAIN} SELECT * FROM chain",
    "verdicts": _verdict_sql(EDGES, None) + FINAL,
    "verdicts_as_of": _verdict_sql(AS_OF_EDGES, AS_OF) + FINAL,
    "abstentions": _verdict_sql(EDGES, None) + ABSTAIN,
    "validity_windows": f"""WITH {BASE} SELECT DISTINCT id, try_cast(valid_from AS DATE)::TIMESTAMP AS valid_start, try_cast(valid_until AS DATE) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS valid_end,
        coalesce((valid_from IS NOT NULL AND try_cast(valid_from AS DATE) IS NULL) OR (valid_until IS NOT NULL AND try_cast(valid_until AS DATE) IS NULL), false) AS malformed FROM memos""",
    "successor_expansion": _verdict_sql(EDGES, None) + """, pool AS (SELECT query_id, file, pos FROM placed WHERE pos <= 5),
        wanted AS (SELECT query_id, successor AS file, min(pos) AS best FROM pool JOIN chain USING (file) GROUP BY 1, 2),
        chosen AS (SELECT query_id, file FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, file) AS place FROM wanted WHERE (query_id, file) NOT IN (SELECT query_id, file FROM pool)) WHERE place <= 2)
        SELECT query_id, file, id, score, nth FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id, file ORDER BY score DESC, id) AS nth FROM (SELECT DISTINCT user_id AS query_id, file, id, score FROM memos) s JOIN chosen USING (query_id, file)) WHERE nth <= 3""",
    "stale_probe": _verdict_sql(EDGES, None) + "SELECT query_id, first(verdict ORDER BY score DESC, pos) = 'superseded' AS top_superseded, NOT bool_or(verdict = 'ok') AS abstained FROM final GROUP BY query_id",
    "verdict_counts": _verdict_sql(EDGES, None) + "SELECT verdict, count(*) AS n, round(avg(score), 6) AS mean_score FROM final GROUP BY verdict",
}
