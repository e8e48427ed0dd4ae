"""Queries of calibration artefacts, generations, reviews, outbox, caches and resampling, over orders and events."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import evaluation, governance, resampling
from tidemark.plans.lifecycle import _o, _sql
from tidemark.sources import tables

ARTIFACTS = """SELECT o_custkey % 200 AS tenant_id, o_orderkey % 7 AS generation_id, 'c' || CAST(o_orderkey AS STRING) AS calibration_id, o_orderkey % 5 <> 0 AS certified,
 CASE WHEN o_orderkey % 4 = 1 AND o_orderstatus = 'F' THEN 'published' WHEN o_orderkey % 4 = 2 THEN 'rejected' ELSE 'draft' END AS state, o_orderkey % 3 AS pipeline, o_orderkey % 2 AS corpus, o_orderdate AS created_at FROM {orders}"""
#: One published artefact of a generation at most: the last one.
ONE_PUBLISHED = f"""SELECT tenant_id, generation_id, calibration_id, certified, CASE WHEN state = 'published' AND n > 1 THEN 'retired' ELSE state END AS state, pipeline, corpus, created_at FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, generation_id, state ORDER BY calibration_id DESC) AS n FROM ({ARTIFACTS}))"""
#: Every customer's orders are its generations; each generation has the pipeline and corpus of its newest order.
BUILT = "SELECT o_custkey % 210 AS tenant_id, o_orderkey % 8 AS generation_id, max(o_orderkey) % 3 AS pipeline, max(o_orderkey) % 2 AS corpus FROM {orders} GROUP BY o_custkey % 210, o_orderkey % 8"
STATES = "SELECT o_custkey AS tenant_id, o_orderkey AS generation_id, CASE o_orderstatus WHEN 'F' THEN 'retired' WHEN 'O' THEN 'ready' ELSE 'active' END AS state, o_orderkey % 3 <> 0 AS certified FROM {orders}"
DELTAS = "SELECT event_type, user_id AS unit, avg(CAST(event_id % 7 AS DOUBLE) - 3 + CASE WHEN event_type = 'click' THEN 0.2 ELSE 0 END) AS delta FROM {events} GROUP BY event_type, user_id"


def calibration_statuses(spark, sf):
    return governance.calibration_status(_sql(spark, sf, BUILT), _sql(spark, sf, ONE_PUBLISHED))


def published_artifacts(spark, sf):
    rows = _sql(spark, sf, ONE_PUBLISHED)
    chosen = rows.where("state = 'draft'").groupBy("tenant_id", "generation_id").agg(F.max("calibration_id").alias("calibration_id"))
    return governance.publish(rows, chosen).select("tenant_id", "generation_id", "calibration_id", "state")


def carried_calibrations(spark, sf):
    rows = tables.table(spark, sf, "events").selectExpr("event_id", "event_id % 9 <> 0 as same_pipeline", "cast(event_id % 40 as double) / 100 as delta", "case when event_id % 31 = 0 then null else 0.85 + cast(event_id % 15 as double) / 100 end as auc", "event_id % 60 as n_pos", "25 as n_neg", "cast(event_id % 17 as double) / 100 as false_abstain_rate", "cast(event_id % 13 as double) / 100 as false_confirm_rate")
    return governance.carry_forward(rows).select("event_id", "decision")


def query_set_digests(spark, sf):
    """The digest of each role's turns as a labelled query set."""
    turns = tables.table(spark, sf, "conversations").select("role", F.col("text").alias("query"), (F.col("turn") % 2 == 0).alias("answerable"))
    return governance.query_set_digest(turns, ["role"])


def recalibration_actions(spark, sf):
    rows = tables.table(spark, sf, "events").selectExpr("event_id % 4 as d", "event_id % 3 = 0 as running", "event_id % 5 <> 0 as labelled")
    drift = F.element_at(F.array(*map(F.lit, ("stable", "unknown", "recalibration_recommended", "recalibration_required"))), (F.col("d") + 1).cast("int"))
    return rows.groupBy(governance.recalibration_action(drift, F.col("running"), F.col("labelled")).alias("action")).agg(F.count(F.lit(1)).alias("n"))


def reviewed_proposals(spark, sf):
    events = _sql(spark, sf, "SELECT user_id AS proposal_id, event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'review' WHEN 1 THEN 'accept' WHEN 2 THEN 'promote' ELSE CASE WHEN event_id % 12 = 3 THEN 'reject' ELSE 'review' END END AS action, CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'r' END AS reviewer, CASE WHEN event_id % 10 = 0 THEN ' ' ELSE 'note' END AS note FROM {events}")
    return governance.review(_sql(spark, sf, "SELECT DISTINCT user_id AS proposal_id, user_id % 4 AS n_evidence FROM {events}"), events)


def promoted_generations(spark, sf):
    rows = _sql(spark, sf, STATES)
    chosen = rows.where("state = 'ready'").groupBy("tenant_id").agg(F.max("generation_id").alias("generation_id"))
    return governance.promote(rows, chosen).select("tenant_id", "generation_id", "state", "previous")


OBJECTS = "SELECT doc_id % 40 AS generation_id, 'd/' || CAST(doc_id AS STRING) AS uri, md5(coalesce(text, '')) AS sha256 FROM {documents}"


def validated_generations(spark, sf):
    rows = _sql(spark, sf, OBJECTS)
    uri = F.substring("uri", 3, 20).cast("long")
    stored = rows.where((F.col("generation_id") > 3) | (uri % 3 != 1)).withColumn("sha256", F.when(uri % 200 == 5, "x").otherwise(F.col("sha256")))
    return governance.validate(rows, stored)


OUTBOX = "SELECT tenant_id, operation_id, min(sequence) AS sequence, min(payload) AS payload, bool_or(completed) AS completed FROM (SELECT user_id % 20 AS tenant_id, 'op' || CAST(event_id % 700 AS STRING) AS operation_id, event_id AS sequence, event_type AS payload, event_id % 5 = 0 AS completed FROM {events}) GROUP BY tenant_id, operation_id"


def appended_operations(spark, sf):
    new = _sql(spark, sf, "SELECT user_id % 25 AS tenant_id, 'op' || CAST(event_id % 900 AS STRING) AS operation_id, event_type AS payload FROM {events}")
    done = _sql(spark, sf, "SELECT DISTINCT user_id % 25 AS tenant_id, 'op' || CAST(event_id % 900 AS STRING) AS operation_id FROM {events} WHERE event_id % 9 = 0")
    return governance.complete(governance.append_operations(_sql(spark, sf, OUTBOX), new), done)


def cluster_interval(spark, sf):
    """Share of the purchases' value in all value of a user, users as clusters and their last digit as strata."""
    rows = tables.table(spark, sf, "events").selectExpr("user_id % 10 as stratum", "user_id as cluster", "cast(event_id % 9 as double) * cast(event_type = 'click' as int) as num", "cast(event_id % 9 as double) as den")
    return resampling.cluster_bootstrap(rows).select("n_clusters", *(F.round(c, 6).alias(c) for c in ("ratio", "low", "high")))


def rolled_back_generations(spark, sf):
    """Every tenant that promoted a generation goes back to the one before."""
    return governance.roll_back(promoted_generations(spark, sf))


def generation_lifecycles(spark, sf):
    """Lines of an order are actions on a generation."""
    names = "'stage', 'validate', 'promote', 'retire', 'rollback', 'fail', 'abandon'"
    actions = tables.table(spark, sf, "lineitem").selectExpr("l_orderkey as generation_id", "l_linenumber as seq", f"element_at(array({names}), cast((l_linenumber * 2 + l_partkey) % 7 + 1 as int)) as action")
    return governance.lifecycle_states(actions)


OPERATIONS = """SELECT user_id % 20 AS tenant_id, 'op' || CAST(event_id AS STRING) AS operation_id, event_id AS sequence, CASE WHEN event_id % 4 = 3 THEN 'delete' ELSE 'index' END AS kind, event_id % 3 = 0 AS completed,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE array_distinct(array('s' || CAST(event_id % 50 AS STRING), 's' || CAST(event_id % 7 AS STRING))) END AS sources,
 array(named_struct('id', 'c' || CAST(event_id AS STRING) || 'a', 'source', 's' || CAST(event_id % 50 AS STRING), 'text', event_type), named_struct('id', 'c' || CAST(event_id AS STRING) || 'b', 'source', 's' || CAST(event_id % 7 AS STRING), 'text', CAST(user_id AS STRING))) AS chunks FROM {events}"""


def replayed_outbox(spark, sf):
    """Documents as the stored chunks of twenty tenants, after the open operations of events."""
    store = tables.table(spark, sf, "documents").selectExpr("doc_id % 20 as tenant_id", "'d' || cast(doc_id as string) as id", "'s' || cast(doc_id % 60 as string) as source", "md5(coalesce(text, '')) as text")
    return governance.replay(store, _sql(spark, sf, OPERATIONS))


def erased_operations(spark, sf):
    """What each tenant's open operations keep once two of its sources are erased."""
    erased = tables.table(spark, sf, "events").selectExpr("user_id % 20 as tenant_id", "explode(array('s' || cast(user_id % 20 as string), 's' || cast(user_id % 20 % 7 as string))) as source")
    rows = governance.erase_pending(_sql(spark, sf, OPERATIONS), erased)
    return rows.select("tenant_id", "operation_id", F.array_join(F.array_sort("sources"), ",").alias("sources"), F.array_join(F.transform("chunks", lambda c: c["id"]), ",").alias("chunks"), "completed")


def carried_rows(spark, sf):
    chunks = _sql(spark, sf, OBJECTS).select("uri", "sha256", F.concat(F.lit("g"), F.col("generation_id")).alias("generation_id"))
    found = chunks.groupBy("uri", "sha256").agg(F.max("generation_id").alias("generation_id")).where("substring(sha256, 1, 1) < '8'")
    return governance.carry_rows(chunks, found, "next")


def cached_extractions(spark, sf):
    """Documents whose text is in a cache of the right version, and how many have to be read."""
    docs = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    cache = docs.groupBy(F.sha2("text", 256).alias("key")).agg(F.min("id").alias("value")).withColumn("version", F.when(F.col("value") % 3 == 0, "v1").otherwise("v2"))
    found, missing = governance.cached(docs, cache, "v2")
    return found.select("id", "value").unionByName(missing.select("id", F.lit(None).cast("long").alias("value")))


def bundle_round_trip(spark, sf):
    """Artefacts exported and read back; lines whose checksum is broken are left out."""
    lines = governance.bundle_lines(_sql(spark, sf, ARTIFACTS), ["tenant_id", "calibration_id", "certified"])
    broken = lines.withColumn("line", F.when(F.col("line").contains('"tenant_id":7,'), F.concat("line", F.lit(" "))).otherwise(F.col("line")))
    return governance.read_bundle(broken, "tenant_id long, calibration_id string, certified boolean")


def bootstrap_interval(spark, sf):
    """Mean paired difference of each event type over users, with a percentile interval."""
    got = resampling.bootstrap(_sql(spark, sf, DELTAS), ["event_type"], "unit", "delta")
    return got.select("event_type", "n_units", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


def sign_flip_p(spark, sf):
    return resampling.sign_flip(_sql(spark, sf, DELTAS), ["event_type"], "unit", "delta").select("event_type", F.round("p", 6).alias("p"))


def _ordered_deltas(spark, sf):
    """The rows of DELTAS, their sums made in the order of event_id, as SQL on one thread does: a mean that is zero but
    for rounding has the sign that this order gives it, and not one that hangs on how a table is split."""
    rows = _sql(spark, sf, "SELECT event_type, user_id AS unit, event_id, CAST(event_id % 7 AS DOUBLE) - 3 + CASE WHEN event_type = 'click' THEN 0.2 ELSE 0 END AS x FROM {events}")
    order = W.partitionBy("event_type", "unit").orderBy("event_id")
    summed = rows.withColumn("n", F.row_number().over(order)).withColumn("total", F.sum("x").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return summed.groupBy("event_type", "unit").agg((F.max_by("total", "n") / F.nullif(F.count("x"), F.lit(0))).alias("delta"))


def sign_test(spark, sf):
    return resampling.sign_test(_ordered_deltas(spark, sf), ["event_type"], "delta").select("event_type", "ups", "downs", F.round("p", 6).alias("p"))


def wilcoxon_signed_rank(spark, sf):
    rows = _sql(spark, sf, "SELECT event_type, CAST(event_id % 23 AS DOUBLE) - 9 AS delta FROM {events}")
    return resampling.wilcoxon(rows, ["event_type"], "delta").select("event_type", "n", F.round("w", 3).alias("w"), F.round("z", 6).alias("z"))


def partial_correlations(spark, sf):
    """Rank correlations of three figures of documents, Pearson's, and the partial one with length held fixed."""
    rows = tables.table(spark, sf, "documents").where("text is not null and n_chars > 0").selectExpr("n_chars as z", "cast(doc_id % 101 as double) + n_chars / 5000 as x", "cast(doc_id % 37 as double) + n_chars / 9000 as y")
    r = {a + b: evaluation.spearman(rows, a, b).select(F.col("rho").alias(a + b)) for a, b in ("xy", "xz", "yz")}
    one = r["xy"].join(r["xz"]).join(r["yz"]).join(rows.agg(F.corr("x", "y").alias("pearson")))  # one row each
    return one.select(F.round("pearson", 6).alias("pearson"), F.round("xy", 6).alias("spearman"), F.round(resampling.partial(F.col("xy"), F.col("xz"), F.col("yz")), 6).alias("partial"))


def promotion_gate(spark, sf):
    """The reasons for which a candidate isn't promoted: event types stand for corpora."""
    units = _sql(spark, sf, DELTAS)
    p = resampling.sign_test(_ordered_deltas(spark, sf), ["event_type"], "delta").select(F.col("event_type").alias("name"), "p")
    deltas = units.groupBy("event_type").agg(F.avg("delta").alias("delta")).join(evaluation.holm(p).select(F.col("name").alias("event_type"), "adjusted"), "event_type").withColumnRenamed("event_type", "corpus")
    macro = resampling.bootstrap(units.groupBy("unit").agg(F.avg("delta").alias("delta")).withColumn("all", F.lit(1)), ["all"], "unit", "delta")
    return resampling.promotion_failures(deltas, macro)


QUERIES = {f.__name__: f for f in (
    calibration_statuses, published_artifacts, carried_calibrations, query_set_digests, recalibration_actions, reviewed_proposals, promoted_generations, validated_generations,
    appended_operations, cluster_interval, rolled_back_generations, generation_lifecycles, replayed_outbox, erased_operations, carried_rows, cached_extractions, bundle_round_trip, bootstrap_interval, sign_flip_p, sign_test, wilcoxon_signed_rank, partial_correlations, promotion_gate,
)}

U = "('0x' || left(md5('{seed}|' || r || '|' || {key}), 13))::BIGINT / 4503599627370496.0::DOUBLE"
WEIGHT = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in resampling.POISSON_1)
PUBLISHED = "(" + ONE_PUBLISHED.replace("{orders}", "orders") + ")"
D = "(" + DELTAS.replace("{events}", "events") + ")"


def _duck(sql: str) -> str:
    """named_struct('a', x, ...) as DuckDB's struct literals."""
    return re.sub(r"named_struct\('id', (.*?), 'source', (.*?), 'text', (event_type|CAST\(user_id AS STRING\))\)", r"{'id': \1, 'source': \2, 'text': \3}", sql)


def _boot(units: str, by: str) -> str:
    return f"""units AS {units}, w AS (SELECT {by} AS g, r, ({WEIGHT})::DOUBLE AS w, delta FROM (SELECT *, {U.format(seed='boot-1', key='unit')} AS u FROM units, range(200) t(r))),
 whole AS (SELECT {by} AS g, count(*) AS n_units, avg(delta) AS mean FROM units GROUP BY 1), m AS (SELECT g, r, round(coalesce(sum(w * delta) / nullif(sum(w), 0), any_value(mean)), 12) AS m FROM w JOIN whole USING (g) GROUP BY g, r),
 o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY m) - 1 AS i FROM m), boot AS (SELECT g, any_value(n_units) AS n_units, any_value(mean) AS mean, max(m) FILTER (i = 5) AS low, max(m) FILTER (i = 194) AS high FROM o JOIN whole USING (g) GROUP BY g)"""


SIGNS = f"""c AS (SELECT event_type, count(*) FILTER (delta > 0) AS ups, count(*) FILTER (delta < 0) AS downs FROM {D} GROUP BY 1),
 b AS (SELECT event_type, ups, downs, exp(lgamma(ups + downs + 1.0) - lgamma(i + 1.0) - lgamma(ups + downs - i + 1.0) - (ups + downs) * ln(2.0)) AS term FROM (SELECT *, unnest(range(least(ups, downs) + 1)) AS i FROM c)),
 st AS (SELECT event_type, ups, downs, least(1.0, 2 * sum(term)) AS p FROM b GROUP BY ALL)"""
ORACLES = {k: _o(v) for k, v in {
    "calibration_statuses": f"""WITH g AS ({BUILT.format(orders='orders')}), a AS {PUBLISHED},
        l AS (SELECT tenant_id, generation_id, arg_max(certified, (created_at, calibration_id)) AS c, arg_max(state, (created_at, calibration_id)) AS s FROM a GROUP BY 1, 2), j AS (
        SELECT g.tenant_id, g.generation_id, CASE WHEN p.calibration_id IS NULL THEN CASE WHEN NOT l.c THEN 'uncertified' WHEN l.s = 'draft' THEN 'draft' WHEN g.tenant_id IN (SELECT tenant_id FROM a WHERE state = 'published') THEN 'stale' ELSE 'missing' END
          WHEN p.pipeline <> g.pipeline OR p.corpus <> g.corpus THEN 'stale' WHEN NOT p.certified THEN 'uncertified' ELSE 'certified' END AS status, p.calibration_id
        FROM g LEFT JOIN (SELECT * FROM a WHERE state = 'published') p ON p.tenant_id = g.tenant_id AND p.generation_id = g.generation_id LEFT JOIN l ON l.tenant_id = g.tenant_id AND l.generation_id = g.generation_id)
        SELECT tenant_id, generation_id, status, CASE WHEN status = 'certified' THEN calibration_id END AS calibration_id FROM j""",
    "published_artifacts": f"""WITH a AS {PUBLISHED}, c AS (SELECT tenant_id, generation_id, max(calibration_id) AS id FROM a WHERE state = 'draft' GROUP BY 1, 2), m AS (SELECT a.*, c.id IS NOT NULL AND certified AND state = 'draft' AS goes FROM a LEFT JOIN c ON c.tenant_id = a.tenant_id AND c.id = a.calibration_id)
        SELECT tenant_id, generation_id, calibration_id, CASE WHEN goes THEN 'published' WHEN state = 'published' AND bool_or(goes) OVER (PARTITION BY tenant_id, generation_id) THEN 'retired' ELSE state END AS state FROM m""",
    "carried_calibrations": """WITH r AS (SELECT event_id AS e, (e % 40)::DOUBLE / 100 AS delta, CASE WHEN e % 31 = 0 THEN NULL ELSE 0.85::DOUBLE + (e % 15)::DOUBLE / 100 END AS auc, e % 60 AS p, 25 AS m, (e % 17)::DOUBLE / 100 AS fa, (e % 13)::DOUBLE / 100 AS fc FROM events),
        s AS (SELECT *, CASE WHEN least(p, m) < 20 THEN false ELSE greatest(0, auc - 1.96 * sqrt(greatest(0, (auc * (1 - auc) + (p - 1) * (auc / (2 - auc) - auc * auc) + (m - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (p * m)))) >= 0.9 END AS sure FROM r)
        SELECT e AS event_id, CASE WHEN e % 9 = 0 THEN 'refused_pipeline' WHEN delta > 0.25 THEN 'refused_delta' WHEN auc IS NULL THEN 'refused_one_class' WHEN sure AND fa <= 0.1 AND fc <= 0.1 THEN 'certified' WHEN sure THEN 'rejected_boundary' ELSE 'rejected_separability' END AS decision FROM s""",
    "recalibration_actions": "SELECT CASE WHEN event_id % 4 < 2 THEN 'none' WHEN event_id % 3 = 0 THEN 'wait' WHEN event_id % 5 <> 0 THEN 'recalibrate' ELSE 'request_labels' END AS action, count(*) AS n FROM events GROUP BY 1",
    "reviewed_proposals": """WITH RECURSIVE e AS (SELECT user_id AS p, CASE event_id % 4 WHEN 0 THEN 'review' WHEN 1 THEN 'accept' WHEN 2 THEN 'promote' ELSE CASE WHEN event_id % 12 = 3 THEN 'reject' ELSE 'review' END END AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_id % 6 <> 0 AND event_id % 10 <> 0),
        w AS (SELECT DISTINCT user_id AS p, 0::BIGINT AS n, 'proposed' AS s FROM events UNION ALL SELECT w.p, e.n, CASE WHEN s = 'proposed' AND a = 'review' THEN 'reviewed' WHEN s = 'reviewed' AND a = 'accept' THEN 'accepted' WHEN s IN ('reviewed', 'accepted') AND a = 'reject' THEN 'rejected' WHEN s = 'accepted' AND a = 'promote' THEN 'promoted' ELSE s END FROM w JOIN e ON e.p = w.p AND e.n = w.n + 1)
        SELECT p AS proposal_id, arg_max(s, n) AS state, arg_max(s, n) = 'promoted' AND p % 4 > 0 AS trusted FROM w GROUP BY p""",
    "promoted_generations": """WITH g AS (SELECT o_custkey AS tenant_id, o_orderkey AS generation_id, CASE o_orderstatus WHEN 'F' THEN 'retired' WHEN 'O' THEN 'ready' ELSE 'active' END AS state, o_orderkey % 3 <> 0 AS c FROM orders), m AS (SELECT *, state = 'ready' AND c AND generation_id = max(generation_id) FILTER (state = 'ready') OVER (PARTITION BY tenant_id) AS goes FROM g), k AS (SELECT *, coalesce(bool_or(goes) OVER (PARTITION BY tenant_id), false) AS moved FROM m)
        SELECT tenant_id, generation_id, CASE WHEN goes THEN 'active' WHEN state = 'active' AND moved THEN 'retired' ELSE state END AS state, moved AND state = 'active' AS previous FROM k""",
    "cluster_interval": f"""WITH t AS (SELECT user_id % 10 AS stratum, user_id AS cluster, sum((event_id % 9)::DOUBLE * (event_type = 'click')::INT) AS num, sum((event_id % 9)::DOUBLE) AS den FROM events GROUP BY 1, 2),
        s AS (SELECT stratum, sum(num) AS an, sum(den) AS ad FROM t GROUP BY 1), w AS (SELECT *, ({WEIGHT})::DOUBLE AS w FROM (SELECT *, {U.format(seed='cluster-1', key='cluster')} AS u FROM t, range(200) r(r))),
        k AS (SELECT stratum, r, sum(w * num) AS num, sum(w * den) AS den FROM w GROUP BY 1, 2), m AS (SELECT r, round(sum(CASE WHEN den > 0 THEN num / den ELSE an / ad END * ad) / sum(ad), 12) AS m FROM k JOIN s USING (stratum) GROUP BY 1),
        o AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS i FROM m)
        SELECT (SELECT count(DISTINCT cluster) FROM t) AS n_clusters, round((SELECT sum(an) / sum(ad) FROM s), 6) AS ratio, round(max(m) FILTER (i = 5), 6) AS low, round(max(m) FILTER (i = 194), 6) AS high FROM o""",
    "rolled_back_generations": """WITH g AS (<PROMOTED>), a AS (SELECT *, bool_or(previous AND state IN ('retired', 'ready')) OVER (PARTITION BY tenant_id) AS able FROM g)
        SELECT tenant_id, generation_id, CASE WHEN able AND previous THEN 'active' WHEN able AND state = 'active' THEN 'ready' ELSE state END AS state, CASE WHEN able THEN state = 'active' ELSE previous END AS previous FROM a""",
    "generation_lifecycles": """WITH a AS (SELECT l_orderkey AS generation_id, l_linenumber AS seq, ['stage', 'validate', 'promote', 'retire', 'rollback', 'fail', 'abandon'][(l_linenumber * 2 + l_partkey) % 7 + 1] AS action FROM lineitem),
        t(action, a, b) AS (VALUES <TRANSITIONS>), l AS (SELECT generation_id, list({'s': NULL::VARCHAR, 'x': action, 'r': 0::BIGINT} ORDER BY seq, action) AS xs FROM a GROUP BY 1), m AS (SELECT map_from_entries(list((action || '|' || a, b))) AS m FROM t),
        e AS (SELECT generation_id, list_reduce(list_prepend({'s': 'building', 'x': NULL::VARCHAR, 'r': 0::BIGINT}, xs), lambda s, x: {'s': coalesce(m[x.x || '|' || s.s], s.s), 'x': x.x, 'r': s.r + (m[x.x || '|' || s.s] IS NULL)::BIGINT}) AS e FROM l, m)
        SELECT generation_id, e.s AS state, e.r AS refused FROM e""".replace("<TRANSITIONS>", ", ".join(f"('{x}', '{a}', '{b}')" for x, ways in governance.TRANSITIONS.items() for a, b in ways.items())),
    "replayed_outbox": """WITH o AS (<OPERATIONS>), n AS (SELECT tenant_id, sequence, unnest(sources) AS source FROM o WHERE NOT completed), l AS (SELECT tenant_id, source, max(sequence) AS sequence FROM n GROUP BY 1, 2),
        c AS (SELECT tenant_id, sequence, unnest(chunks) AS c FROM o WHERE NOT completed AND kind = 'index')
        SELECT doc_id % 20 AS tenant_id, 'd' || doc_id AS id, 's' || (doc_id % 60) AS source, md5(coalesce(text, '')) AS text FROM documents WHERE (doc_id % 20, 's' || (doc_id % 60)) NOT IN (SELECT (tenant_id, source) FROM l)
        UNION ALL SELECT c.tenant_id, c.c.id, c.c.source, c.c.text FROM c JOIN l ON l.tenant_id = c.tenant_id AND l.sequence = c.sequence AND l.source = c.c.source""",
    "erased_operations": """WITH o AS (<OPERATIONS>), g AS (SELECT tenant_id, list(DISTINCT source) AS gone FROM (SELECT user_id % 20 AS tenant_id, unnest(['s' || (user_id % 20), 's' || (user_id % 20 % 7)]) AS source FROM events) GROUP BY 1),
        j AS (SELECT o.*, gone, list_distinct(list_concat(coalesce(sources, []), [c.source FOR c IN chunks])) AS named FROM o LEFT JOIN g USING (tenant_id)),
        k AS (SELECT *, NOT completed AND gone IS NOT NULL AND list_has_any(named, gone) AS hit, [x FOR x IN CASE WHEN len(sources) > 0 THEN sources ELSE named END IF NOT list_contains(gone, x)] AS kept FROM j)
        SELECT tenant_id, operation_id, CASE WHEN hit AND len(kept) = 0 THEN NULL ELSE array_to_string(list_sort(CASE WHEN hit THEN kept ELSE sources END), ',') END AS sources,
          CASE WHEN hit AND len(kept) = 0 THEN NULL ELSE array_to_string([c.id FOR c IN chunks IF NOT hit OR NOT list_contains(gone, c.source)], ',') END AS chunks, completed OR (hit AND len(kept) = 0) AS completed FROM k""",
    "validated_generations": """WITH e AS (SELECT doc_id % 40 AS generation_id, doc_id, md5(coalesce(text, '')) AS s FROM documents), a AS (SELECT generation_id, doc_id, CASE WHEN doc_id % 200 = 5 THEN 'x' ELSE s END AS s FROM e WHERE generation_id > 3 OR doc_id % 3 <> 1)
        SELECT e.generation_id, count(*) FILTER (a.doc_id IS NULL) AS missing, 0::BIGINT AS extra, count(*) FILTER (a.s <> e.s) AS changed, CASE WHEN count(*) FILTER (a.doc_id IS NULL OR a.s <> e.s) = 0 THEN 'ready' ELSE 'failed' END AS state FROM e LEFT JOIN a USING (doc_id) GROUP BY 1""",
    "appended_operations": """WITH o AS (SELECT user_id % 20 AS tenant_id, 'op' || event_id % 700 AS operation_id, min(event_id) AS sequence, min(event_type) AS payload, bool_or(event_id % 5 = 0) AS completed FROM events GROUP BY 1, 2), n AS (SELECT user_id % 25 AS tenant_id, 'op' || event_id % 900 AS operation_id, min(event_type) AS payload FROM events GROUP BY 1, 2),
        f AS (SELECT * FROM n WHERE (tenant_id, operation_id) NOT IN (SELECT tenant_id, operation_id FROM o)), l AS (SELECT tenant_id, max(sequence) AS last FROM o GROUP BY 1), d AS (SELECT DISTINCT user_id % 25 AS tenant_id, 'op' || event_id % 900 AS operation_id FROM events WHERE event_id % 9 = 0),
        u AS (SELECT * FROM o UNION ALL SELECT tenant_id, operation_id, coalesce(last, -1) + row_number() OVER (PARTITION BY tenant_id ORDER BY operation_id), payload, false FROM f LEFT JOIN l USING (tenant_id))
        SELECT tenant_id, operation_id, sequence, payload, completed OR (tenant_id, operation_id) IN (SELECT tenant_id, operation_id FROM d) AS completed FROM u""",
    "carried_rows": "SELECT 'd/' || doc_id AS uri, md5(coalesce(text, '')) AS sha256, 'next' AS generation_id FROM documents WHERE md5(coalesce(text, ''))[1] < '8'",
    "cached_extractions": "WITH d AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS v FROM documents) SELECT id, CASE WHEN v % 3 = 0 THEN NULL ELSE v END AS value FROM d",
    "bundle_round_trip": "SELECT o_custkey % 200 AS tenant_id, 'c' || o_orderkey AS calibration_id, o_orderkey % 5 <> 0 AS certified FROM orders WHERE o_custkey % 200 <> 7",
    "bootstrap_interval": f"WITH {_boot(D, 'event_type')} SELECT g AS event_type, n_units, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM boot",
    "sign_flip_p": f"WITH f AS (SELECT event_type, r, CASE WHEN u < 0.5 THEN delta ELSE -delta END AS f, delta FROM (SELECT *, {U.format(seed='flip-1', key='unit')} AS u FROM {D}, range(200) t(r))), s AS (SELECT event_type, r, abs(round(sum(f), 9)) >= abs(round(sum(delta), 9)) AS far FROM f GROUP BY 1, 2) SELECT event_type, round((count(*) FILTER (far) + 1) / 201.0::DOUBLE, 6) AS p FROM s GROUP BY 1",
    "sign_test": f"WITH {SIGNS} SELECT event_type, ups, downs, round(p, 6) AS p FROM st",
    "wilcoxon_signed_rank": """WITH e AS (SELECT event_type, (event_id % 23)::DOUBLE - 9 AS d FROM events WHERE event_id % 23 <> 9), r AS (SELECT event_type, d, rank() OVER (PARTITION BY event_type ORDER BY abs(d)) + (count(*) OVER (PARTITION BY event_type, abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY event_type, abs(d))::DOUBLE AS t FROM e),
        s AS (SELECT event_type, count(*)::DOUBLE AS n, sum(rk) FILTER (d > 0)::DOUBLE AS w, sum(t * t - 1) AS ties FROM r GROUP BY 1) SELECT event_type, n::BIGINT AS n, round(w, 3) AS w, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM s""",
    "partial_correlations": """WITH d AS (SELECT n_chars AS z, (doc_id % 101)::DOUBLE + n_chars / 5000 AS x, (doc_id % 37)::DOUBLE + n_chars / 9000 AS y FROM documents WHERE text IS NOT NULL AND n_chars > 0), r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0::DOUBLE AS rz FROM d),
        c AS (SELECT corr(x, y) AS p, corr(rx, ry) AS xy, corr(rx, rz) AS xz, corr(ry, rz) AS yz FROM r) SELECT round(p, 6) AS pearson, round(xy, 6) AS spearman, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM c""",
    "promotion_gate": f"""WITH {SIGNS}, h AS (SELECT event_type, max(least(1.0, p * (k - i + 1))) OVER (ORDER BY i) AS adjusted FROM (SELECT *, row_number() OVER (ORDER BY p, event_type) AS i, count(*) OVER () AS k FROM st)), dl AS (SELECT event_type, avg(delta) AS d FROM {D} GROUP BY 1),
        {_boot(f"(SELECT unit, avg(delta) AS delta, 1 AS a FROM {D} GROUP BY unit)", 'a')}
        SELECT 'macro interval does not clear zero' AS failure FROM boot WHERE low <= 0 UNION ALL SELECT event_type || ' regresses by more than two points' FROM dl WHERE d < -0.02
        UNION ALL SELECT 'no improving corpus is significant' WHERE NOT EXISTS (FROM dl JOIN h USING (event_type) WHERE adjusted < 0.05 AND d > 0)""",
}.items()}
_DUCK_OPERATIONS = OPERATIONS.replace("{events}", "events").replace("array_distinct(array(", "list_distinct(list_value(").replace("array(named_struct(", "list_value(named_struct(")
for _x in ("replayed_outbox", "erased_operations"):
    ORACLES[_x] = ORACLES[_x].replace("<OPERATIONS>", _duck(_DUCK_OPERATIONS))
ORACLES["rolled_back_generations"] = ORACLES["rolled_back_generations"].replace("<PROMOTED>", ORACLES["promoted_generations"])
