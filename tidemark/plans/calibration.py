"""Threshold fitting and its checks over samples derived from ``labels`` and ``events``.

A sample is a labelled document: answerable if its quality is 1, with a score made of its id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.stats import confidence
from tidemark.operators import calibration, evaluation
from tidemark.sources import tables

SAMPLES = """SELECT doc_id AS id, quality = 1 AS label, toxic = 1 AS toxic, CASE WHEN doc_id % 41 = 0 THEN NULL ELSE
 CAST((doc_id * 7919) % 1000 AS DOUBLE) / 2000 + CASE WHEN quality = 1 THEN 0.4 ELSE 0.0 END END AS score FROM {labels} WHERE quality IS NOT NULL"""
BASE = f"samples AS ({SAMPLES.format(labels='labels')}), s AS (SELECT * FROM samples WHERE score IS NOT NULL)"


def samples(spark, sf):
    return spark.sql(SAMPLES, labels=tables.table(spark, sf, "labels"))


def _scored(spark, sf):
    return samples(spark, sf).where("score is not null")


def calibrate_threshold(spark, sf):
    got = calibration.fit(_scored(spark, sf))
    return got.select("threshold", F.round("scale", 4).alias("scale"), "n_pos", "n_neg", *[F.round(c, 6).alias(c) for c in ("auc", "auc_low", "auc_high")], "certified")


FIT = f"""WITH {BASE}, r AS (SELECT label, score, row_number() OVER (PARTITION BY label ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM s),
b AS (SELECT max(score) FILTER (label AND i = least(n - 1, floor(0.05 * n))) AS f, max(score) FILTER (NOT label AND i = least(n - 1, floor(0.95 * n))) AS c FROM r),
q AS (SELECT quantile_cont(score, 0.25) FILTER (label) AS q25, quantile_cont(score, 0.75) FILTER (NOT label) AS q75, count(*) FILTER (label) AS a, count(*) FILTER (NOT label) AS u FROM s),
k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s),
auc AS (SELECT (sum(rk) FILTER (label) - a * (a + 1) / 2.0) / (a * u) AS auc, a, u FROM k, q GROUP BY a, u),
v AS (SELECT auc, a, u, 1.96 * sqrt(greatest(0, (auc * (1 - auc) + (a - 1) * (auc / (2 - auc) - auc * auc) + (u - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (a * u))) AS half FROM auc)
SELECT floor((f + c) / 2 * 1000) / 1000 AS threshold, round(greatest((q25 - q75) / 4, 0.01), 4) AS scale, v.a AS n_pos, v.u AS n_neg, round(auc, 6) AS auc,
 round(greatest(0.0, auc - half), 6) AS auc_low, round(least(1.0, auc + half), 6) AS auc_high, CASE WHEN least(v.a, v.u) < 20 THEN false ELSE greatest(0.0, auc - half) >= 0.9 END AS certified FROM b, q, v"""


def separability(spark, sf):
    """Area under the curve of the toxic label, by rank sums."""
    return calibration.auc(_scored(spark, sf).withColumn("label", F.col("toxic"))).select("n_pos", "n_neg", F.round("auc", 6).alias("auc"))


def error_rates(spark, sf):
    got = calibration.error_rates(_scored(spark, sf), 0.45)
    return got.select("confirmed", "false_abstain", "false_confirm", "abstained", F.round("false_abstain_rate", 6).alias("false_abstain_rate"), F.round("false_confirm_rate", 6).alias("false_confirm_rate"))


STEPS = [i / 20 for i in range(2, 18, 2)]


def threshold_sweep(spark, sf):
    got = calibration.threshold_sweep(samples(spark, sf), STEPS)
    return got.select("threshold", *[F.round(c, 6).alias(c) for c in ("abstained", "false_abstain", "separation")])


def best_separation(spark, sf):
    """The threshold with the largest Youden index of the sweep; ties to the smaller one."""
    best = F.max_by(F.struct("threshold", "separation"), F.struct(F.round("separation", 9), -F.col("threshold"))).alias("b")
    return calibration.threshold_sweep(samples(spark, sf), STEPS).agg(best).select("b.threshold", F.round("b.separation", 6).alias("separation"))


def leave_one_out(spark, sf):
    return calibration.leave_one_out(_scored(spark, sf)).select(F.round("false_abstain", 6).alias("false_abstain"), F.round("false_confirm", 6).alias("false_confirm"))


LOO = f"""WITH {BASE}, r AS (SELECT id, label, score, row_number() OVER (PARTITION BY label ORDER BY score, id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM s),
pos AS (SELECT x.id, (SELECT score FROM r y WHERE y.label AND y.i = CASE WHEN x.i <= least(x.n - 2, floor(0.05 * (x.n - 1))) THEN least(x.n - 2, floor(0.05 * (x.n - 1))) + 1 ELSE least(x.n - 2, floor(0.05 * (x.n - 1))) END) AS f FROM r x WHERE x.label),
neg AS (SELECT x.id, (SELECT score FROM r y WHERE NOT y.label AND y.i = CASE WHEN x.i <= least(x.n - 2, floor(0.95 * (x.n - 1))) THEN least(x.n - 2, floor(0.95 * (x.n - 1))) + 1 ELSE least(x.n - 2, floor(0.95 * (x.n - 1))) END) AS c FROM r x WHERE NOT x.label),
w AS (SELECT max(score) FILTER (label AND i = least(n - 1, floor(0.05 * n))) AS f, max(score) FILTER (NOT label AND i = least(n - 1, floor(0.95 * n))) AS c FROM r)
SELECT round(avg((r.score < floor((pos.f + w.c) / 2 * 1000) / 1000)::INT) FILTER (r.label), 6) AS false_abstain,
 round(avg((r.score >= floor((w.f + neg.c) / 2 * 1000) / 1000)::INT) FILTER (NOT r.label), 6) AS false_confirm FROM r LEFT JOIN pos USING (id) LEFT JOIN neg USING (id), w"""


def quantiles_by_index(spark, sf):
    events = tables.table(spark, sf, "events").where("value is not null")
    low = calibration.quantile_by_index(events, ["event_type"], "value", 0.05, "q05")
    high = calibration.quantile_by_index(events, ["event_type"], "value", 0.95, "q95")
    return low.join(high, "event_type")


def latency_percentiles(spark, sf):
    """Nearest-rank percentiles of each event type."""
    events = tables.table(spark, sf, "events").where("value is not null")
    parts = [calibration.nearest_rank(events, ["event_type"], "value", q, f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)]
    return parts[0].join(parts[1], "event_type").join(parts[2], "event_type")


def calibrated_confidence(spark, sf):
    return _scored(spark, sf).select("id", F.round(confidence(F.col("score"), F.lit(0.45), F.lit(0.05)), 6).alias("confidence"))


def score_distribution(spark, sf):
    scored = _scored(spark, sf)
    sums = scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.expr(e), 6).alias(c) for c, e in (("low", "min(score)"), ("high", "max(score)"), ("mean", "avg(score)"))])
    median = calibration.inclusive_quantile(scored, ["label"], "score", 0.5, "median")
    return sums.join(median, "label").select("label", "n", "low", F.round("median", 6).alias("median"), "high", "mean")


def abstention_rates(spark, sf):
    """Share of labelled documents under the threshold by source, with Wilson intervals."""
    docs = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    flags = _scored(spark, sf).join(docs, "id").withColumn("flag", F.col("score") < 0.45)
    got = evaluation.rates(flags, ["source"], "flag")
    return got.select("source", "n", *[F.round(c, 6).alias(c) for c in ("rate", "low", "high")])


WILSON = f"""WITH {BASE}, c AS (SELECT d.source, count(*) AS n, count(*) FILTER (score < 0.45) AS y FROM s JOIN documents d ON d.doc_id = s.id GROUP BY 1),
z AS (SELECT *, 1.959963984540054 AS z, y::DOUBLE / n AS p FROM c)
SELECT source, n, round(p, 6) AS rate, round(greatest(0.0, ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS low,
 round(least(1.0, ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS high FROM z"""


def drift_states(spark, sf):
    """The drift verdict of monitoring rows made of events."""
    rows = tables.table(spark, sf, "events").selectExpr("event_id", "case when event_id % 9 = 0 then null else cast(event_id % 13 as double) / 100 end as delta", "event_id % 4 <> 0 as ok", "event_id % 3 <> 0 as probed", "event_id % 17 = 0 as failed")
    return rows.groupBy(calibration.drift_verdict(F.col("delta"), F.col("ok"), F.col("probed"), F.col("failed")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    calibrate_threshold, separability, error_rates, threshold_sweep, best_separation, leave_one_out, quantiles_by_index, latency_percentiles,
    calibrated_confidence, score_distribution, abstention_rates, drift_states,
)}
SWEEP = f"WITH {BASE}, t AS (SELECT unnest({STEPS}::DOUBLE[]) AS threshold), w AS (SELECT threshold, avg(coalesce(score < threshold, true)::INT) FILTER (NOT label) AS abstained, avg(coalesce(score < threshold, true)::INT) FILTER (label) AS false_abstain FROM samples, t GROUP BY 1)"
ORACLES = {
    "calibrate_threshold": FIT,
    "separability": f"WITH {BASE}, k AS (SELECT toxic, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s), c AS (SELECT count(*) FILTER (toxic) AS a, count(*) FILTER (NOT toxic) AS u, sum(rk) FILTER (toxic) AS t FROM k) SELECT a AS n_pos, u AS n_neg, round((t - a * (a + 1) / 2.0) / (a * u), 6) AS auc FROM c",
    "error_rates": f"WITH {BASE} SELECT count(*) FILTER (label AND score >= 0.45) AS confirmed, count(*) FILTER (label AND score < 0.45) AS false_abstain, count(*) FILTER (NOT label AND score >= 0.45) AS false_confirm, count(*) FILTER (NOT label AND score < 0.45) AS abstained, round(avg((score < 0.45)::INT) FILTER (label), 6) AS false_abstain_rate, round(avg((score >= 0.45)::INT) FILTER (NOT label), 6) AS false_confirm_rate FROM s",
    "threshold_sweep": f"{SWEEP} SELECT threshold, round(abstained, 6) AS abstained, round(false_abstain, 6) AS false_abstain, round(abstained - false_abstain, 6) AS separation FROM w",
    "best_separation": f"{SWEEP} SELECT threshold, round(abstained - false_abstain, 6) AS separation FROM w ORDER BY round(abstained - false_abstain, 9) DESC, threshold LIMIT 1",
    "leave_one_out": LOO,
    "quantiles_by_index": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(value) FILTER (i = least(n - 1, floor(0.05 * n))) AS q05, max(value) FILTER (i = least(n - 1, floor(0.95 * n))) AS q95 FROM r GROUP BY 1",
    "latency_percentiles": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(value) FILTER (i = ceil(0.5::DOUBLE * n) - 1) AS p50, max(value) FILTER (i = ceil(0.95::DOUBLE * n) - 1) AS p95, max(value) FILTER (i = ceil(0.99::DOUBLE * n) - 1) AS p99 FROM r GROUP BY 1",
    "calibrated_confidence": f"WITH {BASE} SELECT id, round(1 / (1 + exp(-greatest(-60, least(60, (score - 0.45::DOUBLE) / 0.05::DOUBLE)))), 6) AS confidence FROM s",
    "score_distribution": f"WITH {BASE} SELECT label, count(*) AS n, round(min(score), 6) AS low, round(quantile_cont(score, 0.5), 6) AS median, round(max(score), 6) AS high, round(avg(score), 6) AS mean FROM s GROUP BY 1",
    "abstention_rates": WILSON,
    "drift_states": """WITH r AS (SELECT event_id AS e, CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id % 13) / 100.0 END AS delta FROM events)
        SELECT CASE WHEN delta IS NULL THEN 'unknown' WHEN delta < 0.05 THEN 'stable' WHEN e % 17 = 0 OR e % 4 = 0 THEN 'recalibration_required' WHEN e % 3 = 0 THEN 'recalibration_recommended' ELSE 'stable' END AS verdict, count(*) AS n FROM r GROUP BY 1""",
}
