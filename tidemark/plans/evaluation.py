"""Evaluation queries: vectors of one label are relevant to each other; documents, labels and turns give the rest."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import calibration, evaluation, retrieval
from tidemark.plans.retrieval import LEX, TEXT, _asked, _docs, _legs, _vector_queries, _vectors, text_index
from tidemark.sources import tables


#: Dimensions of the ablation's second arm.
HALF = 32


def _ranking(spark, sf, k=20):
    """Ranking of each query vector over all other vectors."""
    hits = retrieval.dense_topk(_vectors(spark, sf), _vector_queries(spark, sf), k + 1).where("id <> query_id")
    return retrieval.top_k(hits.select("query_id", "id", "score"), k)


def _relevant(spark, sf, ranking):
    """The ranked ids of a query's label, and how many others have it: class counts, not the pairs of a class."""
    rows = _vectors(spark, sf).select("id", "label")
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "label")
    ranked = ranking.select("query_id", "id").join(asked, "query_id").join(rows.withColumnRenamed("label", "other"), "id").where("label = other").select("query_id", "id")
    sizes = rows.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_rel"))
    return ranked, asked.join(sizes, "label").select("query_id", "n_rel")


RANKING = """p AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0),
 ranking AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p WHERE id <> query_id QUALIFY rank <= 20),
 rel AS (SELECT q.vec_id AS query_id, c.vec_id AS id FROM embeddings q JOIN embeddings c USING (label) WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)"""


def ranking_metrics(spark, sf):
    ranking = _ranking(spark, sf)
    relevant, wanted = _relevant(spark, sf, ranking)
    got = evaluation.ranking_metrics(ranking, relevant, 10, wanted)
    return got.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


def mean_metrics_by_arm(spark, sf):
    """The ablation: means of each arm; the second arm compares the first half of the dimensions."""
    cut = F.slice("vector", 1, HALF).alias("vector")
    half = retrieval.dense_topk(_vectors(spark, sf).select("id", cut), _vector_queries(spark, sf).select("query_id", cut), 21).where("id <> query_id")
    arms = {"all": _ranking(spark, sf), "half": retrieval.top_k(half.select("query_id", "id", "score"), 20)}
    judged = {a: (r, *_relevant(spark, sf, r)) for a, r in arms.items()}
    parts = [evaluation.ranking_metrics(r, rel, 10, wanted).withColumn("arm", F.lit(a)) for a, (r, rel, wanted) in judged.items()]
    return parts[0].unionByName(parts[1]).groupBy("arm").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


def hits_at_depths(spark, sf):
    ranking = _ranking(spark, sf)
    relevant, wanted = _relevant(spark, sf, ranking)
    return evaluation.hits_at(ranking, relevant, [1, 3, 5, 10, 20], wanted).select("depth", "n", F.round("hit_rate", 6).alias("hit_rate"))


def evidence_coverage(spark, sf):
    ranking = _ranking(spark, sf)
    relevant, wanted = _relevant(spark, sf, ranking)
    got = evaluation.evidence_coverage(ranking, relevant, [5, 20], wanted)
    return got.select("depth", *[F.round(c, 6).alias(c) for c in ("any", "all", "fraction")])


def spearman_quality(spark, sf):
    """Length against share of distinct words of documents, by ranks."""
    from tidemark.functions.text import tokens

    words = tokens(F.col("text"))
    rows = _docs(spark, sf).select(F.size(words).alias("n"), (F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))).alias("share"))
    return evaluation.spearman(rows.where("n > 0"), "n", "share").select("n", F.round("rho", 6).alias("rho"))


def holm_adjusted(spark, sf):
    """Each event type against a share of one half, adjusted."""
    paired = tables.table(spark, sf, "events").select("event_type", (F.col("event_id") % 2 == 0).alias("a"), (F.col("event_id") % 5 < 2).alias("b"))
    tests = evaluation.mcnemar(paired, ["event_type"]).select(F.col("event_type").alias("name"), "p")
    return evaluation.holm(tests).select("name", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


def mcnemar_exact(spark, sf):
    paired = tables.table(spark, sf, "events").select("event_type", (F.col("event_id") % 2 == 0).alias("a"), (F.col("event_id") % 5 < 2).alias("b"))
    return evaluation.mcnemar(paired, ["event_type"]).select("event_type", "only_a", "only_b", F.round("p", 6).alias("p"))


MCNEMAR = """c AS (SELECT event_type, count(*) FILTER (event_id % 2 = 0 AND event_id % 5 >= 2) AS only_a, count(*) FILTER (event_id % 2 <> 0 AND event_id % 5 < 2) AS only_b FROM events GROUP BY 1),
 b AS (SELECT c.only_a, c.only_b, c.event_type, exp(lgamma(only_a + only_b + 1.0) - lgamma(i + 1.0) - lgamma(only_a + only_b - i + 1.0) - (only_a + only_b) * ln(2.0)) AS term FROM (SELECT c.*, unnest(range(least(only_a, only_b) + 1)) AS i FROM c) c),
 m AS (SELECT event_type, only_a, only_b, least(1.0, 2 * sum(term)) AS p FROM b GROUP BY ALL)"""


def token_f1(spark, sf):
    """Each assistant turn against the turn before it."""
    order = W.partitionBy("conv_id").orderBy("turn")
    turns = tables.table(spark, sf, "conversations").withColumn("gold", F.lag("text").over(order)).withColumn("before", F.lag("turn").over(order))
    pairs = turns.where("role = 'assistant' and before is not null").select("conv_id", "turn", F.col("text").alias("prediction"), "gold")
    return evaluation.token_f1(pairs).select("conv_id", "turn", F.round("f1", 6).alias("f1"))


F1 = r"""WITH t AS (SELECT *, lag(text) OVER w AS gold, lag(turn) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), c AS (SELECT conv_id, turn, text, gold FROM t WHERE role = 'assistant' AND before IS NOT NULL),
 w AS (SELECT conv_id, turn, 0 AS side, unnest(string_split_regex(regexp_replace(lower(gold), '[!-/:-@\[-`{-~]', '', 'g'), '\s+')) AS t FROM c UNION ALL SELECT conv_id, turn, 1, unnest(string_split_regex(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+')) FROM c),
 n AS (SELECT conv_id, turn, side, t, count(*) AS n FROM w WHERE t NOT IN ('', 'a', 'an', 'the') GROUP BY ALL), s AS (SELECT conv_id, turn, sum(n) FILTER (side = 0) AS g, sum(n) FILTER (side = 1) AS p FROM n GROUP BY ALL),
 o AS (SELECT a.conv_id, a.turn, sum(least(a.n, b.n)) AS x FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.t = b.t AND a.side = 0 AND b.side = 1 GROUP BY ALL)
 SELECT c.conv_id, c.turn, round(CASE WHEN coalesce(g, 0) = 0 OR coalesce(p, 0) = 0 THEN (coalesce(g, 0) = coalesce(p, 0))::INT::DOUBLE ELSE 2.0::DOUBLE * coalesce(x, 0) / (g + p) END, 6) AS f1 FROM c LEFT JOIN s USING (conv_id, turn) LEFT JOIN o USING (conv_id, turn)"""


def vocabulary_overlap(spark, sf):
    return evaluation.vocabulary_overlap(text_index(spark, sf).dictionary.where("term not like '#%'"), _asked(spark, sf))


def _supported(spark, sf):
    index = text_index(spark, sf)
    return evaluation.rare_term_support(index.terms, index.stats.first()["n_docs"], _asked(spark, sf), 0.02)


def rare_term_support(spark, sf):
    return _supported(spark, sf)


def pool_ceiling(spark, sf):
    """Documents that hold a rare word of an item: how many of them the two legs' first ten reach together."""
    got = evaluation.pool_ceiling([leg.where("rank <= 10") for leg in _legs(spark, sf)], _supported(spark, sf).select("query_id", "id"))
    return got.withColumn("ceiling", F.round("ceiling", 6))


def nearest_other(spark, sf):
    """Crowding: each query vector's nearest other vector, and the mean by label."""
    best = _ranking(spark, sf).where("rank = 1").join(_vectors(spark, sf).select(F.col("id").alias("query_id"), "label"), "query_id")
    return best.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("crowding"))


def headroom_by_label(spark, sf):
    rows = _vectors(spark, sf).groupBy("label").agg(F.avg((F.col("id") % 3 == 0).cast("double")).alias("local"), F.avg((F.col("id") % 3 != 1).cast("double")).alias("best"))
    return rows.select("label", F.round(evaluation.headroom(F.col("local"), F.col("best")), 6).alias("captured"))


def outcome_summary(spark, sf):
    """Accuracy and abstention by event type, with a total row."""
    rows = tables.table(spark, sf, "events").select("event_type", (F.col("value") > 20).alias("correct"), (F.col("event_id") % 10 == 0).alias("abstained"), F.length("props").alias("context"))
    return rows.rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"), F.round(F.avg(F.col("abstained").cast("double")), 6).alias("abstention"), F.round(F.avg("context"), 6).alias("mean_context"))


def duplicate_questions(spark, sf):
    asked = _asked(spark, sf)
    rows = asked.select((F.col("query_id") % 30).alias("question_id")).union(asked.select(F.col("query_id")))
    return rows.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def stratified_sample(spark, sf):
    """Three documents of each language, by a hash: the sample is the feature."""
    docs = tables.table(spark, sf, "documents").where("lang is not null").select("lang", "doc_id")
    return evaluation.stratified(docs, "lang", "doc_id", 3, "s1")


def threshold_rules(spark, sf):
    """Rules over a query's score list: absolute, share under the maximum, and gap of maximum to median."""
    scores = _ranking(spark, sf).groupBy("query_id").agg(F.max("score").alias("top"), F.expr("percentile(score, 0.5)").alias("median"), F.collect_list("score").alias("all"))
    under = F.size(F.filter("all", lambda s: s < F.col("top"))) / F.size("all")
    return scores.select("query_id", (F.col("top") >= 0.5).alias("absolute"), (under >= 0.9).alias("percentile"), (F.round((F.col("top") - F.col("median")) / F.col("top"), 9) >= 0.1).alias("gap"))


def nugget_coverage(spark, sf):
    """For k = 1, 3, 10: mean and least over query vectors of the best score in the first k."""
    best = _ranking(spark, sf).select("query_id", "score", "rank", F.explode(F.array(F.lit(1), F.lit(3), F.lit(10))).alias("k")).where("rank <= k").groupBy("k", "query_id").agg(F.max("score").alias("best"))
    return best.groupBy("k").agg(F.round(F.avg("best"), 6).alias("mean_best"), F.round(F.min("best"), 6).alias("least_best"))


def pool_quartiles(spark, sf):
    pools = tables.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("size"))
    return calibration.quantile_by_index(pools, [], "size", 0.25, "q1").join(calibration.quantile_by_index(pools, [], "size", 0.5, "q2"))


def oov_rates(spark, sf):
    """Words of each language's documents that a vocabulary of the benchmark's word beginnings and middles cuts in two
    or more."""
    words = tables.table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(evaluation.WORD), F.lit(0))).alias("w")).distinct()
    starts = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.col("w").substr(F.lit(1), k))).alias("piece"))
    places = words.where(F.length("w") > 1).select("w", F.explode(F.sequence(F.lit(2), F.length("w"))).alias("j")).select("w", "j", F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.length("w") - F.col("j") + 1))).alias("k"))
    middles = places.select(F.concat(F.lit("##"), F.col("w").substr(F.col("j"), F.col("k"))).alias("piece"))
    docs = tables.table(spark, sf, "documents").select("lang", F.col("doc_id").alias("id"), "text")
    return evaluation.oov_rates(docs, "lang", starts.union(middles)).withColumn("rate", F.round("rate", 6))


OOV = r"""WITH RECURSIVE bw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark),
v AS (SELECT substr(w, 1, k) AS piece FROM bw, range(1, 6) t(k) UNION SELECT '##' || substr(w, j, k) FROM bw, range(2, 200) a(j), range(1, 4) b(k) WHERE j + k <= length(w) + 1),
t AS (SELECT DISTINCT lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS word FROM documents),
d AS (SELECT DISTINCT word FROM t WHERE length(word) <= 100),
m AS (SELECT word, place, max(size) AS size FROM (SELECT word, place, size, CASE WHEN place > 1 THEN '##' ELSE '' END || substr(word, place, size) AS piece FROM d, range(1, 101) a(place), range(1, 25) b(size) WHERE place + size <= length(word) + 1) JOIN v USING (piece) GROUP BY 1, 2),
w AS (SELECT word, 1::BIGINT AS place, 0 AS n FROM d UNION ALL SELECT w.word, w.place + m.size, n + 1 FROM w JOIN m ON m.word = w.word AND m.place = w.place),
p AS (SELECT word, n AS pieces FROM w WHERE place = length(word) + 1)
SELECT lang, count(*) AS n_types, round(avg((coalesce(pieces, 0) >= 2)::INT::DOUBLE), 6) AS rate FROM t LEFT JOIN p USING (word) GROUP BY lang"""

QUERIES = {f.__name__: f for f in (
    oov_rates,
    ranking_metrics, mean_metrics_by_arm, hits_at_depths, evidence_coverage, spearman_quality, holm_adjusted, mcnemar_exact, token_f1, vocabulary_overlap, rare_term_support,
    pool_ceiling, nearest_other, headroom_by_label, outcome_summary, duplicate_questions, stratified_sample, threshold_rules, nugget_coverage, pool_quartiles,
)}


def _metrics(ranking: str) -> str:
    return f"""SELECT w.query_id, coalesce(h.hits, 0) / 10.0::DOUBLE AS precision, coalesce(h.hits, 0)::DOUBLE / n AS recall, coalesce(1.0::DOUBLE / h.first, 0) AS mrr,
 coalesce(h.dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= n) AS ndcg
 FROM (SELECT query_id, count(DISTINCT id) AS n FROM rel GROUP BY 1) w LEFT JOIN (SELECT query_id, count(*) FILTER (rank <= 10) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) FILTER (rank <= 10) AS dcg FROM {ranking} JOIN rel USING (query_id, id) GROUP BY 1) h USING (query_id)"""


WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
ORACLES = {
    "oov_rates": OOV,
    "ranking_metrics": f"WITH {RANKING} SELECT query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM ({_metrics('ranking')})",
    "mean_metrics_by_arm": f"WITH {RANKING}, h AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(c.embedding[1:{HALF}]::DOUBLE[], q.embedding[1:{HALF}]::DOUBLE[]), 9) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0), half AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h WHERE id <> query_id QUALIFY rank <= 20) SELECT arm, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM (SELECT 'all' AS arm, * FROM ({_metrics('ranking')}) UNION ALL SELECT 'half', * FROM ({_metrics('half')})) GROUP BY 1",
    "hits_at_depths": f"WITH {RANKING}, f AS (SELECT query_id, min(rank) AS first FROM ranking JOIN rel USING (query_id, id) GROUP BY 1) SELECT d::INT AS depth, count(*) AS n, round(avg(coalesce(first <= d, false)::INT), 6) AS hit_rate FROM (SELECT DISTINCT query_id FROM rel) LEFT JOIN f USING (query_id), (SELECT unnest([1, 3, 5, 10, 20]) AS d) GROUP BY 1",
    "evidence_coverage": f"WITH {RANKING}, s AS (SELECT d, query_id, avg(coalesce(rank <= d, false)::INT) AS share FROM rel LEFT JOIN ranking USING (query_id, id), (SELECT unnest([5, 20]) AS d) GROUP BY 1, 2) SELECT d::INT AS depth, round(avg((share > 0)::INT), 6) AS \"any\", round(avg((share = 1)::INT), 6) AS \"all\", round(avg(share), 6) AS fraction FROM s GROUP BY 1",
    "spearman_quality": f"WITH d AS (SELECT len({WORDS}) AS n, len(list_distinct({WORDS}))::DOUBLE / len({WORDS}) AS s FROM documents WHERE len({WORDS}) > 0), r AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS x, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS y FROM d) SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM r",
    "holm_adjusted": f"WITH {MCNEMAR} SELECT event_type AS name, round(p, 6) AS p, round(max(least(1.0, p * (k - i + 1))) OVER (ORDER BY i), 6) AS adjusted FROM (SELECT *, row_number() OVER (ORDER BY p, event_type) AS i, count(*) OVER () AS k FROM m)",
    "mcnemar_exact": f"WITH {MCNEMAR} SELECT event_type, only_a, only_b, round(p, 6) AS p FROM m",
    "token_f1": F1,
    "vocabulary_overlap": f"WITH t AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS}) AS term FROM benchmark), d AS (SELECT DISTINCT unnest({WORDS}) AS term FROM documents) SELECT query_id, count(*) AS n_terms, count(d.term) AS known FROM t LEFT JOIN d USING (term) GROUP BY 1",
    "rare_term_support": f"WITH t AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS}) AS term FROM benchmark), d AS (SELECT DISTINCT doc_id AS id, unnest({WORDS}) AS term FROM documents), r AS (SELECT term FROM d GROUP BY 1 HAVING count(*) <= 0.02 * (SELECT count(*) FROM documents)) SELECT query_id, id, count(*) AS n FROM d JOIN r USING (term) JOIN t USING (term) GROUP BY ALL",
    "nearest_other": f"WITH {RANKING} SELECT label, count(*) AS n, round(avg(score), 6) AS crowding FROM ranking JOIN embeddings ON vec_id = query_id WHERE rank = 1 GROUP BY 1",
    "headroom_by_label": "WITH l AS (SELECT label, avg((vec_id % 3 = 0)::INT) AS a, avg((vec_id % 3 <> 1)::INT) AS b FROM embeddings GROUP BY 1) SELECT label, round((b - a) / nullif(1 - a, 0), 6) AS captured FROM l",
    "outcome_summary": "SELECT event_type, count(*) AS n, round(avg((value > 20)::INT), 6) AS accuracy, round(avg((event_id % 10 = 0)::INT), 6) AS abstention, round(avg(length(props)), 6) AS mean_context FROM events GROUP BY ROLLUP (event_type)",
    "duplicate_questions": "SELECT q AS question_id, count(*) AS n FROM (SELECT item_id % 30 AS q FROM benchmark UNION ALL SELECT item_id FROM benchmark) GROUP BY 1 HAVING count(*) > 1",
    "stratified_sample": "SELECT lang, doc_id FROM documents WHERE lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('s1|' || doc_id), doc_id) <= 3",
    "threshold_rules": f"WITH {RANKING}, s AS (SELECT query_id, max(score) AS top, quantile_cont(score, 0.5) AS med, list(score) AS xs FROM ranking GROUP BY 1) SELECT query_id, top >= 0.5 AS absolute, len([x FOR x IN xs IF x < top])::DOUBLE / len(xs) >= 0.9 AS percentile, round((top - med) / top, 9) >= 0.1 AS gap FROM s",
    "nugget_coverage": f"WITH {RANKING}, b AS (SELECT k, query_id, max(score) AS best FROM ranking, (SELECT unnest([1, 3, 10])::INT AS k) WHERE rank <= k GROUP BY 1, 2) SELECT k, round(avg(best), 6) AS mean_best, round(min(best), 6) AS least_best FROM b GROUP BY 1",
    "pool_quartiles": "WITH p AS (SELECT count(*) AS s FROM events GROUP BY user_id), r AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM p) SELECT max(s) FILTER (i = floor(0.25 * n)) AS q1, max(s) FILTER (i = floor(0.5 * n)) AS q2 FROM r",
    "pool_ceiling": f"""WITH {TEXT} {LEX}, t AS (SELECT DISTINCT query_id, term FROM qterms), d AS (SELECT DISTINCT id, unnest(words) AS term FROM docs), r AS (SELECT term FROM d GROUP BY 1 HAVING count(*) <= 0.02 * (SELECT count(*) FROM docs)),
        rel AS (SELECT DISTINCT query_id, id FROM d JOIN r USING (term) JOIN t USING (term)), pool AS (SELECT query_id, id FROM bm25 WHERE rank <= 10 UNION SELECT query_id, id FROM lex WHERE rank <= 10)
        SELECT count(*) AS n_relevant, count(p.id) AS found, round(count(p.id)::DOUBLE / nullif(count(*), 0), 6) AS ceiling FROM rel LEFT JOIN pool p USING (query_id, id)""",
}
