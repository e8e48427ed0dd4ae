"""Comparing arms of an evaluation: rankings, trust rules, rings of excised documents, tasks and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.calibration import fit, held_out_thresholds, running_totals
from tidemark.operators.evaluation import ranking_metrics

#: Observations of a label that a latency window holds.
WINDOW = 1024


def by_arm(arms: dict[str, DataFrame], relevant: DataFrame, k: int) -> DataFrame:
    """(arm, precision, recall, mrr, ndcg): means of each arm's ranking metrics."""
    parts = [ranking_metrics(r, relevant, k).withColumn("arm", F.lit(a)) for a, r in arms.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("arm").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


def stale_trust(evaluated: DataFrame, threshold: float) -> DataFrame:
    """(n, plain, recency, trusted, coverage): shares of queries that trust a superseded hit. plain takes the first
    hit; recency the newest of those at the threshold, or the first; trusted any ok hit; coverage has an ok hit."""
    stale = F.col("superseded_by").isNotNull()
    confident = F.col("score") >= threshold
    per = evaluated.groupBy("query_id").agg(
        F.min_by(stale, "pos").alias("plain"),
        F.max_by(F.when(confident, stale), F.when(confident, F.struct("indexed_at", -F.col("pos")))).alias("newest"),
        F.max((stale & (F.col("verdict") == "ok")).cast("int")).alias("trusted"), F.max((F.col("verdict") == "ok").cast("int")).alias("covered"),
    )
    share = lambda c: F.avg(c.cast("double"))
    return per.agg(F.count(F.lit(1)).alias("n"), share(F.col("plain")).alias("plain"), share(F.coalesce("newest", "plain")).alias("recency"), share(F.col("trusted")).alias("trusted"), share(F.col("covered")).alias("coverage"))


def confident_by_arm(evaluated: DataFrame, entailed: Column, by: str) -> DataFrame:
    """(by, arm, n, rate): share of queries that don't abstain, by the threshold, by threshold and judge, and by the
    judge alone (a hit under the threshold counts if it is entailed)."""
    ok, low = F.col("verdict") == "ok", F.col("verdict") == "low_confidence"
    passes = {"threshold": ok, "threshold+entail": ok & entailed, "entail-only": (ok | low) & entailed}
    per = evaluated.groupBy(by, "query_id").agg(*[F.max(p.cast("double")).alias(a) for a, p in passes.items()])
    arms = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"`{a}`").alias("yes")) for a in passes])).alias("a")
    return per.select(by, arms).groupBy(by, F.col("a.arm").alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.avg("a.yes").alias("rate"))


def near_misses(queries: DataFrame) -> DataFrame:
    """(arm, near_miss_fcr, gap_fcr, false_abstain) of ``queries`` (kind, score, entailed), kind being answerable, gap or
    near_miss and score the best hit's.

    Near misses challenge a threshold that they never tune. Gaps and answerable queries do tune it, so each is judged
    at the threshold fitted without it. The arms trust a hit by the threshold, by threshold and judge, or by the judge.
    """
    fitted = queries.where("kind <> 'near_miss' and score is not null").select((F.col("kind") == "answerable").alias("label"), "score")
    folds = held_out_thresholds(fitted).select(F.when(F.col("label"), "answerable").otherwise("gap").alias("kind"), "score", "threshold")
    whole = fit(fitted).select(F.col("threshold").alias("_whole"))  # one row
    judged = queries.join(folds, ["kind", "score"], "left").join(F.broadcast(whole)).withColumn("cut", F.when(F.col("kind") == "near_miss", F.col("_whole")).otherwise(F.col("threshold")))
    over = F.coalesce(F.col("score") >= F.col("cut"), F.lit(False))
    passes = {"threshold": over, "threshold+entail": over & F.col("entailed"), "entail-only": F.col("entailed")}
    each = judged.select("kind", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), p.alias("yes")) for a, p in passes.items()])).alias("a")).select("kind", "a.arm", "a.yes")
    share = lambda kind, wrong: F.avg(F.when(F.col("kind") == kind, (F.col("yes") == wrong).cast("double")))
    return each.groupBy("arm").agg(share("near_miss", True).alias("near_miss_fcr"), share("gap", True).alias("gap_fcr"), share("answerable", False).alias("false_abstain"))


def held_out_arms(arms: dict[str, DataFrame], relevant: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(arm, n, hit_rate, mrr) of rankings (query_id, id, rank) over the held half of ``questions`` (query_id): every
    second one in order, as far as something is relevant to it; the other half is for fitting."""
    placed = running_totals(questions.groupBy("query_id").agg(F.count(F.lit(1)).alias("times")), [], "query_id", {"at": "times"})
    held = placed.where("at % 2 = 1").select("query_id").join(relevant.select("query_id").distinct(), "query_id")
    named = reduce(DataFrame.unionByName, [r.select("query_id", "id", "rank", F.lit(a).alias("arm")) for a, r in arms.items()])
    first = named.join(relevant.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("arm", "query_id").agg(F.min("rank").alias("first"))
    every = held.select("query_id", F.explode(F.array(*map(F.lit, arms))).alias("arm")).join(first, ["arm", "query_id"], "left")
    return every.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")).alias("hit_rate"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def added_gold(treatment: DataFrame, control: DataFrame, relevant: DataFrame) -> DataFrame:
    """(queries, documents, top5, top10, buried, q1, median, q3): where relevant documents that only the treatment
    finds stand in its ranking; quartiles are values at n // 4, n // 2 and 3 n // 4."""
    gold = treatment.join(relevant.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").join(control.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", (F.col("rank") - 1).alias("place"))
    counts = gold.groupBy("place").agg(F.count(F.lit(1)).alias("times"))  # places are bounded by the depth of a ranking
    placed = counts.withColumn("at", F.coalesce(F.sum("times").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("times").over(W.partitionBy()))
    value = lambda part: F.max(F.when((F.col("at") <= F.floor(part * F.col("n"))) & (F.floor(part * F.col("n")) < F.col("at") + F.col("times")), F.col("place")))
    quartiles = placed.agg(value(0.25).alias("q1"), value(0.5).alias("median"), value(0.75).alias("q3"))
    totals = gold.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("documents"), F.count_if(F.col("place") < 5).alias("top5"), F.count_if(F.col("place") < 10).alias("top10"), F.count_if(F.col("place") >= 10).alias("buried"))
    return totals.join(quartiles)  # one row each


def disagreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(query_id, same_order, n_other): whether the first k agree in order, and how many ids only one of them has."""
    x, y = (r.where(F.col("rank") <= k).select("query_id", "id", F.col("rank").alias(n)) for r, n in ((a, "x"), (b, "y")))
    return x.join(y, ["query_id", "id"], "full").groupBy("query_id").agg(F.min((F.col("x").eqNullSafe(F.col("y"))).cast("int")).cast("boolean").alias("same_order"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("n_other"))


def document_recall(ranking: DataFrame, relevant: DataFrame, file_of: DataFrame, k: int) -> DataFrame:
    """(query_id, n_files, found, exact): files of the relevant chunks, those among the first k, and whether all are."""
    files = lambda df: df.join(file_of, "id").select("query_id", "file").distinct()
    got = files(ranking.where(F.col("rank") <= k)).withColumn("_in", F.lit(1))
    return files(relevant).join(got, ["query_id", "file"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_files"), F.count("_in").alias("found")).withColumn("exact", F.col("found") == F.col("n_files"))


def task_deltas(runs: DataFrame) -> DataFrame:
    """(task, off, on, delta, change) of (task, arm, passed): rates of both arms; tasks with one arm are left out."""
    rates = runs.groupBy("task").agg(*[F.avg(F.when(F.col("arm") == a, F.col("passed").cast("double"))).alias(a) for a in ("off", "on")]).where("off is not null and `on` is not null")
    delta = F.col("on") - F.col("off")
    return rates.withColumn("delta", delta).withColumn("change", F.when(delta > 0, "improved").when(delta < 0, "worsened").otherwise("same"))


def admitted(sessions: DataFrame) -> DataFrame:
    """Sessions (task, arm, ok) of tasks that have both arms, all of whose sessions are ok."""
    both = sessions.groupBy("task").agg(F.count_distinct("arm").alias("arms"), F.min(F.col("ok").cast("int")).alias("all_ok")).where("arms = 2 and all_ok = 1").select("task")
    return sessions.join(both, "task", "left_semi")


def with_negatives(relevant: DataFrame, corpus: DataFrame, n: int, seed: str) -> DataFrame:
    """(id, gold): all relevant ids and the n others with the least hashes: a seeded sample is the feature."""
    gold = relevant.select("id").distinct()
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string")))
    others = corpus.select("id").join(gold, "id", "left_anti").orderBy(key, "id").limit(n)
    return gold.withColumn("gold", F.lit(True)).unionByName(others.withColumn("gold", F.lit(False)))


def rings(ranking: DataFrame, gold: DataFrame, widths: list[int]) -> DataFrame:
    """(query_id, ring, id): documents that ring r excises: the gold ones and the ``widths[r]`` best others."""
    others = ranking.join(gold, ["query_id", "id"], "left_anti").withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    steps = F.array(*[F.struct(F.lit(i).alias("ring"), F.lit(w).alias("width")) for i, w in enumerate(widths)])
    near = others.select("query_id", "id", "nth", F.explode(steps).alias("s")).where("nth <= s.width").select("query_id", F.col("s.ring").alias("ring"), "id")
    core = gold.select("query_id", "id", F.explode(steps).alias("s")).select("query_id", F.col("s.ring").alias("ring"), "id")
    return near.unionByName(core)


def fractional_rings(cluster: DataFrame, gold: DataFrame, fractions: list[float], seed: str | None = None) -> DataFrame:
    """(query_id, ring, id): the gold documents and a share of the other ones of a query's ``cluster`` (query_id, id, rank),
    the first by rank, or by a hash of ``seed`` where it is given. ring is the share in ten-thousandths; a number of
    documents is rounded to the nearest, halves to even."""
    named = gold.select("query_id", "id").distinct()
    by = [F.col("rank")] if seed is None else [F.md5(F.concat_ws("|", F.lit(seed), F.col("query_id").cast("string"), F.col("id").cast("string"))), F.col("id")]
    others = cluster.join(named, ["query_id", "id"], "left_anti").withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy(*by)))
    sizes = others.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    steps = F.array(*[F.struct(F.lit(round(f * 10_000)).alias("ring"), F.lit(float(f)).alias("share")) for f in fractions])
    near = others.join(sizes, "query_id").select("query_id", "id", "nth", "n", F.explode(steps).alias("s")).where(F.col("nth") <= F.bround(F.col("s.share") * F.col("n"))).select("query_id", F.col("s.ring").alias("ring"), "id")
    return near.unionByName(named.select("query_id", F.explode(steps).alias("s"), "id").select("query_id", F.col("s.ring").alias("ring"), "id"))


def ladder_costs(outcomes: DataFrame, by: str, weights: list[float]) -> DataFrame:
    """(by, weight, correct_abstain, cost) of (answerable, abstained): a false answer costs ``weight`` abstentions."""
    cells = outcomes.groupBy(by).agg(
        F.count_if(~F.col("answerable") & F.col("abstained")).alias("ca"), F.count_if(~F.col("answerable") & ~F.col("abstained")).alias("fa"), F.count_if(F.col("answerable") & F.col("abstained")).alias("fb"))
    rate = F.coalesce(F.col("ca") / F.nullif(F.col("ca") + F.col("fa"), F.lit(0)), F.lit(0.0))
    return cells.select(by, rate.alias("correct_abstain"), "fa", "fb", F.explode(F.array(*map(F.lit, weights))).alias("weight")).select(by, "weight", "correct_abstain", (F.col("weight") * F.col("fa") + F.col("fb")).alias("cost"))


def latency_windows(times: DataFrame, label: str, order: str, value: str) -> DataFrame:
    """(label, n, p50, p95, p99) of the last WINDOW observations of each label, by nearest rank."""
    last = times.withColumn("_n", F.row_number().over(W.partitionBy(label).orderBy(F.desc(order)))).where(F.col("_n") <= WINDOW)
    # WINDOW values a label at most.
    held = last.groupBy(label).agg(F.array_sort(F.collect_list(value)).alias("v"))
    at = lambda q: F.element_at("v", F.greatest(F.lit(1), F.ceil(F.lit(q) * F.size("v"))).cast("int"))
    return held.select(label, F.size("v").cast("long").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))
