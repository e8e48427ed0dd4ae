"""Immutable corpus generations: merges, manifests, parity, reuse, retention, erasure and the operation outbox.

A change of a corpus is a new snapshot: every function returns the rows that the next generation holds. Chunks
are (id, source, text, indexed_at, first_indexed, ...); ``now`` is an argument.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PRUNE_LEAST, PRUNE_FRACTION = 5, 0.5
KEEP_RETIRED, RETENTION_DAYS = 2, 7


def _first(old_first: Column, old_indexed: Column, new: Column) -> Column:
    """First-seen dates never move forward."""
    return F.least(F.coalesce(old_first, old_indexed), new)


def upsert(old: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """``new`` (id, source, text) over ``old``; of an id given twice the last text in order counts once."""
    clock = F.lit(now).cast("timestamp")
    fresh = new.groupBy("id").agg(F.max(F.struct("source", "text")).alias("n"))
    joined = old.withColumn("_old", F.lit(True)).join(fresh, "id", "full")
    has = F.col("n").isNotNull()
    return joined.select(
        "id", F.when(has, F.col("n.source")).otherwise(F.col("source")).alias("source"), F.when(has, F.col("n.text")).otherwise(F.col("text")).alias("text"),
        F.when(has, clock).otherwise(F.col("indexed_at")).alias("indexed_at"),
        F.when(has & F.col("_old").isNull(), clock).when(has, _first(F.col("first_indexed"), F.col("indexed_at"), clock)).otherwise(F.col("first_indexed")).alias("first_indexed"),
    )


def replace_sources(old: DataFrame, new: DataFrame, sources: DataFrame, now: str) -> DataFrame:
    """All chunks of ``sources`` (source) replaced by ``new`` (id, source, text), keeping first-seen dates by id."""
    clock = F.lit(now).cast("timestamp")
    kept = old.join(sources.select("source").distinct(), "source", "left_anti").join(new.select("id"), "id", "left_anti")
    seen = old.select("id", F.coalesce("first_indexed", "indexed_at").alias("seen"))
    added = new.join(seen, "id", "left").select("id", "source", "text", clock.alias("indexed_at"), F.least("seen", clock).alias("first_indexed"))
    return kept.select("id", "source", "text", "indexed_at", "first_indexed").unionByName(added)


def touch(old: DataFrame, sources: DataFrame, now: str) -> DataFrame:
    clock = F.lit(now).cast("timestamp")
    marked = old.join(sources.select("source", F.lit(True).alias("_hit")).distinct(), "source", "left")
    return marked.select(
        "id", "source", "text", F.when(F.col("_hit"), clock).otherwise(F.col("indexed_at")).alias("indexed_at"),
        F.when(F.col("_hit"), _first(F.col("first_indexed"), F.col("indexed_at"), clock)).otherwise(F.col("first_indexed")).alias("first_indexed"),
    )


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(uri, change) of manifests (uri, sha256): added, removed, modified or same."""
    a, b = old.select("uri", F.col("sha256").alias("a")), new.select("uri", F.col("sha256").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified").otherwise("same")
    return a.join(b, "uri", "full").select("uri", change.alias("change"))


def corpus_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(added, removed, modified, delta): changed addresses over the union of addresses; 0 for two empty ones."""
    counts = manifest_diff(old, new).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified", "same")])
    changed, total = F.col("added") + F.col("removed") + F.col("modified"), F.col("added") + F.col("removed") + F.col("modified") + F.col("same")
    return counts.select("added", "removed", "modified", F.when(total > 0, changed / total).otherwise(0.0).alias("delta"))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """(source, problem) of two stores (source, hash): missing, extra, hash, count; equal sources give no row."""
    side = lambda df, p: df.groupBy("source").agg(F.min("hash").alias(f"{p}_low"), F.max("hash").alias(f"{p}_high"), F.count(F.lit(1)).alias(f"{p}_n"))
    joined = side(left, "a").join(side(right, "b"), "source", "full")
    problem = (
        F.when(F.col("b_n").isNull(), "missing").when(F.col("a_n").isNull(), "extra")
        .when(~(F.col("a_low").eqNullSafe(F.col("b_low")) & F.col("a_high").eqNullSafe(F.col("b_high"))), "hash").when(F.col("a_n") != F.col("b_n"), "count")
    )
    return joined.select("source", problem.alias("problem")).where("problem is not null")


def reusable(chunks_of: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (uri, sha256, pipeline) the newest generation that holds it: (uri, sha256, generation_id).

    ``chunks_of``: (uri, sha256, pipeline, generation_id, activated_at, created_at). Activated ones come first.
    """
    order = W.partitionBy("uri", "sha256", "pipeline").orderBy(F.col("activated_at").desc_nulls_last(), F.desc("created_at"), F.desc("generation_id"))
    found = chunks_of.join(wanted.distinct(), ["uri", "sha256", "pipeline"])
    return found.withColumn("_n", F.row_number().over(order).cast("long")).where("_n = 1").select("uri", "sha256", "generation_id")


def collectable(generations: DataFrame, now: str, keep: int = KEEP_RETIRED, days: int = RETENTION_DAYS) -> DataFrame:
    """Retired generations to drop: not among the newest ``keep`` of their tenant, and retired ``days`` ago."""
    when = F.coalesce("retired_at", "created_at")
    order = W.partitionBy("tenant_id").orderBy(when.desc(), F.desc("generation_id"))
    old = generations.where("state = 'retired'").withColumn("_n", F.row_number().over(order).cast("long"))
    return old.where((F.col("_n") > keep) & (when < F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))).select("tenant_id", "generation_id")


def forget(chunks: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Chunks of all generations without the erased sources (tenant_id, source)."""
    return chunks.join(tombstones.select("tenant_id", "source").distinct(), ["tenant_id", "source"], "left_anti")


def vanished(known: DataFrame, present: DataFrame) -> DataFrame:
    """(n_known, n_vanished, refused): sources to prune; refused if too many of them would go at once."""
    counts = known.select("source").distinct().join(present.select("source", F.lit(1).alias("_here")).distinct(), "source", "left").agg(F.count(F.lit(1)).alias("n_known"), F.count_if(F.col("_here").isNull()).alias("n_vanished"))
    return counts.withColumn("refused", (F.col("n_known") >= PRUNE_LEAST) & (F.col("n_vanished") / F.col("n_known") >= PRUNE_FRACTION))


def changed_only(present: DataFrame, indexed: DataFrame) -> DataFrame:
    """Sources whose (source, fingerprint) is not indexed yet: what an incremental run has to read."""
    return present.join(indexed.select("source", "fingerprint").distinct(), ["source", "fingerprint"], "left_anti")


def covered_sources(chunks: DataFrame, sidecar: DataFrame) -> DataFrame:
    """(source, n): sources all of whose chunks have a row in ``sidecar`` (id)."""
    marked = chunks.select("id", "source").join(sidecar.select("id", F.lit(1).alias("_has")).distinct(), "id", "left")
    return marked.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("_has").alias("_m")).where("n = _m").select("source", "n")


def pending(outbox: DataFrame) -> DataFrame:
    """Operations to replay in order: (tenant_id, operation_id, sequence) not completed, the first of each id."""
    first = outbox.groupBy("tenant_id", "operation_id").agg(F.min("sequence").alias("sequence"), F.max(F.col("completed").cast("int")).alias("_done"), F.min_by("payload", "sequence").alias("payload"))
    return first.where("_done = 0").withColumn("turn", F.row_number().over(W.partitionBy("tenant_id").orderBy("sequence")).cast("long")).drop("_done")


def routes(route: DataFrame, generations: DataFrame) -> DataFrame:
    """Route (tenant_id, active_id, shadow_id) with both generations' states; an active one must exist."""
    g = generations.select("tenant_id", "generation_id", "state")
    active = g.select("tenant_id", F.col("generation_id").alias("active_id"), F.col("state").alias("active_state"))
    shadow = g.select("tenant_id", F.col("generation_id").alias("shadow_id"), F.col("state").alias("shadow_state"))
    return route.join(active, ["tenant_id", "active_id"]).join(shadow, ["tenant_id", "shadow_id"], "left")


def matching_sources(chunks: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Distinct sources that an identifier names by source or by file: two equality joins, not one with OR."""
    ids = identifiers.select("identifier").distinct()
    by_source = chunks.join(ids, chunks["source"] == ids["identifier"], "left_semi").select("source")
    by_file = chunks.join(ids, chunks["file"] == ids["identifier"], "left_semi").select("source")
    return by_source.union(by_file).distinct()


def known_sources(stores: list[DataFrame]) -> DataFrame:
    """(source): sources that any of the stores holds, each once."""
    return reduce(DataFrame.union, [s.select("source").distinct() for s in stores]).distinct()


def freshness(chunks: DataFrame, now: str, max_age_days: int = 2) -> DataFrame:
    """(newest, stale): stale if older than the limit, or if there is nothing."""
    clock = F.lit(now).cast("timestamp")
    return chunks.agg(F.max("indexed_at").alias("newest")).withColumn("stale", F.coalesce(F.col("newest") < clock - F.expr(f"interval {max_age_days} days"), F.lit(True)))
