"""Supersession edges, temporal verdicts, promotion and abstention.

Clocks are arguments: no expression here reads the time. Rows of a corpus are (file, supersedes, first_indexed,
valid_from, valid_until, ...); hits are (query_id, pos, file, score, ...).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.stats import confidence
from tidemark.functions.text import safe_reference, supersedes_key
from tidemark.sources.shared import stored

#: Rounds of successor walking at most; a chain of 2^n edges needs n.
MAX_ROUNDS = 40
#: Distinct edges up to which edge tables are broadcast to hits.
BROADCAST_EDGES = 200_000
DATE = r"^\d{4}-\d{2}-\d{2}$"


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES else df


def resolve_references(claims: DataFrame) -> DataFrame:
    """Match each (file, supersedes) with the files of that stem: (file, supersedes, first_indexed, target, status).

    status is resolved (one file has the stem), dangling (none) or ambiguous (several; target is null). Rows
    without a file or a reference are left out; a file with several claims still counts once for its stem.
    """
    stems = claims.where("file is not null").select("file").distinct().select("file", supersedes_key(F.col("file")).alias("stem"))
    counted = stems.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("only"))
    made = claims.where("file is not null and supersedes is not null and supersedes <> ''").withColumn("stem", supersedes_key(F.col("supersedes")))
    status = F.when(F.col("n").isNull(), "dangling").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    raw = F.element_at(F.split("supersedes", "/"), -1)
    target = F.when(F.col("n").isNull(), raw).when(F.col("n") == 1, F.col("only"))
    return made.join(counted, "stem", "left").select("file", "supersedes", "first_indexed", target.alias("target"), status.alias("status"))


def ambiguous_files(claims: DataFrame) -> DataFrame:
    """(file): every file of a stem that some claim names and several files carry."""
    stems = claims.where("file is not null").select("file").distinct().select("file", supersedes_key(F.col("file")).alias("stem"))
    several = stems.groupBy("stem").count().where("count > 1").select("stem")
    named = claims.where("file is not null and supersedes is not null and supersedes <> ''").select(supersedes_key(F.col("supersedes")).alias("stem")).distinct()
    return stems.join(several.join(named, "stem"), "stem", "left_semi").select("file")


def edges(claims: DataFrame, known_as_of: str | None = None) -> DataFrame:
    """(target, successor): one live claim for each target.

    Without ``known_as_of`` the last claim in order of (file, supersedes) wins. With it, claims first seen later
    don't count; the latest dated one wins, an undated one only if none is dated; ties go to the last in order. A
    claim that any of its rows leaves undated is undated.
    """
    known = resolve_references(claims).where("status <> 'ambiguous'")
    if known_as_of is None:
        return known.groupBy("target").agg(F.max(F.struct("file", "supersedes"))["file"].alias("successor"))
    dated = known.groupBy("target", "file").agg(
        F.when(F.count(F.lit(1)) == F.count("first_indexed"), F.min("first_indexed")).alias("at"), F.max("supersedes").alias("last"),
    )
    live = dated.where(F.col("at").isNull() | (F.col("at") <= F.lit(known_as_of).cast("timestamp")))
    best = F.max(F.struct(F.col("at").isNotNull().alias("dated"), "at", "file", "last"))
    return live.groupBy("target").agg(best["file"].alias("successor"))


def successors(live: DataFrame) -> DataFrame:
    """(file, successor): the end of each file's chain of ``live`` (target, successor) edges.

    A file that names itself has none. A walk that meets a file again has no end, and gives the direct successor:
    so for cycles, for chains into a cycle, and for chains that end in a file naming itself. Pointers double, so
    there are as many rounds as the logarithm of the longest chain; every round is a stored table. A round in which no walk comes to its end shows that the rest run in circles: a longer
    chain would hold a shorter one that ends.
    """
    step = live.where("target is not null and successor is not null").select(F.col("target").alias("file"), F.col("successor").alias("direct"))
    step = stored(step)
    walk = step.withColumnRenamed("direct", "at")
    moving = None
    for _ in range(MAX_ROUNDS):
        ahead = walk.select(F.col("file").alias("at"), F.col("at").alias("next"))
        walk = stored(walk.join(ahead, "at", "left").select("file", F.coalesce("next", "at").alias("at")))
        before, moving = moving, walk.join(step.select(F.col("file").alias("at")), "at", "left_semi").count()
        if moving in (0, before):
            break
    endless = walk.join(step.select(F.col("file").alias("at"), F.lit(True).alias("open")), "at", "left").select("file", "at", F.coalesce("open", F.lit(False)).alias("open"))
    both = step.join(endless, "file")
    return both.where("file <> direct").select("file", F.when(F.col("open"), F.col("direct")).otherwise(F.col("at")).alias("successor"))


def validity(valid_from: Column, valid_until: Column) -> tuple[Column, Column, Column]:
    """(start, end, malformed) of date strings; the end is the last microsecond of its day, inclusive."""
    parse = lambda c: F.when(c.rlike(DATE), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    start, day = parse(valid_from), parse(valid_until)
    end = day + F.expr("interval 1 day") - F.expr("interval 1 microsecond")
    bad = (valid_from.isNotNull() & (valid_from != "") & start.isNull()) | (valid_until.isNotNull() & (valid_until != "") & day.isNull())
    return start, end, F.coalesce(bad, F.lit(False))


def verdicts(hits: DataFrame, supersession: DataFrame, unresolved: DataFrame, *, now: str, threshold: float, known_as_of: str | None = None) -> DataFrame:
    """Adds valid_start, valid_end, superseded_by and verdict to hits.

    Order of the rules: malformed dates, first seen after ``known_as_of`` (rows without a time stay visible),
    ambiguous reference, superseded, expired, not yet valid, score under the threshold, ok. All bounds pass.
    """
    start, end, bad = validity(F.col("valid_from"), F.col("valid_until"))
    joined = hits.join(_small(supersession.select("file", F.col("successor").alias("_successor"))), "file", "left")
    joined = joined.join(_small(unresolved.select("file", F.lit(True).alias("_ambiguous"))), "file", "left")
    clock = F.lit(now).cast("timestamp")
    seen = F.coalesce("first_indexed", "indexed_at")
    unknown = F.lit(False) if known_as_of is None else F.coalesce(seen > F.lit(known_as_of).cast("timestamp"), F.lit(False))
    verdict = (
        F.when(bad, "invalid_metadata").when(unknown, "not_yet_known").when(F.col("_ambiguous"), "ambiguous_supersession")
        .when(F.col("_successor").isNotNull(), "superseded").when(clock > F.col("valid_end"), "expired")
        .when(clock < F.col("valid_start"), "not_yet_valid").when(F.col("score") < threshold, "low_confidence").otherwise("ok")
    )
    timed = joined.withColumn("valid_start", F.when(~bad, start)).withColumn("valid_end", F.when(~bad, end)).withColumn("verdict", verdict)
    return timed.withColumn("superseded_by", F.when(F.col("verdict").isin("superseded", "expired", "not_yet_valid", "low_confidence", "ok"), F.col("_successor"))).drop("_successor", "_ambiguous")


def evaluate(hits: DataFrame, supersession: DataFrame, unresolved: DataFrame, *, now: str, threshold: float, scale: float = 0.05, known_as_of: str | None = None) -> DataFrame:
    """Verdicts, promotion and order: hits with verdict, confidence and final position (``ok`` first, stable).

    A low-confidence hit becomes ok if a superseded hit of its query at the threshold or over names it successor.
    """
    judged = verdicts(hits, supersession, unresolved, now=now, threshold=threshold, known_as_of=known_as_of)
    named = judged.where((F.col("verdict") == "superseded") & (F.col("score") >= threshold)).select("query_id", F.col("superseded_by").alias("file"), F.lit(True).alias("_named")).distinct()
    promoted = judged.join(named, ["query_id", "file"], "left").withColumn("verdict", F.when((F.col("verdict") == "low_confidence") & F.col("_named"), "ok").otherwise(F.col("verdict"))).drop("_named")
    order = W.partitionBy("query_id").orderBy((F.col("verdict") != "ok").cast("int"), "pos")
    return promoted.withColumn("confidence", confidence(F.col("score"), F.lit(threshold), F.lit(scale))).withColumn("final_pos", F.row_number().over(order).cast("long"))


def abstentions(evaluated: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, abstained, reason): a query abstains if no hit is ok; the reason follows its best hit."""
    best = evaluated.groupBy("query_id").agg(
        F.max((F.col("verdict") == "ok").cast("int")).alias("any_ok"),
        F.max_by(F.struct("file", "verdict", "superseded_by"), F.struct("score", -F.col("pos"))).alias("best"),
    )
    file, verdict = F.col("best.file"), F.col("best.verdict")
    reason = (
        F.when(F.col("any_ok") == 1, "").when(F.col("any_ok").isNull(), "nothing was retrieved")
        .when(verdict == "superseded", F.concat(F.lit("best hit "), file, F.lit(" is superseded by "), F.col("best.superseded_by")))
        .when(verdict == "expired", F.concat(F.lit("best hit "), file, F.lit(" has expired")))
        .when(verdict == "not_yet_valid", F.concat(F.lit("best hit "), file, F.lit(" is not yet valid")))
        .when(verdict == "not_yet_known", F.concat(F.lit("best hit "), file, F.lit(" was written after the as-of time")))
        .when(verdict == "invalid_metadata", F.concat(F.lit("best hit "), file, F.lit(" has malformed validity dates")))
        .when(verdict == "ambiguous_supersession", F.concat(F.lit("best hit "), file, F.lit(" shares its name with another superseded file")))
        .otherwise("no hit reaches the confidence threshold")
    )
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce(F.col("any_ok") == 0, F.lit(True)).alias("abstained"), reason.alias("reason"))


def expand_successors(hits: DataFrame, supersession: DataFrame, scored: DataFrame, sources: int = 2, most: int = 3) -> DataFrame:
    """Chunks of terminal successors that a query's pool lacks: best ``most`` of each of the first ``sources``.

    ``scored`` (query_id, file, id, score) are candidates to take from; returns query_id, file, id, score, nth.
    """
    wanted = hits.join(_small(supersession), "file").groupBy("query_id", F.col("successor").alias("file")).agg(F.min("pos").alias("best"))
    absent = wanted.join(hits.select("query_id", "file").distinct(), ["query_id", "file"], "left_anti")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("best", "file")).cast("long")
    chosen = absent.withColumn("place", place).where(F.col("place") <= sources)
    order = W.partitionBy("query_id", "file").orderBy(F.desc("score"), "id")
    return scored.join(chosen.select("query_id", "file"), ["query_id", "file"]).withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= most)


def servable(evaluated: DataFrame) -> DataFrame:
    return evaluated.where("verdict = 'ok'")


def union_first(parts: list[DataFrame]) -> DataFrame:
    """Hits of several rounds (query_id, id, ...): each id once, from the first round, then position, that has it."""
    named = [p.withColumn("round", F.lit(i)) for i, p in enumerate(parts)]
    order = W.partitionBy("query_id", "id").orderBy("round", "rank")
    return reduce(DataFrame.unionByName, named).withColumn("_n", F.row_number().over(order).cast("long")).where("_n = 1").drop("_n")
