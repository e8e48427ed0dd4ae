"""Calibration artefacts, reviews and generations as state: every function gives the rows of the next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.stats import certified
from tidemark.operators.scan import scan

#: Bounds of carrying a threshold forward: corpus delta, error of either class.
MOST_DELTA, MOST_ERROR = 0.25, 0.10
REVIEW_STEPS = {"proposed": "reviewed", "reviewed": "accepted", "accepted": "promoted"}


def query_set_digest(queries: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, problem, digest) of labelled queries (query, answerable): order doesn't matter, repeats are a problem.

    The digest is of the sums of the entries' digests in two lanes, so a set is never gathered.
    """
    entry = F.sha2(F.to_json(F.struct("answerable", "query")), 256)
    lane = lambda at: F.sum(F.conv(F.substring(entry, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    blank = F.count_if(F.col("query").isNull() | (F.trim("query") == "") | F.col("answerable").isNull())
    sums = queries.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), blank.alias("blank"), F.count_distinct("query", "answerable").alias("kinds"), lane(1).alias("a"), lane(17).alias("b"))
    problem = F.when(F.col("blank") > 0, "needs a query and a label").when(F.col("kinds") < F.col("n"), "repeats a labelled query")
    return sums.select(*by, "n", problem.alias("problem"), F.sha2(F.concat_ws(":", F.col("n").cast("string"), "a", "b"), 256).alias("digest"))


def publish(artifacts: DataFrame, chosen: DataFrame) -> DataFrame:
    """``artifacts`` after publishing the ``chosen`` (tenant_id, calibration_id): certified drafts only; what was
    published for the same generation is retired."""
    named = artifacts.join(chosen.select("tenant_id", "calibration_id", F.lit(True).alias("_chosen")).distinct(), ["tenant_id", "calibration_id"], "left")
    goes = F.coalesce(F.col("_chosen") & F.col("certified") & (F.col("state") == "draft"), F.lit(False))
    marked = named.withColumn("_goes", goes)
    replaced = marked.where("_goes").select("tenant_id", "generation_id", F.lit(True).alias("_replaced")).distinct()
    state = F.when(F.col("_goes"), "published").when((F.col("state") == "published") & F.col("_replaced"), "retired").otherwise(F.col("state"))
    return marked.join(replaced, ["tenant_id", "generation_id"], "left").withColumn("_state", state).drop("_chosen", "_goes", "_replaced", "state").withColumnRenamed("_state", "state")


def calibration_status(generations: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(tenant_id, generation_id, status, calibration_id): certified, uncertified, draft, stale or missing.

    A published artefact of the generation counts if pipeline and corpus are still those it was fitted on. Without
    one the newest artefact of the generation tells; then any published one of the tenant makes it stale.
    """
    published = artifacts.where("state = 'published'").select("tenant_id", "generation_id", F.col("calibration_id").alias("p_id"), F.col("pipeline").alias("p_pipeline"), F.col("corpus").alias("p_corpus"), F.col("certified").alias("p_certified"))
    newest = artifacts.groupBy("tenant_id", "generation_id").agg(F.max_by(F.struct("certified", "state"), F.struct("created_at", "calibration_id")).alias("l"))
    some = artifacts.where("state = 'published'").select("tenant_id", F.lit(True).alias("any_published")).distinct()
    joined = generations.join(published, ["tenant_id", "generation_id"], "left").join(newest, ["tenant_id", "generation_id"], "left").join(some, "tenant_id", "left")
    moved = (F.col("p_pipeline") != F.col("pipeline")) | (F.col("p_corpus") != F.col("corpus"))
    none = F.when(~F.col("l.certified"), "uncertified").when(F.col("l.state") == "draft", "draft").when(F.col("any_published"), "stale").otherwise("missing")
    status = F.when(F.col("p_id").isNull(), none).when(moved, "stale").when(~F.col("p_certified"), "uncertified").otherwise("certified")
    return joined.select("tenant_id", "generation_id", status.alias("status"), F.when(status == "certified", F.col("p_id")).alias("calibration_id"))


def carry_forward(children: DataFrame) -> DataFrame:
    """Adds decision to (same_pipeline, delta, auc, n_pos, n_neg, false_abstain_rate, false_confirm_rate): refused, or
    certified or rejected on the fresh scores at the inherited threshold."""
    sure = F.coalesce(certified(F.col("auc"), F.col("n_pos"), F.col("n_neg")), F.lit(False))
    within = (F.col("false_abstain_rate") <= MOST_ERROR) & (F.col("false_confirm_rate") <= MOST_ERROR)
    decision = F.when(~F.col("same_pipeline"), "refused_pipeline").when(F.col("delta") > MOST_DELTA, "refused_delta").when(F.col("auc").isNull(), "refused_one_class").when(sure & within, "certified").when(sure, "rejected_boundary").otherwise("rejected_separability")
    return children.withColumn("decision", decision)


def recalibration_action(drift: Column, running: Column, labelled: Column) -> Column:
    """What an automatic recalibration does: nothing while stable or running, else fit if there are labels, else ask."""
    return F.when(drift.isin("stable", "unknown"), "none").when(running, "wait").when(labelled, "recalibrate").otherwise("request_labels")


#: States of a proposal.
REVIEW_STATES = ("proposed", "reviewed", "accepted", "rejected", "promoted")


def review(proposals: DataFrame, events: DataFrame) -> DataFrame:
    """(proposal_id, state, trusted) after ``events`` (proposal_id, seq, action, reviewer, note) in order of seq.

    Steps are proposed, reviewed, accepted, promoted; a reviewed or accepted one may be rejected. An event without
    reviewer or note, or out of turn, changes nothing. Only a promoted proposal with evidence is trusted.
    """
    valid = events.where("proposal_id is not null and reviewer is not null and trim(note) <> ''")
    step = {"review": {"proposed": "reviewed"}, "accept": {"reviewed": "accepted"}, "reject": {"reviewed": "rejected", "accepted": "rejected"}, "promote": {"accepted": "promoted"}}

    def lift(event) -> dict:
        return {s: step.get(event["action"], {}).get(s, s) for s in REVIEW_STATES}

    # An event leads from every state to one, so events in a row do too: proposals with many are spread over tasks.
    walked = scan(valid, "proposal_id", ["seq"], lift, lambda a, b: {s: b[t] for s, t in a.items()}, {s: s for s in REVIEW_STATES}, ["seq"])
    last = walked.groupBy("proposal_id").agg(F.get_json_object(F.max_by("state", "seq"), "$.proposed").alias("state"))
    state = F.coalesce("state", F.lit("proposed"))
    return proposals.join(last, "proposal_id", "left").select("proposal_id", state.alias("state"), ((state == "promoted") & (F.col("n_evidence") > 0)).alias("trusted"))


def promote(generations: DataFrame, chosen: DataFrame) -> DataFrame:
    """``generations`` (tenant_id, generation_id, state, certified) after promoting ``chosen``: only ready and
    certified ones become active; the tenant's active one is retired and becomes the one to roll back to."""
    named = generations.join(chosen.select("tenant_id", "generation_id", F.lit(True).alias("_chosen")).distinct(), ["tenant_id", "generation_id"], "left")
    goes = F.coalesce(F.col("_chosen") & (F.col("state") == "ready") & F.col("certified"), F.lit(False))
    marked = named.withColumn("_goes", goes)
    changed = marked.where("_goes").select("tenant_id", F.lit(True).alias("_moved")).distinct()
    moved = F.coalesce("_moved", F.lit(False))
    state = F.when(F.col("_goes"), "active").when((F.col("state") == "active") & moved, "retired").otherwise(F.col("state"))
    joined = marked.join(changed, "tenant_id", "left").withColumn("previous", moved & (F.col("state") == "active"))
    return joined.withColumn("_state", state).drop("_chosen", "_goes", "_moved", "state").withColumnRenamed("_state", "state")


def validate(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(generation_id, missing, extra, changed, state): a building generation is ready if its sources are the
    manifest's, by (generation_id, uri, sha256)."""
    a, b = expected.select("generation_id", "uri", F.col("sha256").alias("a")), actual.groupBy("generation_id", "uri").agg(F.min("sha256").alias("b"))
    joined = a.join(b, ["generation_id", "uri"], "full")
    counts = joined.groupBy("generation_id").agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), F.count_if(F.col("a") != F.col("b")).alias("changed"))
    return counts.withColumn("state", F.when(F.col("missing") + F.col("extra") + F.col("changed") == 0, "ready").otherwise("failed"))


def append_operations(outbox: DataFrame, new: DataFrame) -> DataFrame:
    """``outbox`` with ``new`` (tenant_id, operation_id, payload) behind it in order; an id that is there is not
    appended again. Sequences go on from the tenant's last one."""
    fresh = new.groupBy("tenant_id", "operation_id").agg(F.min("payload").alias("payload")).join(outbox.select("tenant_id", "operation_id"), ["tenant_id", "operation_id"], "left_anti")
    last = outbox.groupBy("tenant_id").agg(F.max("sequence").alias("last"))
    order = W.partitionBy("tenant_id").orderBy("operation_id")
    placed = fresh.join(last, "tenant_id", "left").select("tenant_id", "operation_id", (F.coalesce("last", F.lit(-1).cast("long")) + F.row_number().over(order)).alias("sequence"), "payload", F.lit(False).alias("completed"))
    return outbox.select(*placed.columns).unionByName(placed)


def complete(outbox: DataFrame, done: DataFrame) -> DataFrame:
    marked = outbox.join(done.select("tenant_id", "operation_id", F.lit(True).alias("_done")).distinct(), ["tenant_id", "operation_id"], "left")
    return marked.withColumn("completed", F.col("completed") | F.coalesce("_done", F.lit(False))).drop("_done")


def replay(store: DataFrame, outbox: DataFrame) -> DataFrame:
    """``store`` (tenant_id, id, source, text) after the open operations of ``outbox`` in order.

    ``outbox`` is (tenant_id, operation_id, sequence, kind, sources, chunks, completed); an ``index`` operation puts its
    chunks (id, source, text) in place of all of its sources', a ``delete`` removes these. What a source holds in the
    end is told by the last operation that names it, so no order is walked. Replaying twice gives the same rows.
    """
    pending = outbox.where("not completed")
    last = pending.select("tenant_id", "sequence", F.explode("sources").alias("source")).groupBy("tenant_id", "source").agg(F.max("sequence").alias("sequence"))
    kept = store.join(last.select("tenant_id", "source"), ["tenant_id", "source"], "left_anti")
    made = pending.where("kind = 'index'").select("tenant_id", "sequence", F.explode("chunks").alias("c")).select("tenant_id", "sequence", "c.source", "c.id", "c.text")
    added = made.join(last, ["tenant_id", "source", "sequence"])
    return kept.select("tenant_id", "id", "source", "text").unionByName(added.select("tenant_id", "id", "source", "text"))


def erase_pending(outbox: DataFrame, erased: DataFrame) -> DataFrame:
    """``outbox`` without the ``erased`` (tenant_id, source) in open operations: not as a source, nor in a chunk, whatever
    the operation says its sources are. An operation that only had those is completed and keeps no payload."""
    gone = erased.select("tenant_id", "source").distinct().groupBy("tenant_id").agg(F.collect_set("source").alias("_gone"))  # one request's sources
    joined = outbox.join(gone, "tenant_id", "left")
    named = F.array_union(F.coalesce("sources", F.array().cast("array<string>")), F.coalesce(F.transform("chunks", lambda c: c["source"]), F.array().cast("array<string>")))
    left = F.array_except(F.when(F.size("sources") > 0, F.col("sources")).otherwise(named), F.col("_gone"))
    hit = ~F.col("completed") & F.col("_gone").isNotNull() & F.arrays_overlap(named, "_gone")
    hit = F.coalesce(hit, F.lit(False))
    void = hit & (F.size(left) == 0)
    chunks = F.filter("chunks", lambda c: ~F.array_contains(F.col("_gone"), c["source"]))
    return joined.select(
        "tenant_id", "operation_id", "sequence", "kind", F.when(void, None).when(hit, left).otherwise(F.col("sources")).alias("sources"),
        F.when(void, None).when(hit, chunks).otherwise(F.col("chunks")).alias("chunks"), (F.col("completed") | void).alias("completed"),
    )


def roll_back(generations: DataFrame) -> DataFrame:
    """``generations`` (tenant_id, generation_id, state, previous) after a rollback of every tenant that can: the previous
    one, if it is retired or ready, becomes active, and the active one ready and the previous one."""
    able = generations.where(F.col("previous") & F.col("state").isin("retired", "ready")).select("tenant_id", F.lit(True).alias("_able")).distinct()
    named = generations.join(able, "tenant_id", "left")
    back, out = F.col("previous") & F.col("_able"), (F.col("state") == "active") & F.col("_able")
    state = F.when(back, "active").when(out, "ready").otherwise(F.col("state"))
    return named.select("tenant_id", "generation_id", state.alias("state"), F.when(F.col("_able"), F.coalesce(out, F.lit(False))).otherwise(F.col("previous")).alias("previous"))


#: Where an action takes a generation from each state that allows it; any other action changes nothing.
TRANSITIONS = {
    "stage": {"building": "building"}, "validate": {"building": "ready"}, "promote": {"ready": "active"}, "retire": {"active": "retired"},
    "rollback": {"retired": "active"}, "fail": {"building": "failed", "failed": "failed"}, "abandon": {"ready": "failed"},
}


def lifecycle_states(actions: DataFrame) -> DataFrame:
    """(generation_id, state, refused): what ``actions`` (generation_id, seq, action) make of a generation that is
    building, and how many the state didn't allow. A generation has few actions, so they are folded in order."""
    steps = actions.groupBy("generation_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action"))).alias("steps"))
    flat = F.create_map(*(F.lit(x) for action, ways in TRANSITIONS.items() for a, b in ways.items() for x in (f"{action}|{a}", b)))
    start = F.struct(F.lit("building").alias("state"), F.lit(0).cast("long").alias("refused"))

    def step(s, x):
        to = F.try_element_at(flat, F.concat_ws("|", x["action"], s["state"]))
        return F.struct(F.coalesce(to, s["state"]).alias("state"), (s["refused"] + to.isNull().cast("long")).alias("refused"))

    return steps.withColumn("end", F.aggregate("steps", start, step)).select("generation_id", "end.state", "end.refused")


def carry_rows(chunks: DataFrame, found: DataFrame, generation_id: str) -> DataFrame:
    """The rows that a new generation takes over unchanged: ``chunks`` of the generation that ``found`` (uri, sha256,
    generation_id) names for each object, under the new generation."""
    return chunks.join(found.select("uri", "sha256", "generation_id").distinct(), ["uri", "sha256", "generation_id"]).withColumn("generation_id", F.lit(generation_id))


def cached(wanted: DataFrame, cache: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(found, missing) of ``wanted`` (id, text) in ``cache`` (key, version, value): only what is missing is worked on.

    The key is the SHA-256 of the text; entries of another version don't count.
    """
    keyed = wanted.withColumn("key", F.sha2("text", 256))
    live = cache.where(F.col("version") == version).select("key", "value")
    return keyed.join(live, "key").select("id", "key", "value"), keyed.join(live.select("key"), "key", "left_anti").select("id", "key")


def bundle_lines(artifacts: DataFrame, columns: list[str]) -> DataFrame:
    """(line): artefacts as JSON with a checksum, to export; ``read_bundle`` takes them back."""
    body = F.to_json(F.struct(*columns))
    return artifacts.select(F.concat(F.sha2(body, 256), F.lit(" "), body).alias("line"))


def read_bundle(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of ``bundle_lines`` whose checksum holds, with the fields of ``schema``."""
    parts = lines.select(F.substring("line", 1, 64).alias("sum"), F.expr("substring(line, 66)").alias("body"))
    return parts.where(F.sha2("body", 256) == F.col("sum")).select(F.from_json("body", schema).alias("r")).select("r.*")
