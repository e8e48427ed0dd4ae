"""Corpus graph, linting, rule-based proposals, claim extraction and claim drift.

Documents are (file, text, valid_from, valid_until, supersedes); times are timestamps where a rule compares them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.text import CLOSURE_MARKER, LEAST_SKELETON, NUMBER, skeleton, supersedes_key, version_of
from tidemark.operators.lines import prose
from tidemark.operators.trust import resolve_references
from tidemark.sources.shared import stored

#: Days that windows are compared in: 2^LEVELS from 1970 on; earlier and later ones count as the first and the last.
LEVELS = 17

#: Patterns of the rules.
DIRECT_REFERENCE = r"(?i)\b(?:replaces|supersedes|deprecates|updates|revises)\s+`?([\w./\-\[\]]+)`?"
POSITIVE = r"(?i)\b(enabled|active|valid|approved|ship|on)\b"
NEGATIVE = r"(?i)\b(disabled|inactive|invalid|rejected|blocked|off)\b"
VALID_FROM = r"(?i)\b(?:valid[ _]from|effective(?:\s+from)?)\b[^\n]{0,40}?(\d{4}-\d{2}-\d{2})"
VALID_UNTIL = r"(?i)\b(?:valid[ _]until|expires?(?:\s+on)?)\b[^\n]{0,40}?(\d{4}-\d{2}-\d{2})"
LIST_MARKER = r"^\d+[.)]\s"
STATUS = r"(?i)\bstatus\s*[:=]\s*([A-Za-z]+)"
CONFIDENCE = {"explicit_version_naming": 0.86, "direct_textual_reference": 0.9, "repeated_decision_subject": 0.72, "contradictory_validity_windows": 0.78, "temporal_ordering": 0.64}
STATUSES = ("active", "deprecated", "obsolete", "superseded", "draft", "final", "approved", "rejected")


def _proposal(df: DataFrame, rule: str, old: str, new: str, relation: str = "supersedes") -> DataFrame:
    status = "proposed" if CONFIDENCE[rule] >= 0.8 else "requires_review"
    return df.select(F.lit(rule).alias("rule"), F.col(old).alias("subject"), F.col(new).alias("object"), F.lit(relation).alias("relation"), F.lit(CONFIDENCE[rule]).alias("confidence"), F.lit(status).alias("status"))


def _without_authored(df: DataFrame, authored: DataFrame | None, old: str, new: str) -> DataFrame:
    if authored is None:
        return df
    made = authored.select(F.col("target").alias(old), F.col("successor").alias(new)).distinct()
    return df.join(made, [old, new], "left_anti")


def version_proposals(docs: DataFrame, authored: DataFrame | None = None) -> DataFrame:
    """Consecutive versions of one base name: the lower one is superseded by the next."""
    base, number = version_of(F.col("file"))
    named = docs.select("file", base.alias("base"), number.alias("version")).where("version is not null").distinct()
    order = W.partitionBy("base").orderBy("version", "file")
    pairs = named.withColumn("newer", F.lead("file").over(order)).withColumn("next", F.lead("version").over(order)).where("version < next")
    return _proposal(_without_authored(pairs, authored, "file", "newer"), "explicit_version_naming", "file", "newer")


def reference_proposals(docs: DataFrame, authored: DataFrame | None = None) -> DataFrame:
    """Texts that say they replace another file of the corpus (within the first 4000 characters, as the rule is)."""
    names = docs.select(F.col("file").alias("target"), supersedes_key(F.col("file")).alias("key")).groupBy("key").agg(F.max("target").alias("target"))
    said = docs.select("file", F.explode(F.array_distinct(F.regexp_extract_all(F.substring("text", 1, 4000), F.lit(DIRECT_REFERENCE), F.lit(1)))).alias("said"))
    found = said.select("file", supersedes_key(F.regexp_replace("said", r"[.,;:)]+$", "")).alias("key")).distinct().join(names, "key").where("target <> file")
    return _proposal(_without_authored(found, authored, "target", "file"), "direct_textual_reference", "target", "file")


def subject_proposals(docs: DataFrame, authored: DataFrame | None = None) -> DataFrame:
    """Consecutive documents of one ``subject`` by validity start, dated ones first; both undated give none."""
    order = W.partitionBy("subject").orderBy(F.col("valid_from").asc_nulls_last(), "file")
    pairs = docs.where("subject is not null and subject <> ''").withColumn("newer", F.lead("file").over(order)).withColumn("newer_from", F.lead("valid_from").over(order))
    pairs = pairs.where("newer is not null and newer <> file and (valid_from is not null or newer_from is not null)")
    return _proposal(_without_authored(pairs, authored, "file", "newer"), "repeated_decision_subject", "file", "newer")


def ordering_proposals(docs: DataFrame, authored: DataFrame | None = None) -> DataFrame:
    """Consecutive documents of one ``entity`` whose validity starts increase."""
    order = W.partitionBy("entity").orderBy(F.col("valid_from").asc_nulls_last(), "file")
    pairs = docs.where("entity is not null").withColumn("newer", F.lead("file").over(order)).withColumn("newer_from", F.lead("valid_from").over(order)).where("valid_from < newer_from and newer <> file")
    return _proposal(_without_authored(pairs, authored, "file", "newer"), "temporal_ordering", "file", "newer")


def dyadic_blocks(first: Column, last: Column) -> Column:
    """The fewest blocks (level, block) of 2^level days that make up the days [first, last]: two a level at most."""
    odd = lambda x: x % 2 == 1

    def step(s, level):
        low, high = s["low"], s["high"]
        block = lambda at: F.array(F.struct(level.alias("level"), at.alias("block")))
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        more = F.concat(F.when((low < high) & odd(low), block(low)).otherwise(none), F.when((low < high) & odd(high), block(high - 1)).otherwise(none))
        return F.struct(F.floor((low + 1) / 2).alias("low"), F.floor(high / 2).alias("high"), F.concat(s["found"], more).alias("found"))

    begin = F.struct(first.alias("low"), (last + 1).alias("high"), F.array().cast("array<struct<level:int,block:bigint>>").alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), begin, step, lambda s: s["found"])


def overlapping_pairs(windows: DataFrame) -> DataFrame:
    """Pairs (subject, left, right) of one subject and opposite polarity whose [valid_from, valid_until] meet.

    Of two windows that meet, the one that starts later starts inside the other. Windows are cut into dyadic blocks
    of days and starts are looked up in the blocks around them, so this is a join by equality; a pair is found in
    one block only. Nulls are open ends, and no other case.
    """
    w = windows.where("polarity <> 0 and coalesce(valid_from <= valid_until, true)").select("subject", "file", "polarity", "valid_from", "valid_until")
    day = lambda c, absent: F.greatest(F.lit(0), F.least(F.lit((1 << LEVELS) - 1), F.coalesce(F.floor(F.unix_timestamp(c) / 86400), F.lit(absent))))
    placed = w.withColumn("first", day("valid_from", 0)).withColumn("last", day("valid_until", (1 << LEVELS) - 1)).withColumn("nr", F.monotonically_increasing_id())
    placed = stored(placed)
    blocks = placed.withColumn("at", F.explode(dyadic_blocks(F.col("first"), F.col("last"))))
    around = placed.select("subject", "file", F.col("polarity").alias("other"), "valid_from", "nr", F.explode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.col("first"), k).alias("block")))).alias("at"))
    a = blocks.select("subject", F.col("polarity").alias("p"), "at.*", F.col("file").alias("a_file"), F.col("valid_from").alias("a_from"), F.col("valid_until").alias("a_until"), F.col("nr").alias("a_nr"))
    b = around.select("subject", (-F.col("other")).alias("p"), "at.*", F.col("file").alias("b_file"), F.col("valid_from").alias("b_from"), F.col("nr").alias("b_nr"))
    begin = lambda c: F.coalesce(F.col(c), F.lit("0001-01-01").cast("timestamp"))
    later = (begin("b_from") > begin("a_from")) | ((begin("b_from") == begin("a_from")) & (F.col("b_nr") > F.col("a_nr")))
    met = a.join(b, ["subject", "p", "level", "block"]).where(later & F.coalesce(F.col("b_from") <= F.col("a_until"), F.lit(True)) & (F.col("a_file") != F.col("b_file")))
    return met.select("subject", F.least("a_file", "b_file").alias("left"), F.greatest("a_file", "b_file").alias("right"))


def polarity(text: Column) -> Column:
    """1 for positive status words, -1 for negative ones, 0 for neither or both."""
    p, n = text.rlike(POSITIVE), text.rlike(NEGATIVE)
    return F.when(p & ~n, 1).when(n & ~p, -1).otherwise(0)


def contradiction_proposals(docs: DataFrame) -> DataFrame:
    """Documents of one subject with overlapping validity and opposite status words."""
    pairs = overlapping_pairs(docs.withColumn("polarity", polarity(F.col("text"))))
    return _proposal(pairs, "contradictory_validity_windows", "left", "right", "contradicts")


def claim_lines(revisions: DataFrame) -> DataFrame:
    """(path, rev, skeleton, line): numeric lines whose skeleton stands for one line of the revision only."""
    lines = revisions.select("path", "rev", F.explode(F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n")).alias("line")).select("path", "rev", F.trim("line").alias("line"))
    numeric = lines.where(F.col("line").rlike(NUMBER)).withColumn("skeleton", skeleton(F.col("line"))).where(F.length("skeleton") >= LEAST_SKELETON)
    return numeric.groupBy("path", "rev", "skeleton").agg(F.min("line").alias("line"), F.max("line").alias("_other")).where("line = _other").drop("_other")


def claim_drift(revisions: DataFrame) -> DataFrame:
    """Claims restated in the next revision of a path with one other number: (path, rev, next_rev, old_line, new_line).

    Both lines have as many numbers, and exactly one of them differs: two differences mean two subjects. An item of a
    list that only has another number in front isn't one.
    """
    order = W.partitionBy("path").orderBy("rev")
    steps = revisions.select("path", "rev").distinct().withColumn("next_rev", F.lead("rev").over(order)).where("next_rev is not null")
    claims = claim_lines(revisions).withColumn("numbers", F.regexp_extract_all("line", F.lit(NUMBER), F.lit(0)))
    new = claims.select("path", F.col("rev").alias("next_rev"), "skeleton", F.col("line").alias("new_line"), F.col("numbers").alias("new_numbers"))
    joined = claims.withColumnRenamed("line", "old_line").join(steps, ["path", "rev"]).join(new, ["path", "next_rev", "skeleton"])
    changed = F.filter(F.transform(F.arrays_zip("numbers", "new_numbers"), lambda n, i: F.when(n["numbers"] != n["new_numbers"], i)), lambda i: i.isNotNull())
    renumbered = (F.get(F.col("changed"), F.lit(0)) == 0) & F.col("old_line").rlike(LIST_MARKER) & F.col("new_line").rlike(LIST_MARKER)
    one = joined.where(F.size("numbers") == F.size("new_numbers")).withColumn("changed", changed).where((F.size("changed") == 1) & ~renumbered)
    return one.select("path", "rev", "next_rev", "old_line", "new_line")


def extract_claims(docs: DataFrame) -> DataFrame:
    """(file, kind, value) found by the patterns: supersession, valid_from, valid_until, status."""
    text = F.coalesce("text", F.lit(""))
    kinds = {"supersession": DIRECT_REFERENCE, "valid_from": VALID_FROM, "valid_until": VALID_UNTIL, "status": STATUS}

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    each = [found(k, p) for k, p in kinds.items()]
    return docs.select("file", F.explode(F.concat(*each)).alias("c")).select("file", "c.kind", "c.value").distinct()


def judge_claims(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds reason: the first rung that a claim (file, kind, value, quote) fails, or accepted.

    Rungs: quote not in the body, target not exactly one other file, date not a date or not in the body, status
    outside the vocabulary.
    """
    names = docs.select("file", supersedes_key(F.col("file")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("only"))
    joined = claims.withColumn("key", F.when(F.col("kind") == "supersession", supersedes_key(F.regexp_replace("value", r"[.,;:)]+$", "")))).join(docs.select("file", "text"), "file").join(names, "key", "left")
    dated = F.col("kind").isin("valid_from", "valid_until")
    reason = (
        F.when(F.col("quote").isNull() | ~F.contains("text", "quote"), "quote_not_verbatim")
        .when((F.col("kind") == "supersession") & (F.coalesce("n", F.lit(0)) != 1), "target_not_in_corpus")
        .when((F.col("kind") == "supersession") & (F.col("only") == F.col("file")), "self_reference")
        .when(dated & F.try_to_timestamp("value", F.lit("yyyy-MM-dd")).isNull(), "not_a_date")
        .when(dated & ~F.contains("text", "value"), "date_not_in_body")
        .when((F.col("kind") == "status") & ~F.lower("value").isin(*STATUSES), "unknown_status").otherwise("accepted")
    )
    return joined.select("file", "kind", "value", "quote", reason.alias("reason"))


def lint(docs: DataFrame) -> DataFrame:
    """(file, level, code) for ``docs`` (file, text, supersedes, valid_from, valid_until), all rules.

    Codes: invalid-date, self-supersedes, dangling-supersedes, ambiguous-supersedes-target, supersession-cycle,
    version-sibling-unlinked, closure-marker-unlinked. A cycle is reported for its least file.
    """
    date = r"^\d{4}-\d{2}-\d{2}$"
    bad = lambda c: F.col(c).isNotNull() & (F.col(c) != "") & F.try_to_timestamp(F.when(F.col(c).rlike(date), F.col(c)), F.lit("yyyy-MM-dd")).isNull()
    issue = lambda df, level, code: df.select("file", F.lit(level).alias("level"), F.lit(code).alias("code"))
    key = supersedes_key
    claims = docs.select("file", "supersedes", F.lit(None).cast("timestamp").alias("first_indexed"))
    resolved = resolve_references(claims)
    own = resolved.where(key(F.col("supersedes")) == key(F.col("file")))
    others = resolved.where(key(F.col("supersedes")) != key(F.col("file")))
    linked = others.where("status <> 'dangling'").select(key(F.col("supersedes")).alias("stem")).distinct()
    base, number = version_of(F.col("file"))
    named = docs.select("file", base.alias("base"), number.alias("version")).where("version is not null").distinct()
    siblings = named.withColumn("older", F.lag("file").over(W.partitionBy("base").orderBy("version", "file"))).where("older is not null").withColumn("stem", key(F.col("older")))
    quiet = docs.where("(supersedes is null or supersedes = '') and (valid_until is null or valid_until = '')").withColumn("stem", key(F.col("file")))
    closing = quiet.join(linked, "stem", "left_anti").where(prose(F.col("text")).rlike(CLOSURE_MARKER))
    parts = [
        issue(docs.where(bad("valid_from") | bad("valid_until")), "error", "invalid-date"),
        issue(own, "error", "self-supersedes"), issue(others.where("status = 'dangling'"), "error", "dangling-supersedes"),
        issue(others.where("status = 'ambiguous'"), "error", "ambiguous-supersedes-target"),
        issue(cycles(others.where("status = 'resolved'").select("target", F.col("file").alias("successor"))), "error", "supersession-cycle"),
        issue(siblings.join(linked, "stem", "left_anti"), "warning", "version-sibling-unlinked"),
        issue(closing, "warning", "closure-marker-unlinked"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def _least_reached(edges: DataFrame) -> DataFrame:
    """(node, low): the least node that can be reached along ``edges`` (a, b), the node itself included. A label is
    a node that is reached, so its own label is too: labels jump, and chains take few rounds."""
    labels = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("low")))
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("seen"))
        lower = labels.join(seen, "node", "left").select("node", F.col("low").alias("was"), F.least("low", "seen").alias("mid"))
        after = stored(lower.join(labels.select(F.col("node").alias("mid"), F.col("low").alias("next")), "mid").select("node", "was", F.least("mid", "next").alias("low")))
        labels = after.select("node", "low")
        if after.where("was <> low").isEmpty():
            return labels


def cycles(edges: DataFrame) -> DataFrame:
    """(file): the least file of each set of files that lead to one another along ``edges`` (target, successor).

    A file may name several targets. Files on one cycle reach the same files and are reached by the same, so an edge
    between files whose least reached, or least reaching, files differ is on no cycle and goes. Files for which both
    are the same one form a cycle with it. What is left is looked at again, until no edge is.
    """
    left = stored(edges.select(F.col("target").alias("a"), F.col("successor").alias("b")).where("a is not null and b is not null").distinct())
    found = stored(left.where("a = b").select(F.col("a").alias("file")))
    left = stored(left.where("a <> b"))
    while not left.isEmpty():
        ahead, behind = _least_reached(left), _least_reached(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = ahead.join(behind.withColumnRenamed("low", "back"), "node")
        one, two = (both.select(F.col("node").alias(c), F.struct("low", "back").alias(f"{c}_on")) for c in "ab")
        same = stored(left.join(one, "a").join(two, "b").where("a_on = b_on").select("a", "b", "a_on.low", "a_on.back"))
        found = stored(found.union(same.where("low = back").select("low")).distinct())
        left = stored(same.where("low <> back").select("a", "b"))
    return found


def graph_diagnostics(docs: DataFrame) -> DataFrame:
    """(kind, file) of the supersession graph: orphaned_node, duplicate_entity_candidate, unresolved_reference,
    ambiguous_reference, conflicting_authored_claim."""
    files = docs.select("file").distinct().withColumn("stem", supersedes_key(F.col("file")))
    resolved = resolve_references(docs.select("file", "supersedes", F.lit(None).cast("timestamp").alias("first_indexed")))
    good = resolved.where("status = 'resolved'")
    touched = good.select("file").union(good.select("target")).distinct()
    several = files.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("stem"))).where("n > 1")
    claimed = good.groupBy("target").agg(F.count_distinct("file").alias("n")).where("n > 1")
    kind = lambda df, k, c="file": df.select(F.lit(k).alias("kind"), F.col(c).alias("file"))
    parts = [
        kind(files.join(touched, "file", "left_anti"), "orphaned_node"), kind(several, "duplicate_entity_candidate"),
        kind(resolved.where("status = 'dangling'"), "unresolved_reference"), kind(resolved.where("status = 'ambiguous'"), "ambiguous_reference"),
        kind(claimed, "conflicting_authored_claim", "target"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()
