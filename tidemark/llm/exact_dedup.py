"""Exact deduplication with a log-structured merge index of digests. Native: no Python runs on the executors.

Each input split is a memtable: its (digest, identifier) pairs are sorted and flushed as a Parquet run of level 0.
Filters decide what is merged: short hashes of all runs' digests are counted, and a bitmap of those that occur twice,
of a fixed size, tells of each entry whether it can have an equal. Entries that it rules out are in one run, once, and
are neither merged nor shuffled. The others are compacted level by level, FAN_IN runs to one, until one entry a digest
is left: the identifier that is kept and the number of rows. Digests of two rows and more are hits; a bitmap of
them lets the second scan of the texts shuffle only hits, whose bytes are compared before rows count as equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import key_filter, marked, maybe_in, split_join, stored, without


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


#: Runs of level 0, and runs that a compaction merges into one of the next level.
RUNS, FAN_IN = 64, 8
#: Rows of a digest from which they are dealt to several tasks where they meet the index.
HOT_ROWS = 4096
_PICK = {"largest": F.max, "smallest": F.min}


def flush_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_digest) -> DataFrame:
    """Level 0: (run, digest, id), a sorted file of one run for each input split."""
    rows = docs.select(F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run"), digest(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), F.col(id_col).cast("long").alias("id"))
    return stored(rows, sort=["digest", "id"])


def repeated_filter(runs: DataFrame) -> DataFrame:
    """A key_filter of the digests that can occur twice in ``runs``."""
    short = runs.groupBy(F.xxhash64("digest").alias("short")).agg(F.count(F.lit(1)).alias("n"))
    return stored(key_filter(short.where("n > 1"), "short"))


def compact(entries: DataFrame, keep: str = "largest") -> DataFrame:
    """(digest, keep_id, group_size) of ``entries`` (run, digest, keep_id, group_size): FAN_IN runs are merged to one
    of the next level as often as it takes. The entries of several indexes can be compacted too."""
    runs = RUNS
    while runs > 1:
        runs = -(-runs // FAN_IN)
        entries = entries.groupBy(F.expr(f"run div {FAN_IN}").alias("run"), "digest").agg(_PICK[keep]("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return entries.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest=sha256_digest) -> DataFrame:
    """One row for each input row: id_col, keep_id, group_size, kept, digest.

    A null text counts as empty. Of equal texts the row with the largest (or smallest) identifier stays; rows
    that repeat both text and identifier are alike and all kept or all dropped. A null identifier stays only if
    no row of its group has one; its keep_id is null then. Texts of any length are digested and compared whole.
    Columns of ``docs`` beyond the two are not read, so their names can't clash. An empty table gives an empty result.
    """
    runs = flush_runs(docs, id_col, text_col, digest)
    filtered = marked(runs, F.xxhash64("digest"), repeated_filter(runs), "again")
    again = filtered.where("again").select("run", "digest", "id")
    index = stored(compact(again.select("run", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")), keep), sort=["digest"])
    hits = index.where("group_size > 1").select("digest")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("body")).withColumn("digest", digest(F.col("body")))
    # Equal bytes: the least and the greatest text of a digest are the same. Both are combined before the shuffle.
    verified = maybe_in(texts, "digest", key_filter(hits, "digest")).groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    clashing = stored(verified.where("low <> high").select("digest"))
    once = filtered.where("not again").select("digest", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    merged = split_join(again.select("digest", "id"), index, "digest", index.where(F.col("group_size") > HOT_ROWS).select("digest"), "id")
    result = once.union(merged.select("digest", "id", "keep_id", "group_size"))
    if not clashing.isEmpty():
        result = result.join(clashing, "digest", "left_anti").unionByName(_by_text(docs, clashing, id_col, text_col, keep, digest))
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return result.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "digest")


def _by_text(docs: DataFrame, clashing: DataFrame, id_col: str, text_col: str, keep: str, digest) -> DataFrame:
    """The exact way for digests that different texts share: group by the text itself."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).withColumn("digest", digest(F.col("body"))).join(clashing, "digest", "left_semi")
    groups = rows.groupBy("digest", "body").agg(_PICK[keep]("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["digest", "body"]).select("digest", "id", "keep_id", "group_size")


def keep_first_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The documents that stay, one for each text, with the columns of ``docs``.

    Identifiers must be unique; rows without one can't be named, and stay.
    """
    return without(docs, exact_dedup(docs, keep=keep).where(~F.col("kept")).select("doc_id"), "doc_id")
