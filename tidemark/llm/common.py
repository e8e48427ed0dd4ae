"""Shared helpers: reading tables, tables in the shared folder, bounded Arrow batches, label folds."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import shared_dir

#: Rows of text that a Python worker holds at once; texts can be over 100 kB.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where its folder exists, and keep Arrow batches small.

    The number of rows in a batch is a setting of the session; it is only lowered.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def stored(df: DataFrame, sort: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the session's shared folder and read it back, which cuts its lineage.

    ``tidemark.sources.shared.clear`` deletes the folder when no result is read any more.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a filter over keys: 2^25 bits are 4 MB, whatever the input; a filter that is full lets all rows through.
FILTER_BITS = 1 << 25
#: Bits in one row that bitmap_construct_agg returns.
BITMAP_BITS = 32768


#: Keys up to which ``without`` broadcasts them: 16 MB.
BROADCAST_KEYS = 1_000_000
#: Tasks that the rows of a hot key are dealt to.
SALTS = 64


def _slot(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def key_filter(keys: DataFrame, key: Column | str) -> DataFrame:
    """(bucket, bits): a bitmap of the keys' hashes, FILTER_BITS / 8 bytes at most."""
    slots = keys.select(_slot(key).alias("slot"))
    return slots.groupBy(F.expr(f"slot div {BITMAP_BITS}").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(pmod(slot, {BITMAP_BITS}))").alias("bits"))


def marked(rows: DataFrame, key: Column | str, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` and a boolean ``name``: false if the key is certainly not among ``keys`` (a key_filter)."""
    packed = rows.select(F.struct("*").alias("row"), _slot(key).alias("slot")).withColumn("bucket", F.expr(f"slot div {BITMAP_BITS}"))
    byte = F.expr(f"cast(conv(hex(substring(bits, cast(pmod(slot, {BITMAP_BITS}) div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.expr("shiftleft(1, cast(pmod(slot, 8) as int))")
    return packed.join(F.broadcast(keys), "bucket", "left").select("row.*", F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False)).alias(name))


def maybe_in(rows: DataFrame, key: Column | str, keys: DataFrame) -> DataFrame:
    """The rows whose key is in ``keys`` (a key_filter), and a few others; what is not shuffled is not paid for."""
    return marked(rows, key, keys, "_maybe").where("_maybe").drop("_maybe")


def split_join(rows: DataFrame, index: DataFrame, key: str, hot: DataFrame, by: str) -> DataFrame:
    """``rows`` joined with ``index``, which has a row a key, on ``key``. Rows of the keys in ``hot`` are dealt to
    SALTS tasks by a hash of the column ``by``; the index rows of these keys are repeated for them."""
    hot = stored(hot)
    if hot.isEmpty():
        return rows.join(index, key)
    keys = stored(key_filter(hot, key))
    salted = marked(rows, key, keys, "_hot").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0)).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return salted.join(marked(index, key, keys, "_hot").withColumn("_salt", F.explode(salts)).drop("_hot"), [key, "_salt"]).drop("_salt")


def without(rows: DataFrame, dropped: DataFrame, column: str) -> DataFrame:
    """``rows`` but for those whose ``column`` is in ``dropped``; a null stays. Only rows in doubt are shuffled.

    ``rows`` is read twice where there are over BROADCAST_KEYS keys, so it should be a stored table.
    """
    dropped = stored(dropped.select(F.col(column).alias("_key")).where("_key is not null").distinct())
    keyed = rows.select(F.struct("*").alias("_row"), F.col(column).alias("_key"))
    if dropped.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        return keyed.join(F.broadcast(dropped), "_key", "left_anti").select("_row.*")
    doubtful = marked(keyed, "_key", key_filter(dropped, "_key"), "_maybe")
    kept = doubtful.where("_maybe").join(dropped, "_key", "left_anti").select("_row.*")
    return doubtful.where("not _maybe").select("_row.*").union(kept)


def fold(column: Column | str, modulus: int) -> Column:
    """crc32 of an identifier's text modulo ``modulus``; a null identifier gives null."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % F.lit(modulus)


def hashed_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by ``|``; any engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, train: Column) -> DataFrame:
    """(doc_id, text, label) of about ``rows`` labelled documents for which ``train`` holds.

    The sample is the identifiers whose hash is under a threshold, so no task sorts or gathers the corpus.
    Its identifiers are at most a little over ``rows`` and are broadcast to the scan of ``docs``.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    total = known.count()
    if total > rows:
        known = known.where(hashed_unit(F.lit("sample"), F.col("doc_id").cast("string")) < rows / total)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
