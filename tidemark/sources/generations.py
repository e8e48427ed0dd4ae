"""Committed generations of a corpus on shared storage: staged, checked, and swapped in by one record of a log.

A tenant's folder holds a log and the generations' data. Each record of the log is a file of the next number that is
made whole first and then renamed to its place, which fails if another writer has taken that number. Rows are staged
under a folder of their own; a generation has rows only once a record names that folder, and readers follow the last
record that names an active generation. So whatever fails, readers see one whole generation, what was staged without
a record is never read, and a retry does what is left to do. The log has a record an action of a tenant, which the
driver reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import lifecycle
from tidemark.operators.governance import validate


class GenerationError(Exception):
    """An action that the state of a generation doesn't allow."""


class Conflict(GenerationError):
    """Another writer has added the next record first; read the log again and retry."""


@dataclass
class Log:
    """What a tenant's records add up to."""

    version: int = 0
    states: dict[str, str] = field(default_factory=dict)
    folders: dict[str, str] = field(default_factory=dict)
    digests: dict[str, str] = field(default_factory=dict)
    active: str | None = None
    previous: str | None = None

    def add(self, record: dict) -> None:
        self.version += 1
        name, state = record.get("generation_id"), record.get("state")
        if record["action"] == "stage":
            self.folders[name], self.digests[name] = record["folder"], record["digest"]
        elif record["action"] == "swap":
            if self.active is not None:
                self.states[self.active] = record["leaves"]
            self.active, self.previous, self.states[name] = name, self.active, "active"
        else:
            self.states[name] = state


def content_digest(rows: DataFrame) -> str:
    """Number of rows and an order-free sum of their hashes, by column name."""
    hashed = rows.select(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)").alias("h"))
    n, total = hashed.agg(F.count(F.lit(1)), F.coalesce(F.sum("h"), F.lit(0))).first()
    return f"{n}:{total}"


class Generations:
    """One tenant's generations under a shared folder. ``hook`` is called with the name of each step; tests fail there."""

    def __init__(self, spark: SparkSession, root: str, tenant_id: str, hook: Callable[[str], None] = lambda step: None):
        self.spark, self.folder, self.hook = spark, f"{root.rstrip('/')}/tenant={tenant_id}", hook
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), spark._jsc.hadoopConfiguration())
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._fs.mkdirs(self._path(f"{self.folder}/log"))

    def log(self) -> Log:
        found = Log()
        while self._fs.exists(self._path(f"{self.folder}/log/{found.version + 1:012d}.json")):
            stream = self._fs.open(self._path(f"{self.folder}/log/{found.version + 1:012d}.json"))
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            found.add(json.loads(text))
        return found

    def _append(self, log: Log, **record) -> Log:
        """Add the record behind ``log``, or raise Conflict if something is there already."""
        temporary, place = f"{self.folder}/log/.{uuid.uuid4().hex}", f"{self.folder}/log/{log.version + 1:012d}.json"
        stream = self._fs.create(self._path(temporary))
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        try:
            self._context.rename(self._path(temporary), self._path(place), self._no_options)
        except Exception as e:
            self._fs.delete(self._path(temporary), False)
            raise Conflict(f"record {log.version + 1} is taken") from e
        log.add(record)
        return log

    def _require(self, log: Log, generation_id: str, *states: str) -> None:
        if log.states.get(generation_id) not in states:
            raise GenerationError(f"generation {generation_id} is {log.states.get(generation_id, 'unknown')}, not {' or '.join(states)}")

    def create(self, generation_id: str, manifest: DataFrame) -> None:
        """A building generation with its ``manifest`` (uri, sha256). Creating it again is allowed while it builds."""
        log = self.log()
        if log.states.get(generation_id) == "building":
            return
        if generation_id in log.states:
            raise GenerationError(f"generation {generation_id} is {log.states[generation_id]} already")
        manifest.select("uri", "sha256").write.mode("overwrite").parquet(f"{self.folder}/manifests/{generation_id}")
        self._append(log, action="create", generation_id=generation_id, state="building")

    def stage(self, generation_id: str, rows: DataFrame) -> None:
        """Write the rows of a building generation, read them back and check them, and name their folder in the log.
        Rows that are staged already are not written again."""
        log = self.log()
        self._require(log, generation_id, "building")
        digest = content_digest(rows)
        if log.digests.get(generation_id) == digest:
            return
        folder = f"{self.folder}/data/{generation_id}-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        self.hook("written")
        if content_digest(self.spark.read.schema(rows.schema).parquet(folder)) != digest:
            raise GenerationError(f"what was staged for {generation_id} is not what was given")
        self._append(log, action="stage", generation_id=generation_id, folder=folder, digest=digest)
        self.hook("staged")

    def validate(self, generation_id: str) -> str:
        """ready, if the staged rows (uri, sha256, ...) are those of the manifest; else failed."""
        log = self.log()
        if log.states.get(generation_id) == "ready":
            return "ready"
        self._require(log, generation_id, "building")
        manifest = self.spark.read.parquet(f"{self.folder}/manifests/{generation_id}").withColumn("generation_id", F.lit(generation_id))
        staged = self.read(generation_id).select("uri", "sha256").withColumn("generation_id", F.lit(generation_id))
        verdict = validate(manifest, staged).first()
        state = "ready" if verdict is None else verdict.state
        self._append(log, action="validate", generation_id=generation_id, state=state)
        self.hook("validated")
        return state

    def promote(self, generation_id: str) -> None:
        """Readers go over to a ready generation; the active one retires and is the one to roll back to. Promoting the
        active one again changes nothing."""
        log = self.log()
        if log.active == generation_id:
            return
        self._require(log, generation_id, "ready")
        self.hook("before swap")
        self._append(log, action="swap", generation_id=generation_id, leaves="retired")
        self.hook("swapped")

    def rollback(self) -> str:
        """Readers go back to the previous generation; the one they leave is ready again."""
        log = self.log()
        if log.previous is None:
            raise GenerationError("there is no generation to roll back to")
        self._require(log, log.previous, "retired", "ready")
        target = log.previous
        self._append(log, action="swap", generation_id=target, leaves="ready")
        return target

    def fail(self, generation_id: str, reason: str) -> None:
        log = self.log()
        self._require(log, generation_id, "building", "failed")
        self._append(log, action="fail", generation_id=generation_id, state="failed", reason=reason)

    def abandon(self, generation_id: str, reason: str) -> None:
        """Give up a ready generation that nobody would be served by: not the active, nor the one to roll back to."""
        log = self.log()
        self._require(log, generation_id, "ready")
        if generation_id in (log.active, log.previous):
            raise GenerationError(f"generation {generation_id} is what a rollback returns to")
        self._append(log, action="abandon", generation_id=generation_id, state="failed", reason=reason)

    def read(self, generation_id: str | None = None) -> DataFrame:
        """The rows of a generation, the active one unless another is named."""
        log = self.log()
        name = generation_id or log.active
        if name not in log.folders:
            raise GenerationError(f"generation {name} has no rows")
        return self.spark.read.parquet(log.folders[name])

    def collect(self) -> list[str]:
        """Delete what no record names, and the data of failed generations; returns the folders. No writer may be at
        work, as what it stages has no record yet."""
        log = self.log()
        live = {f for name, f in log.folders.items() if log.states[name] != "failed"}
        data = self._path(f"{self.folder}/data")
        gone = [f"{self.folder}/data/{s.getPath().getName()}" for s in (self._fs.listStatus(data) if self._fs.exists(data) else [])]
        gone = [f for f in gone if f not in live]
        for f in gone:
            self._fs.delete(self._path(f), True)
        return gone

    def _next(self, generation_id: str, rows: DataFrame) -> None:
        log = self.log()
        if log.active == generation_id:
            return
        if log.states.get(generation_id) != "ready":
            self.create(generation_id, rows.select("uri", "sha256").distinct())
            self.stage(generation_id, rows)
            if self.validate(generation_id) != "ready":
                raise GenerationError(f"generation {generation_id} failed its check")
        self.promote(generation_id)

    def _as_objects(self, rows: DataFrame) -> DataFrame:
        """A row a chunk: its source and the chunk's own digest stand for the manifest's objects."""
        return rows.withColumn("uri", F.concat_ws("#", "source", "id")).withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))

    def _chunks(self) -> DataFrame | None:
        return self.read().drop("uri", "sha256") if self.log().active else None

    def upsert(self, generation_id: str, new: DataFrame, now: str) -> None:
        """Commit ``new`` (id, source, text) over the active rows as a generation. ``generation_id`` names the operation:
        a retry after any failure goes on where it stopped, and is done once."""
        if self.log().active != generation_id:
            old = self._chunks()
            self._next(generation_id, self._as_objects(lifecycle.upsert(old if old is not None else _no_chunks(self.spark), new, now)))

    def replace_sources(self, generation_id: str, new: DataFrame, sources: DataFrame, now: str) -> None:
        """Commit ``new`` in place of all chunks of ``sources`` as a generation; see ``upsert``."""
        if self.log().active != generation_id:
            old = self._chunks()
            self._next(generation_id, self._as_objects(lifecycle.replace_sources(old if old is not None else _no_chunks(self.spark), new, sources, now)))


def _no_chunks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id string, source string, text string, indexed_at timestamp, first_indexed timestamp")
