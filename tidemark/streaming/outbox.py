"""Ordered replay of an operation outbox as a stream: keyed state holds back what comes before its turn.

Each tenant's operations have sequence numbers from 0 without gaps. Files may bring them late, twice or out of order;
the state knows the next number and what is waiting, so that each operation comes out once and in turn. A micro-batch
is written to a folder of its own number, over whatever an attempt before has left there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupStateTimeout

OPERATION = "tenant_id long, sequence long, operation_id string, payload string"


def operations(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    return spark.readStream.schema(OPERATION).option("maxFilesPerTrigger", files_at_once).json(folder)


def in_turn(events: DataFrame) -> DataFrame:
    """``events`` (tenant_id, sequence, operation_id, payload), each once, a tenant's by sequence, as soon as all before
    have come. Of two with one number the first to come counts. A tenant's state holds what waits for a gap."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        following, waiting = (state.get[0], json.loads(state.get[1])) if state.exists else (0, {})
        for b in batches:
            for r in b.itertuples(index=False):
                if r.sequence >= following:
                    waiting.setdefault(str(r.sequence), [r.operation_id, r.payload])
        out = []
        while (found := waiting.pop(str(following), None)) is not None:
            out.append((key[0], following, *found))
            following += 1
        state.update((following, json.dumps(waiting)))
        yield pd.DataFrame(out, columns=["tenant_id", "sequence", "operation_id", "payload"])

    return events.where("tenant_id is not null and sequence >= 0").groupBy("tenant_id").applyInPandasWithState(step, OPERATION, "following long, waiting string", "append", GroupStateTimeout.NoTimeout)


def replay(events: DataFrame, out: str, checkpoint: str):
    """Start the replay of what is there (``availableNow``) into ``out``; returns the query. Restarted with the same
    checkpoint it goes on after the last finished micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return in_turn(events).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
