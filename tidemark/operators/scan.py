"""Segmented scans: what comes before a row of its group, as a composition of associative states.

Rows are sorted by ranges of (group, order), so a long group is spread over tasks. A task composes along its rows; for
groups that go on in the next task one composed state each is chained, at most two a task. So no group is gathered
and no state is built up row by row across tasks. States travel as JSON.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import stored


def scan(rows: DataFrame, by: str, order: list[str], lift: Callable, compose: Callable, start, keep: list[str]) -> DataFrame:
    """(by, *keep, state): for each row the state of its group's rows before and including it, as JSON.

    ``lift(row)`` is a row's state and ``compose(a, b)`` that of b behind a; it is associative, and ``start`` is
    neutral. Ties of ``order`` are taken in any order. Rows without a group are left out.
    """
    kind = rows.schema[by].dataType.simpleString()
    columns = list(dict.fromkeys([by, *order, *keep]))
    ranged = rows.where(F.col(by).isNotNull()).repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("_part", F.spark_partition_id())
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state, first = None, start, True
        part = None
        for b in batches:
            b = b.astype({by: object})
            states, edges = [], []
            for r in b.to_dict("records"):
                part = r["_part"]
                if first or r[by] != group:
                    if not first:
                        edges.append((group, state))
                    group, state, first = r[by], start, False
                state = compose(state, lift(r))
                states.append(json.dumps(state))
            yield b[columns].assign(_part=b["_part"], _state=states, _edge=False)
        if part is not None:
            row = {c: None for c in columns} | {by: group, "_part": part, "_state": json.dumps(state), "_edge": True}
            yield pd.DataFrame([row]).astype(object)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        carried, out = start, []
        for group, part, state in pdf[[by, "_part", "_state"]].sort_values("_part").itertuples(index=False, name=None):
            out.append((group, part, json.dumps(carried)))
            carried = compose(carried, json.loads(state))
        return pd.DataFrame(out, columns=[by, "_part", "_carried"])

    made = stored(ranged.mapInPandas(local, f"{kept}, _part int, _state string, _edge boolean"))
    # The last group of each task is carried on to the tasks after it: a row a task.
    edges = made.where("_edge").select(by, "_part", "_state")
    places = made.where("not _edge").select(by, "_part").distinct().join(F.broadcast(edges.select(by).distinct()), by, "left_semi")
    slots = places.join(edges, [by, "_part"], "left").select(by, "_part", F.coalesce("_state", F.lit(json.dumps(start))).alias("_state"))
    carried = slots.groupBy(by).applyInPandas(chain, f"`{by}` {kind}, _part int, _carried string")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            states = [s if c is None or c == empty else json.dumps(compose(json.loads(c), json.loads(s))) for s, c in zip(b["_state"], b["_carried"], strict=True)]
            yield b[columns].assign(state=states)

    empty = json.dumps(start)
    joined = made.where("not _edge").join(F.broadcast(carried), [by, "_part"], "left")
    return joined.mapInPandas(whole, f"{kept}, state string")
