"""Comparing the texts of candidate pairs with bounded memory.

A pair is (rep, id). Pairs of one rep are dealt to chunks by a hash of the id, so a rep that a third of all rows
point to makes many groups, and only reps with over CHUNK pairs are looked up for that. A group's rows are
streamed, the rep's text first, so a task holds a batch and one rep.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import key_filter, maybe_in, stored

#: Pairs in a group, on average, as far as a rep has no more than MOST_CHUNKS groups; larger ones are streamed too.
CHUNK, MOST_CHUNKS = 32, 1024
#: Reps with more than one chunk up to which their number of chunks is broadcast.
BROADCAST_REPS = 200_000


def dealt(pairs: DataFrame) -> DataFrame:
    """``pairs`` (rep, id), read twice, and the chunk of each; rows of a hot rep are not brought together."""
    hot = stored(pairs.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK).select("rep", F.least(F.ceil(F.col("n") / CHUNK), F.lit(MOST_CHUNKS)).alias("chunks")))
    hot = F.broadcast(hot) if hot.limit(BROADCAST_REPS + 1).count() <= BROADCAST_REPS else hot
    return pairs.join(hot, "rep", "left").select("rep", F.pmod(F.xxhash64("id"), F.coalesce("chunks", F.lit(1))).alias("chunk"), "id")


def verified_pairs(pairs: DataFrame, texts: DataFrame, prepare, compare, columns: list[str], prepare_all=None) -> DataFrame:
    """Rows (rep, id, *columns) for each tuple of ``compare(prepare(id's text), prepare(rep's text))``.

    ``pairs`` (rep, id) must be written or cheap, as it is read more than once; ``texts`` is (id, text). columns
    are long. ``prepare_all`` does for a list of texts in order what ``prepare`` does for one.
    """
    chunked = stored(dealt(pairs))  # it is read twice
    # Only texts of pairs are shuffled, and once: both joins read the same exchange.
    named = pairs.select("id").union(pairs.select("rep"))
    some = maybe_in(texts.select("id", "text"), "id", key_filter(named, "id")).repartition("id")
    left = chunked.join(some, "id").select("rep", "chunk", "id", "text")
    reps = some.select(F.col("id").alias("rep"), "text")
    right = chunked.select("rep", "chunk").distinct().join(reps, "rep").select("rep", "chunk", F.lit(None).cast("long").alias("id"), "text")
    rows = left.unionByName(right)
    dealt_out = rows.repartition("rep", "chunk").sortWithinPartitions("rep", "chunk", F.col("id").asc_nulls_first())

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, rep = None, None  # a group may go on in the next batch; its rep comes first
        for b in batches:
            out: list[tuple] = []
            texts = b.text.tolist()
            made = prepare_all(texts) if prepare_all else texts
            for r, chunk, i, x in zip(b.rep.tolist(), b.chunk.tolist(), b.id.tolist(), made, strict=True):
                if pd.isna(i):
                    if current is None or current[0] != r:
                        rep = x if prepare_all else prepare(x)
                    current = (r, chunk)
                elif current == (r, chunk):
                    out += [(r, int(i), *found) for found in compare(x if prepare_all else prepare(x), rep)]
            yield pd.DataFrame(out, columns=["rep", "id", *columns]).astype("int64")

    return dealt_out.mapInPandas(check, ", ".join(f"{c} long" for c in ["rep", "id", *columns]))
