"""Ranked lexical search over stored postings by variable blocks with maxima.

Documents are indexed where they are read: a task cuts them into shards of a bounded size and writes, for each term of
a shard, its postings (document, impact) by document. A posting's impact is its score without the term's weight, so
the weights can be asked for later. Postings are cut into blocks of varying length by dynamic programming: of all
ways to cut a list, the one that makes the sum of the bound errors (block maximum less impact, for all documents in the
block's range) and of BLOCK_COST for each block least.

A search meets a shard's lists of the asked terms in one task. The weighted maxima of the blocks that stand over a
document bound its score; where blocks begin and end, the bound changes. Only the stretches of documents whose bound
reaches the threshold are pivots: blocks that lie in none of them are skipped, the others are read and scored whole,
those of the highest bounds first, as they raise the threshold. It begins at the k-th impact of any of the item's
terms in any shard. So the rows are exact, and each shard passes on k documents an item at most.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.blockmax import BlockList, best_documents, within
from tidemark.llm.common import ready_workers, stored

#: Characters and documents of a shard.
SHARD_CHARS, SHARD_DOCS = 1 << 24, 1 << 15
#: Most postings of a block; what a block costs, in units of impact; postings cut by one run of the program.
MOST_BLOCK, BLOCK_COST, PIECE = 64, 1 << 20, 1024
#: Lists whose pieces are cut together, rows of the index written together.
TOGETHER, ROWS = 4096, 8192
#: Words of items in one pass over the index, which go to all tasks.
PASS_WORDS = 1 << 18
#: Fixed values of the score.
K = 50
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of letters and digits of ASCII and of all other characters; only A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


def impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What postings add to a score for each unit of weight; ``size`` is the document's number of terms."""
    m = 50 + (50 * size * n_docs) // max(1, n_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def block_ends(values: np.ndarray, docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each of ``values`` ends a block; the lists lie one after the other, and none is longer than PIECE.

    A block bounds every document from its first to its last, those between its postings too, so its part of the
    error is its maximum times that range. The program runs over all lists in step. For each length of the last block
    it holds the best cost of what comes before, the block's maximum and its first document; from one value to the
    next they move on by one length.
    """
    docs = docs.astype(np.int64)
    ends, last = np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    for at in range(0, len(order), TOGETHER):
        some = order[at : at + TOGETHER]
        begin, size = starts[some], sizes[some]
        before = np.full((len(some), MOST_BLOCK), np.int64(1) << 60)
        before[:, 0] = 0
        top, first = np.zeros((len(some), MOST_BLOCK), dtype=np.int64), np.zeros((len(some), MOST_BLOCK), dtype=np.int64)
        for i in range(size[0] if len(size) else 0):
            n = np.searchsorted(-size, -i, side="left")  # lists that are longer than i
            here, before, top, first = begin[:n] + i, before[:n], top[:n], first[:n]
            top[:, 1:] = top[:, :-1]
            top[:, 0] = 0
            np.maximum(top, values[here][:, None], out=top)
            first[:, 1:] = first[:, :-1]
            first[:, 0] = docs[here]
            cost = before + top * (docs[here][:, None] + 1 - first)
            best = cost.argmin(axis=1)
            last[here] = best + 1
            before[:, 1:] = before[:, :-1]
            before[:, 0] = cost[np.arange(n), best] + BLOCK_COST
        left, length = begin + size - 1, begin
        while len(left):
            ends[left] = True
            left = left - last[left]
            on = left >= length
            left, length = left[on], length[on]
    return ends


def _shard_rows(shard: int, ids: list, texts: list[list[bytes]], n_docs: int, n_terms: int) -> Iterator[pd.DataFrame]:
    """A row for each term of the shard, and one without a term for its identifiers, nulls at the end."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    known = np.array([ids[i] for i in order if ids[i] is not None], dtype=np.int64)
    yield pd.DataFrame([[shard, None, len(ids), 0, known.tobytes(), b"", b"", b""]], columns=INDEX_COLUMNS)
    words, counts, sizes, distinct = [], [], [], []
    for i in order:
        found = Counter(texts[i])
        words.extend(found.keys())
        counts.extend(found.values())
        sizes.append(len(texts[i]))
        distinct.append(len(found))
    if not words:
        return
    codes, names = pd.factorize(np.array(words, dtype=object))
    docs = np.repeat(np.arange(len(order), dtype=np.uint32), distinct)
    value = impacts(np.array(counts, dtype=np.int64), np.array(sizes, dtype=np.int64)[docs], n_docs, n_terms)
    by_term = np.argsort(codes, kind="stable")
    docs, value = docs[by_term], value[by_term]
    df = np.bincount(codes, minlength=len(names))
    start = np.concatenate([[0], np.cumsum(df)])
    pieces = np.repeat(start[:-1], -(-df // PIECE)) + PIECE * within(-(-df // PIECE))
    size = np.minimum(np.repeat(start[1:], -(-df // PIECE)) - pieces, PIECE)
    ends = np.flatnonzero(block_ends(value, docs, pieces, size))
    tops = np.maximum.reduceat(value, np.concatenate([[0], ends[:-1] + 1])).astype(np.int32)
    cut = np.searchsorted(ends, start)
    value = value.astype(np.int32)
    for at in range(0, len(names), ROWS):
        rows = []
        for t in range(at, min(at + ROWS, len(names))):
            a, b, c, d = start[t], start[t + 1], cut[t], cut[t + 1]
            kth = int(np.partition(value[a:b], -K)[-K]) if b - a >= K else 0
            rows.append([shard, names[t].decode("utf-8", "replace"), int(b - a), kth, docs[a:b].tobytes(), value[a:b].tobytes(), (ends[c:d] - a).astype(np.uint32).tobytes(), tops[c:d].tobytes()])
        yield pd.DataFrame(rows, columns=INDEX_COLUMNS)


INDEX_COLUMNS = ["shard", "term", "df", "kth", "docs", "impacts", "ends", "tops"]
_SCHEMA = "shard long, term string, df long, kth long, docs binary, impacts binary, ends binary, tops binary"


@dataclass(frozen=True)
class RankedIndex:
    """Stored postings by shard and term, documents with a term, and all their terms."""

    postings: DataFrame
    n_docs: int
    n_terms: int


def ranked_index(docs: DataFrame) -> RankedIndex:
    """The index of ``docs`` (doc_id, text). Texts are read twice and shuffled not at all; a text of any length is read
    whole and may be a shard of its own."""
    ready_workers(docs.sparkSession)

    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(terms(t))).astype("int64")

    counted = docs.select(size("text").alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = counted[0], counted[1]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, ids, texts, chars = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for i, no_id, text in zip(b.id.tolist(), b.no_id.tolist(), b.text.tolist(), strict=True):
                if ids and (chars + len(text or "") > SHARD_CHARS or len(ids) >= SHARD_DOCS):
                    yield from _shard_rows(shard, ids, texts, n_docs, n_terms)
                    shard, ids, texts, chars = shard + 1, [], [], 0
                ids.append(None if no_id else i)
                texts.append(terms(text))
                chars += len(text or "")
        if ids:
            yield from _shard_rows(shard, ids, texts, n_docs, n_terms)

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text")
    return RankedIndex(stored(keyed.mapInPandas(build, _SCHEMA)), n_docs, n_terms)


def postings(docs: bytes, values: bytes, ends: bytes, tops: bytes) -> BlockList:
    """One term's postings in a shard, as they are stored."""
    return BlockList(*(np.frombuffer(x, dtype=t).astype(np.int64) for x, t in zip((docs, values, ends, tops), (np.uint32, np.int32, np.uint32, np.int32), strict=True)))


def _search(sent, k: int):
    """Rows of one shard come together, the one without a term first."""

    def found(items: list, asked: dict, least: list, n: int, ids: np.ndarray, lists: dict) -> pd.DataFrame:
        wanted = defaultdict(list)
        for term, p in lists.items():
            for item, weight in asked[term]:
                if weight > 0:
                    wanted[item].append((weight, p))
        rows = []
        for item, some in wanted.items():
            docs, scores, _ = best_documents(some, n, k, max(1, least[item]))
            rows += [(items[item], int(ids[d]) if d < len(ids) else None, s) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
        made = pd.DataFrame(rows, columns=["item_id", "doc_id", "score"]).astype({"item_id": object, "doc_id": object})
        return made.where(made.notna(), None)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, asked, least = sent.value
        shard, n, ids, lists = None, 0, None, {}
        for b in batches:
            for r in b.itertuples(index=False):
                if r.shard != shard:
                    if lists:
                        yield found(items, asked, least, n, ids, lists)
                    shard, lists = r.shard, {}
                if r.term is None:
                    n, ids = r.df, np.frombuffer(r.docs, dtype=np.int64)
                else:
                    lists[r.term] = postings(r.docs, r.impacts, r.ends, r.tops)
        if lists:
            yield found(items, asked, least, n, ids, lists)

    return search


def _passes(asked: DataFrame) -> Iterator[list[tuple]]:
    """(item_id, its terms) of as many items as have PASS_WORDS words; the driver holds one pass."""
    rows = asked.orderBy(F.col("item_id").asc_nulls_first(), "term").toLocalIterator()
    held, size = [], 0
    for item, group in groupby(rows, key=lambda r: r.item_id):
        held.append((item, [r.term for r in group]))
        size += len(held[-1][1])
        if size >= PASS_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _one_pass(index: RankedIndex, held: list[tuple], k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best of each shard, as far as they can be among the k best of all."""
    spark = index.postings.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in sorted({t for _, ts in held for t in ts})], "term string").withColumn("asked", F.lit(True)))
    facts = index.postings.join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df"), F.max("kth").alias("kth"))
    weight = F.floor(1000 * F.ln((2.0 * index.n_docs + 2) / (2.0 * F.col("df") + 1)))
    known = {r.term: (r.weight, r.kth) for r in facts.select("term", weight.alias("weight"), "kth").collect()}  # the words of one pass
    asked = defaultdict(list)
    least = [0] * len(held)
    for n, (_, ts) in enumerate(held):
        for t in ts:
            if t in known:
                asked[t].append((n, known[t][0]))
                least[n] = max(least[n], known[t][0] * known[t][1])
    sent = spark.sparkContext.broadcast(([item for item, _ in held], dict(asked), least))
    lists = index.postings.join(wanted, "term", "left").where("term is null or asked").drop("asked")
    return lists.repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first()).mapInPandas(_search(sent, k), "item_id long, doc_id long, score long")


def ranked_search(index: RankedIndex, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each of ``items`` (item_id, text), by score, then doc_id.

    Rows of ``items`` with one item_id are one item; a null item_id is one too. Null texts have no terms, on either
    side, and find nothing. Rows without a doc_id are documents like others, the last among equal scores; repeated rows
    are ranked each. Empty tables give no rows. Other columns are not read. Items are searched in passes of PASS_WORDS
    words, which are what is sent to all tasks. ``k`` is K at most, as the index knows the K-th impact of each list.
    """
    spark = index.postings.sparkSession
    ready_workers(spark)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), 0)
    asked = stored(items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(words).alias("term")).distinct())
    best = None
    for held in _passes(asked):
        part = _one_pass(index, held, k)
        best = part if best is None else stored(best).unionByName(stored(part))
    if best is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
