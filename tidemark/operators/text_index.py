"""A stored text index in shards of documents, and top-k searches that skip blocks which can't enter.

A task turns the documents it reads into shards; a row is a term of a shard with its postings by document, cut into
blocks with the greatest frequency and the least length, from which any score that grows with the one and falls with
the other is bounded. Nothing is shuffled, so shards follow the data, and a hot term is spread over all of them.
Document frequencies are stored with the terms. A search brings the asked terms' lists of a shard together, and a shard
passes on its best documents for each query only.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.blockmax import BlockList, best_documents, even_blocks
from tidemark.functions.text import numeric_terms
from tidemark.sources.shared import stored

#: Documents and characters of a shard; words of queries in one pass over the index.
SHARD_DOCS, SHARD_CHARS, PASS_WORDS = 4096, 1 << 23, 1 << 18
#: Asked terms up to which the scan gets their names, so that it skips row groups.
NAMED_TERMS = 4096
#: Room for the order of summation and for rounding to six digits.
SLACK = 2e-6
_KEEP = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
_LISTS = "term string, shard long, n_docs int, df int, docs array<int>, ids array<long>, lens array<int>, tfs array<int>, ends array<int>, tops array<int>, lows array<int>"
_COLUMNS = [c.strip().split()[0] for c in _LISTS.split(",")]


def _words(text: str | None) -> list[bytes]:
    """The words that ``functions.text.tokens`` gives."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()


class _Shard:
    """Documents of a shard as codes of their terms: a term is held once, whatever holds it."""

    def __init__(self):
        self.codes: defaultdict = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.docs, self.chars = [], 0

    def add(self, i: int, text: str | None, numbers: list[str] | None) -> None:
        words, code = _words(text), self.codes.__getitem__
        found, tfs = np.unique(np.fromiter(map(code, words), dtype=np.int32, count=len(words)), return_counts=True)
        more = np.fromiter((code(b"#" + x.encode()) for x in numbers or ()), dtype=np.int32)
        self.docs.append((i, len(words), np.r_[found, more], np.r_[tfs, np.ones(len(more), dtype=np.int64)].astype(np.int32)))
        self.chars += len(text or "")

    def full(self, text: str | None) -> bool:
        return bool(self.docs) and (len(self.docs) >= SHARD_DOCS or self.chars + len(text or "") > SHARD_CHARS)

    def lists(self, shard: int, rows_at_once: int = 8192) -> Iterator[pa.RecordBatch]:
        """A row a term, its lists cut out of whole columns."""
        if not self.codes:
            return
        docs = sorted(self.docs, key=lambda d: d[0])
        codes = np.concatenate([d[2] for d in docs])
        doc = np.repeat(np.arange(len(docs)), [len(d[2]) for d in docs])
        order = np.argsort(codes, kind="stable")
        doc, tf = doc[order].astype(np.int32), np.concatenate([d[3] for d in docs])[order]
        ids, size = np.array([d[0] for d in docs], dtype=np.int64)[doc], np.array([d[1] for d in docs], dtype=np.int32)[doc]
        start = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.codes)))])
        ends = even_blocks(doc, start[:-1])
        first = np.r_[0, ends[:-1] + 1]
        tops, lows = np.maximum.reduceat(tf, first), np.minimum.reduceat(size, first)
        cut = np.searchsorted(ends, start)
        inside = (ends - np.repeat(start[:-1], np.diff(cut))).astype(np.int32)
        terms = list(self.codes)
        for at in range(0, len(terms), rows_at_once):
            to = min(at + rows_at_once, len(terms))

            def listed(values: np.ndarray, of: np.ndarray, at=at, to=to) -> pa.ListArray:
                return pa.ListArray.from_arrays(pa.array((of[at : to + 1] - of[at]).astype(np.int32)), pa.array(values[of[at] : of[to]]))

            n = to - at
            rows = [pa.array([t.decode() for t in terms[at:to]], pa.string()), pa.array(np.full(n, shard)), pa.array(np.full(n, len(docs), dtype=np.int32)), pa.array(np.diff(start[at : to + 1]).astype(np.int32))]
            rows += [listed(x, start) for x in (doc, ids, size, tf)] + [listed(x, cut) for x in (inside, tops, lows)]
            yield pa.RecordBatch.from_arrays(rows, names=_COLUMNS)


def write_index(docs: DataFrame, folder: str) -> None:
    """Index ``docs`` (id, text), in one pass over the texts. Rows without an id count in the figures and aren't found.
    Numbers of a text are terms with a ``#`` in front, which no word has."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = TaskContext.get().partitionId() << 32, _Shard()
        for b in batches:
            for i, text, numbers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held.full(text):
                    yield from held.lists(shard)
                    shard, held = shard + 1, _Shard()
                held.add(i, text, numbers)
        yield from held.lists(shard)

    keyed = docs.where("id is not null").select(F.col("id").cast("long").alias("id"), "text", numeric_terms(F.col("text")).alias("numbers"))
    keyed.mapInArrow(build, _LISTS).sortWithinPartitions("term", "shard").write.parquet(f"{folder}/lists")
    lists = docs.sparkSession.read.parquet(f"{folder}/lists")
    lists.groupBy("term").agg(F.sum("df").alias("df")).sortWithinPartitions("term").write.parquet(f"{folder}/dictionary")
    lengths = lists.where("term not like '#%'").select(F.explode("tfs").alias("tf")).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens"))
    counted = docs.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(lengths)  # one row each
    counted.select("n_docs", (F.col("n_tokens") / F.col("n_docs")).alias("avgdl")).write.parquet(f"{folder}/stats")


@dataclass(frozen=True)
class TextIndex:
    """Postings by term and shard; each term's document frequency; one row of corpus figures."""

    lists: DataFrame
    dictionary: DataFrame
    stats: DataFrame

    @property
    def terms(self) -> DataFrame:
        """(id, n_tokens, term, tf) of all words."""
        return exploded(self.lists.where("term not like '#%'"))

    @property
    def numbers(self) -> DataFrame:
        """(id, number): the numbers of each text."""
        return exploded(self.lists.where("term like '#%'")).select("id", F.expr("substring(term, 2)").alias("number"))


def exploded(lists: DataFrame) -> DataFrame:
    return lists.select("term", F.explode(F.arrays_zip("ids", "lens", "tfs")).alias("p")).select(F.col("p.ids").alias("id"), F.col("p.lens").alias("n_tokens"), "term", F.col("p.tfs").cast("long").alias("tf"))


def read_index(spark: SparkSession, folder: str) -> TextIndex:
    return TextIndex(*(spark.read.parquet(f"{folder}/{name}") for name in ("lists", "dictionary", "stats")))


def _passes(asked: DataFrame) -> Iterator[list]:
    """Rows of whole queries, of PASS_WORDS words or a little more; the driver holds one pass."""
    held: list = []
    for _, rows in groupby(asked.orderBy("query_id").toLocalIterator(), key=lambda r: r.query_id):
        held += rows
        if len(held) >= PASS_WORDS:
            yield held
            held = []
    if held:
        yield held


def search(index: TextIndex, asked: DataFrame, k: int, value: Callable) -> DataFrame:
    """(query_id, id, score): what can be among the k best, by the sum of weight * value(tf, length) of the terms.

    ``asked`` is (query_id, term, weight), a term once a query, weights 0 or more; value takes arrays, grows with tf
    and doesn't with length. Of a query's numbers any one is paid, once; documents with numbers only aren't found.
    """
    spark, best = asked.sparkSession, None
    asked = stored(asked.where("query_id is not null"))
    # A task a shard, about: with a stated number small shards are not put together into a few long tasks.
    tasks = max(spark.sparkContext.defaultParallelism, -(-index.stats.first()["n_docs"] // SHARD_DOCS))
    for rows in _passes(asked):
        by_term = defaultdict(list)
        for r in rows:
            by_term[r.term].append((r.query_id, r.weight))
        sent = spark.sparkContext.broadcast(dict(by_term))

        def best_of(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            def found(lists: dict, n: int) -> pd.DataFrame:
                wanted, once = defaultdict(list), defaultdict(list)
                for term, postings in lists.items():
                    for query, weight in sent.value[term]:
                        (once if term.startswith("#") else wanted)[query].append((weight, postings))
                out = []
                for query, some in wanted.items():
                    if query in once:  # one list of all documents with a word and any of the numbers
                        docs = np.intersect1d(np.concatenate([p.docs for _, p in once[query]]), np.concatenate([p.docs for _, p in some]))
                    if query in once and len(docs):
                        ends = even_blocks(docs, np.array([0]))
                        some = [*some, (once[query][0][0], BlockList(docs, np.ones(len(docs)), ends, np.ones(len(ends))))]
                    docs, scores, _ = best_documents(some, n, k, 0.0, SLACK)
                    out.append((query, docs, scores))
                ids = np.zeros(n, dtype=np.int64)
                for p in lists.values():
                    ids[p.docs] = p.ids
                sizes = [len(d) for _, d, _ in out]
                every = np.concatenate([np.zeros(0, dtype=np.int64), *(d for _, d, _ in out)])
                return pd.DataFrame({"query_id": np.repeat([q for q, _, _ in out], sizes), "id": ids[every], "score": np.concatenate([np.zeros(0), *(s for *_, s in out)])})

            shard, lists, n = None, {}, 0
            for b in batches:
                for r in b.itertuples(index=False):
                    if r.shard != shard:
                        if lists:
                            yield found(lists, n)
                        shard, lists, n = r.shard, {}, r.n_docs
                    lists[r.term] = BlockList(r.docs, value(r.tfs.astype(float), r.lens.astype(float)), r.ends, value(r.tops.astype(float), r.lows.astype(float)))
                    lists[r.term].ids = r.ids
            if lists:
                yield found(lists, n)

        names = sorted(by_term)
        lists = index.lists.where(F.col("term").isin(names)) if len(names) <= NAMED_TERMS else index.lists.join(F.broadcast(spark.createDataFrame([(t,) for t in names], "term string")), "term", "left_semi")
        part = lists.drop("df").repartition(tasks, "shard").sortWithinPartitions("shard").mapInPandas(best_of, "query_id long, id long, score double")
        best = part if best is None else stored(best).unionByName(stored(part))
    return spark.createDataFrame([], "query_id long, id long, score double") if best is None else best
