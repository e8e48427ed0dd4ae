"""The best documents of a shard from lists of postings whose blocks have upper bounds.

The bounds of the blocks that stand over a document add up to a bound of its score, which changes only where blocks
begin and end. Stretches of documents whose bound reaches the threshold are looked at, those of the highest bounds
first; blocks that lie in none of them are skipped.
"""

from __future__ import annotations

import numpy as np

#: Documents that are scored before the threshold is looked at again: at first, and so many times as many after that.
FIRST_DOCS, GROWTH = 256, 8
#: Most postings of a block of ``even_blocks``, and documents between two postings from which a new block begins.
BLOCK, GAP = 64, 32


def within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``sizes`` in turn."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def even_blocks(docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the blocks of lists end that lie one after the other and begin at ``starts``."""
    first = np.r_[True, np.diff(docs.astype(np.int64)) > GAP][: len(docs)]
    first[starts] = True
    runs = np.flatnonzero(first)
    first[within(np.diff(np.r_[runs, len(docs)])) % BLOCK == 0] = True
    return np.r_[np.flatnonzero(first)[1:] - 1, len(docs) - 1] if len(docs) else np.zeros(0, dtype=np.int64)


class BlockList:
    """Postings by document: documents, values, the place where each block ends, and each block's greatest value."""

    def __init__(self, docs: np.ndarray, values: np.ndarray, ends: np.ndarray, tops: np.ndarray):
        self.docs, self.values, self.ends, self.tops = docs.astype(np.int64), values, ends.astype(np.int64), tops
        self.begins = np.concatenate([[0], self.ends[:-1] + 1])
        self.low, self.high = self.docs[self.begins], self.docs[self.ends]

    def inside(self, wanted: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and values of the postings that are ``wanted``; only blocks with a wanted document in their range
        are read. ``before`` counts the wanted documents before each. Third is the number of postings read."""
        some = np.flatnonzero(before[self.high + 1] > before[self.low])
        sizes = self.ends[some] - self.begins[some] + 1
        at = np.repeat(self.begins[some], sizes) + within(sizes)
        at = at[wanted[self.docs[at]]]
        return self.docs[at], self.values[at], int(sizes.sum())


def best_documents(lists: list[tuple], n: int, k: int, least=0, slack=0) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best of a shard's n documents with a score of ``least`` or more, for (weight, BlockList) of the terms:
    documents, scores, and the number of postings read. Equal scores go by document; with ``slack`` all documents
    that are no more than that under the k-th are returned, and bounds may be that much too low."""
    places = np.concatenate([x for _, p in lists for x in (p.low, p.high + 1)])
    change = np.concatenate([x for w, p in lists for x in (w * p.tops, -w * p.tops)])
    order = np.argsort(places, kind="stable")
    places, bound = places[order], np.cumsum(change[order])
    last = np.r_[places[1:] != places[:-1], True]
    begin, bound = places[last], bound[last]
    end = np.r_[begin[1:], n]
    threshold, read, goal = least, 0, FIRST_DOCS
    total = np.zeros(n, dtype=change.dtype)
    docs, scores = np.zeros(0, dtype=np.int64), total[:0]
    order = np.argsort(-bound, kind="stable")
    begin, end, bound = begin[order], end[order], bound[order]
    while len(bound):
        pivots = np.searchsorted(-bound, slack - threshold, side="right")
        begin, end, bound = begin[:pivots], end[:pivots], bound[:pivots]
        if not pivots:
            break
        take = min(pivots, int(np.searchsorted(np.cumsum(end - begin), goal)) + 1)
        mark = np.zeros(n + 1, dtype=np.int64)
        np.add.at(mark, begin[:take], 1)
        np.add.at(mark, end[:take], -1)
        wanted = np.cumsum(mark[:-1]) > 0
        before = np.r_[0, np.cumsum(wanted)]
        for weight, p in lists:
            some, values, seen = p.inside(wanted, before)
            total[some] += weight * values
            read += seen
        some = np.flatnonzero(wanted)
        some = some[(total[some] >= threshold - slack) & (total[some] > 0)]
        docs, scores = np.r_[docs, some], np.r_[scores, total[some]]
        if len(docs) >= k:
            threshold = max(threshold, np.partition(scores, -k)[-k])
            good = scores >= threshold - slack
            docs, scores = docs[good], scores[good]
        begin, end, bound, goal = begin[take:], end[take:], bound[take:], goal * GROWTH
    order = np.lexsort((docs, -scores))[: None if slack else k]
    return docs[order], scores[order], read
