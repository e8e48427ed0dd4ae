"""Benchmark decontamination with the CGK embedding.

Words are symbols. A window of an item's length is embedded by a random walk that maps edit distance to Hamming
distance: at step j the current word is written and the walk moves on if a random bit of (j, word) is set. Tables
of a few sampled places of the embedding are looked up for equal items; the number of tables follows from the
target recall. What is found is verified by the exact edit distance of the item to the best passage there.

Windows that lack too many words of all items, or too many pairs of neighbouring words of the items of their
length, can't be within the distance of any, and are not embedded: these are bounds, not heuristics (an edit changes
one word and two pairs; pairs are counted in the window and as many words after it as edits are allowed). Items that
are too short for an edit are looked up as they are. Items are the broadcast side; they are read in blocks of a
bounded size, several in one pass over the documents.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ready_workers, stored, without

#: Edits allowed, as a share of an item's words; items with fewer words than EMBEDDED allow none and need no embedding.
EDITS, EMBEDDED = 0.2, 5
#: Places sampled for a table, tables of one walk, and the recall that the tables must reach for windows whose
#: embeddings agree in half of the places (which is what that many edits leave).
SAMPLED, TABLES_OF_WALK, AGREEMENT, RECALL = 3, 4, 0.5, 0.95
TABLES = ceil(log(1 - RECALL) / log(1 - AGREEMENT**SAMPLED))
WALKS = ceil(TABLES / TABLES_OF_WALK)
#: Characters of items in a block, and blocks in one pass over the documents.
BLOCK_CHARS, PASS_BLOCKS = 1_000_000, 4
#: Blocks of 62 random bits that a walk has for a word; longer walks remix them.
BIT_BLOCKS = 16
#: Symbols of texts that are searched at once, but for one text alone.
TEXT_SYMBOLS = 1 << 21
#: Symbols of the embeddings made at once; bits of the table of word pairs, where a clash only lets a window through.
CELLS, PAIR_BITS = 1 << 21, 22
_words = re.compile(r"\w+").findall


def infix_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``item`` to any part of ``text``, and where the first best part ends."""
    place = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, symbol in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != symbol))
        row = np.minimum.accumulate(new - place) + place
    end = int(row.argmin())
    return int(row[end]), end


def pair_slots(symbols: np.ndarray) -> np.ndarray:
    """A place in the table of word pairs for each two neighbours."""
    both = symbols[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + symbols[1:].astype(np.uint64)
    return ((both * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def run_keys(symbols: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n symbols."""
    out = np.zeros(len(symbols) - n + 1, dtype=np.uint64)
    for j in range(n):
        out = (out ^ symbols[j : j + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class ItemIndex:
    """Tables of one block of items; made in each worker from (item_id, text) pairs."""

    def __init__(self, items: list[tuple[int, str]], seed: int = 5):
        split = [(i, ws) for i, t in items if (ws := _words(t.lower()))]
        names = sorted({w for _, ws in split for w in ws})
        self.vocabulary = {w: k for k, w in enumerate(names, 1)}  # 0 is any other word
        coded = [(i, np.array([self.vocabulary[w] for w in ws], dtype=np.int64)) for i, ws in split]
        self.short = [(i, s) for i, s in coded if len(s) < EMBEDDED]
        self.items = [(i, s) for i, s in coded if len(s) >= EMBEDDED]
        self.items.sort(key=lambda item: len(item[1]))
        self.counts = [Counter(s.tolist()) for _, s in self.items]
        self.margin = int(EDITS * max((len(s) for _, s in self.items), default=0)) + 1
        rng = np.random.default_rng(seed)
        self.lengths = sorted({len(s) for _, s in self.items})
        # Word pairs: a number for each place in use, and for each length the places of its items' pairs.
        slots = [pair_slots(s) for _, s in self.items]
        used = np.unique(np.concatenate(slots)) if slots else np.zeros(0, dtype=np.int64)
        self.pair_number = np.zeros(1 << PAIR_BITS, dtype=np.int32)
        self.pair_number[used] = np.arange(1, len(used) + 1)
        self.pairs_of = {n: np.zeros(len(used) + 1, dtype=bool) for n in self.lengths}
        for (_, s), own in zip(self.items, slots, strict=True):
            self.pairs_of[len(s)][self.pair_number[own]] = True
        steps = 2 * max(self.lengths, default=0)
        self.bits = rng.integers(0, 2**62, (WALKS, min(BIT_BLOCKS, steps // 62 + 1), len(names) + 2), dtype=np.int64)
        # Sampled places of each table, for every length: (tables, lengths, SAMPLED).
        self.places = np.array([[[int(x * 2 * n) for x in np.sort(rng.random(SAMPLED))] for n in self.lengths] for _ in range(WALKS * TABLES_OF_WALK)], dtype=np.int64).reshape(WALKS * TABLES_OF_WALK, len(self.lengths), SAMPLED)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        if self.items:
            sizes = np.array([len(s) for _, s in self.items])
            starts = np.cumsum(sizes) - sizes
            symbols = np.concatenate([s for _, s in self.items])
            keys = [self.keys(symbols, starts[c:d], sizes[c:d]) for c, d in self.chunks(sizes)]
            for column in map(np.concatenate, zip(*keys, strict=True)):
                order = np.argsort(column, kind="stable")
                self.tables.append((column[order], order))

    def chunks(self, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Parts of windows of ascending sizes whose embeddings are a table of about CELLS symbols."""
        c = 0
        while c < len(sizes):
            d = min(len(sizes), c + max(1, CELLS // (2 * int(sizes[c]))))
            d = min(d, c + max(1, CELLS // (2 * int(sizes[d - 1]))))
            yield c, d
            c = d

    def keys(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """One number for each window and table: a mix of the symbols at the sampled places of its embedding."""
        out, end, lanes = [], len(self.vocabulary) + 1, np.arange(len(starts))  # end: the symbol after a window
        length, steps, blocks = np.searchsorted(self.lengths, sizes), 2 * int(sizes.max()), self.bits.shape[1]
        last = starts + sizes - 1
        walked = np.empty((steps, len(starts)), dtype=np.int32)
        for walk in range(WALKS):
            at = starts.copy()
            for j in range(steps):
                symbol = symbols[np.minimum(at, last)]
                symbol[at > last] = end
                walked[j] = symbol
                again, block = divmod(j // 62, blocks)
                random = self.bits[walk, block][symbol]
                if again:  # the word's bits of this step, remixed for each time round
                    random = (random * (0x1B873593 + 4 * again)) ^ (random >> 31)
                at += (random >> (j % 62)) & 1
            for t in range(walk * TABLES_OF_WALK, (walk + 1) * TABLES_OF_WALK):
                mixed = sizes.astype(np.uint64)
                for places in self.places[t].T:
                    mixed = (mixed ^ walked[places[length], lanes].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(29)
                out.append(mixed)
        return out

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end) of the first best passage of each item in each text, in words."""
        encode, out, first = self.vocabulary.get, [], 0
        coded: list[np.ndarray] = []
        size = 0
        for k, t in enumerate(texts):
            ids = np.array([encode(w, 0) for w in _words(t.lower())] if t else [], dtype=np.int64)
            if coded and size + len(ids) + self.margin > TEXT_SYMBOLS:
                out += [(first + at, *rest) for at, *rest in self._search(coded)]
                coded, size, first = [], 0, k
            coded.append(ids)
            size += len(ids) + self.margin
        return out + [(first + at, *rest) for at, *rest in self._search(coded)]

    def _search(self, coded: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        gap = np.zeros(self.margin, dtype=np.int64)
        sizes = np.array([len(ids) for ids in coded], dtype=np.int64)
        begins = np.cumsum(sizes + self.margin) - sizes - self.margin
        symbols = np.concatenate([x for ids in coded for x in (ids, gap)]) if coded else gap
        out = self._exact(symbols, begins)
        if not self.items:
            return out
        known = np.concatenate([[0], np.cumsum(symbols > 0)])
        numbers = self.pair_number[pair_slots(symbols)]
        candidates: dict[tuple[int, int], list[int]] = defaultdict(list)
        wanted_starts, wanted_sizes = [], []
        for n in self.lengths:
            if len(symbols) >= n:
                allowed = int(EDITS * n)
                enough = np.flatnonzero(known[n:] - known[:-n] >= n - allowed)
                if not len(enough):
                    continue
                linked = np.concatenate([[0], np.cumsum(self.pairs_of[n][numbers])])
                pairs = linked[np.minimum(enough + n - 1 + allowed, len(linked) - 1)] - linked[enough]
                wanted_starts.append(enough[pairs >= n - 1 - 2 * allowed])
                wanted_sizes.append(np.full(len(wanted_starts[-1]), n))
        if not wanted_starts:
            return out
        all_starts, all_sizes = np.concatenate(wanted_starts), np.concatenate(wanted_sizes)
        for c, d in self.chunks(all_sizes):
            starts = all_starts[c:d]
            for column, (sorted_keys, ks) in zip(self.keys(symbols, starts, all_sizes[c:d]), self.tables, strict=True):
                low, high = np.searchsorted(sorted_keys, column, side="left"), np.searchsorted(sorted_keys, column, side="right")
                hit = np.flatnonzero(high > low)
                for start, text, lo, hi in zip(starts[hit].tolist(), (np.searchsorted(begins, starts[hit], side="right") - 1).tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                    for k in ks[lo:hi].tolist():
                        candidates[text, k].append(start)
        for (text, k), starts in sorted(candidates.items()):
            item, s = self.items[k]
            begin, stop = int(begins[text]), int(begins[text] + sizes[text])
            allowed, best, done = int(EDITS * len(s)), None, -1
            for start in sorted(set(starts)):
                if start <= done:
                    continue
                # Also every passage that begins before the next start that is looked at.
                lo, hi = max(begin, start - allowed), min(start + len(s) + allowed + allowed // 2, stop)
                window = symbols[lo:hi]
                common = Counter(window.tolist())
                if sum(min(c, common[w]) for w, c in self.counts[k].items()) < len(s) - allowed:
                    continue
                distance, end = infix_distance(s, window)
                done = start + allowed // 2
                if distance <= allowed and (best is None or distance < best[0]):
                    # The passage begins where the reversed item ends best in the reversed text before that end.
                    back = infix_distance(s[::-1], window[:end][::-1])[1]
                    best = (distance, lo + end - back - begin, lo + end - begin)
            if best:
                out.append((text, int(item), *best))
        return out

    def _exact(self, symbols: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """The first place of each short item in each text."""
        out = []
        for n in sorted({len(s) for _, s in self.short}):
            if len(symbols) < n:
                continue
            own = [(i, s) for i, s in self.short if len(s) == n]
            keys = np.array([run_keys(s, n)[0] for _, s in own], dtype=np.uint64)
            order = np.argsort(keys, kind="stable")
            runs, first = run_keys(symbols, n), {}
            at = np.flatnonzero(np.isin(runs, keys))
            low, high = np.searchsorted(keys[order], runs[at], side="left"), np.searchsorted(keys[order], runs[at], side="right")
            for start, text, lo, hi in zip(at.tolist(), (np.searchsorted(begins, at, side="right") - 1).tolist(), low.tolist(), high.tolist(), strict=True):
                for k in order[lo:hi].tolist():
                    if (text, k) not in first and np.array_equal(symbols[start : start + n], own[k][1]):
                        first[text, k] = start - int(begins[text])
            out += [(text, int(own[k][0]), 0, start, start + n) for (text, k), start in sorted(first.items())]
        return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Blocks of (item_id, text) of BLOCK_CHARS characters, or of one item; the driver holds one pass of them."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).where("item_id is not null and item_text is not null").orderBy("item_id", "item_text")
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + len(row.item_text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.item_text))
        size += len(row.item_text)
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, distance, start_word, end_word): one row for each document and item it holds.

    A document holds an item if some passage is within EDITS of the item's words, compared in lower case without
    punctuation; the first best passage is given. Items under five words must stand there as they are. Items with
    null texts or without a word are not searched for; null and empty documents hold none. Texts and items of any
    length are searched whole. Rows with repeated or null identifiers are searched each; repeated items too. Other
    columns are not read. The documents are read once for each PASS_BLOCKS blocks of items.
    """
    ready_workers(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks, found = item_blocks(benchmark), None
    while part := list(islice(blocks, PASS_BLOCKS)):
        some = _search_blocks(rows, part)
        found = some if found is None else stored(found).unionByName(stored(some))
    return found


def _search_blocks(rows: DataFrame, blocks: list[list[tuple[int, str]]]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(blocks)  # PASS_BLOCKS * BLOCK_CHARS at most, or long items alone

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        indexes, sizes = [ItemIndex(block) for block in sent.value], {i: len(_words(t.lower())) for block in sent.value for i, t in block}
        for b in batches:
            texts = b.text.tolist()
            found = [hit for index in indexes for hit in index.search(texts)]
            yield pd.DataFrame(
                {
                    "doc_id": pd.array([b.doc_id.iloc[t] for t, *_ in found], dtype="Int64"), "item_id": [i for _, i, *_ in found], "n_words": [sizes[i] for _, i, *_ in found],
                    "distance": [d for _, _, d, *_ in found], "start_word": [s for *_, s, _ in found], "end_word": [e for *_, e in found],
                }
            )

    return rows.mapInPandas(search, "doc_id long, item_id long, n_words long, distance long, start_word long, end_word long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with the columns of ``docs``; identifiers must be unique."""
    return without(docs, contaminated(docs, benchmark).select("doc_id"), "doc_id")
