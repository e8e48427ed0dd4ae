"""Token counts of a piece vocabulary by heap-and-linked-list merging.

The vocabulary is read from a model file; only counts are made, no identifiers. A text is cut where a space mark
follows another character, since no piece has a mark after another character (checked when the file is read), so
merges never cross a cut. Each cut is counted once and remembered in a table of bounded size.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ready_workers

MARK = "▁"
#: Cuts that a worker remembers; the table is emptied when it is full. Longer cuts are never remembered.
MEMO_ENTRIES, MEMO_LENGTH = 400_000, 48
_counters: dict[str, "PieceCounter"] = {}


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter(dict):
    """Maps a cut of a text to its number of tokens; counts those it does not hold."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
        self.ranks = {model.id_to_piece(i): -model.get_score(i) for i in range(model.get_piece_size()) if not special(i)}
        if any(MARK in piece.lstrip(MARK) for piece in self.ranks):
            raise ValueError("a piece has a space mark after another character; texts can't be cut at marks")
        self.cuts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def __missing__(self, cut: str) -> int:
        n = self.merge(cut)
        if len(cut) <= MEMO_LENGTH:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[cut] = n
        return n

    def merge(self, cut: str) -> int:
        """Symbols less merges; a symbol left over that no piece covers counts its UTF-8 bytes."""
        ranks = self.ranks
        n = len(cut)
        symbols: list[str] = list(cut)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(cut[i : i + 2])
            if rank is not None:
                heap.append((rank, i, 2))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, size = heapq.heappop(heap)
            left = symbols[i]
            j = after[i]
            # A pair is stale if either side has been merged away or has grown since it was put in.
            if not left or j >= n or len(left) + len(symbols[j]) != size:
                continue
            symbols[i] = both = left + symbols[j]
            symbols[j] = ""
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(both + symbols[k])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, len(both) + len(symbols[k])))
            h = before[i]
            if h >= 0:
                rank = ranks.get(symbols[h] + both)
                if rank is not None:
                    heapq.heappush(heap, (rank, h, len(symbols[h]) + len(both)))
        extra = sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in symbols if len(c) == 1 and c not in ranks)
        return n - merges + extra

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.cuts(MARK + text.replace(" ", MARK))))


def counter(path: str) -> PieceCounter:
    """One counter for each worker process and file."""
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def n_tokens(text: Column | str, path: str) -> Column:
    """A column of token counts; null and empty texts have 0."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path).count
        for texts in batches:
            yield pd.Series([count(x) for x in texts], dtype="int64")

    return counted(text)


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 4096) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    The vocabulary is the path of a piece model, the same on every machine. A null text counts as empty, with 0
    tokens. Rows with null or repeated identifiers are counted each. Further columns are not read.
    """
    ready_workers(docs.sparkSession)
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n_tokens("text", vocabulary or vocabulary_path()).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
