"""Cutting texts into chunks: character-level rules, so pandas UDFs over Arrow batches.

Prose is cut at blank lines and packed up to ``most`` characters; a paragraph over that is cut at white space,
with some characters repeated at the head of the next piece. Code is cut where a top-level definition begins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import NUMERIC_TERM

MOST, OVERLAP = 800, 80
#: A piece is at least this part of ``most``, an overlap at most that part.
LEAST_PART, OVERLAP_PART = 8, 4
_blank = re.compile(r"[ \n]")
_number = re.compile(NUMERIC_TERM)
_definition = re.compile(r"(?:async def|def|class) |@")


def overlap_used(most: int, overlap: int) -> int:
    return min(max(overlap, 0), most // OVERLAP_PART)


def cut_long(block: str, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """Pieces of ``most`` characters at most; one pattern says where a piece ends.

    A piece is the longest run that a blank follows, if it has the least length, and else ``most`` characters.
    The next piece begins behind the first blank of the last characters that may be repeated, if that blank isn't
    nearer to the piece's own begin than the least length.
    """
    if most < 1:
        raise ValueError("most must be 1 or more")
    least, repeat = most // LEAST_PART, overlap_used(most, overlap)
    piece = re.compile(rf"(?s:.{{{max(1, least)},{most - 1}}}(?=[ \n])|.{{{most}}})" if most > 1 else r"(?s:.)")
    found, begin = [], 0
    while begin + most < len(block):
        end = piece.match(block, begin).end()
        found.append(block[begin:end])
        shared = _blank.search(block, max(begin + 1, end - repeat), end) if repeat else None
        begin = shared.end() if shared and shared.start() >= begin + least else end
    return [text for text in map(str.strip, [*found, block[begin:]]) if text]


def pack(blocks: list[str], most: int) -> list[str]:
    """Neighbouring blocks joined by a blank line while they fit in ``most`` characters."""
    groups: list[list[str]] = []
    size = 0
    for b in blocks:
        if groups and size + 2 + len(b) <= most:
            groups[-1].append(b)
            size += 2 + len(b)
        else:
            groups.append([b])
            size = len(b)
    return ["\n\n".join(g) for g in groups]


def prose_chunks(text: str | None, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """Chunks of a text; a null or blank text has none."""
    paragraphs = [p.strip() for p in (text or "").split("\n\n")]
    return pack([piece for p in paragraphs if p for piece in (cut_long(p, most, overlap) if len(p) > most else [p])], most)


def code_chunks(text: str | None, most: int = MOST) -> list[str]:
    """Chunks of source code: whole top-level definitions, packed; one over ``most`` stays whole."""
    blocks: list[list[str]] = [[]]
    for line in (text or "").split("\n"):
        if blocks[-1] and _definition.match(line):
            blocks.append([])
        blocks[-1].append(line)
    return pack([b for b in ("\n".join(x).strip() for x in blocks) if b], most)


def _column(cut: Callable[[str | None], list[str]], text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([cut(t) for t in texts])

    return chunks(text)


def chunk(docs: DataFrame, id_col: str, text_col: str = "text", kind: str = "prose", most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, ord, chunk_id, text): chunk_id is the MD5 of ``id:ord``; ord counts from 0."""
    cut = (lambda t: prose_chunks(t, most, overlap)) if kind == "prose" else (lambda t: code_chunks(t, most))
    pieces = docs.select(F.col(id_col), F.posexplode(_column(cut, F.col(text_col))).alias("ord", "text"))
    return pieces.select(id_col, "ord", F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.col("ord").cast("string"))).alias("chunk_id"), "text")


def table_pieces(block: str | None, most: int = MOST) -> list[tuple[str, int, int, list[str]]]:
    """(text, first row, last row, numbers) of a table block: rows in groups under the block's heading and header.

    A group that is over ``most`` even alone is cut, each piece under the header if that leaves room. A block
    without two table lines is one piece, whole; rows count from 0, and are -1 where there are none.
    """
    lines = [line.strip() for line in (block or "").splitlines() if line.strip()]
    table = [line for line in lines if line.startswith("|")]
    if len(table) < 2:
        return [(piece, -1, -1, []) for piece in (prose_chunks(block, most, 0))]
    head = "\n\n".join([line for line in lines if not line.startswith("|")] + ["\n".join(table[:2])])
    rows = table[2:]
    if not rows:
        return [(head, -1, -1, [])]
    sizes = [len(r) + 1 for r in rows]
    groups, size = [[0]], len(head) + sizes[0]
    for i in range(1, len(rows)):
        if size + sizes[i] > most:
            groups.append([])
            size = len(head)
        groups[-1].append(i)
        size += sizes[i]
    out = []
    for group in groups:
        body = "\n".join(rows[i] for i in group)
        numbers = list(dict.fromkeys(x.replace(",", ".") for i in group for cell in rows[i].strip("|").split("|") for x in _number.findall(cell)))
        room = most - len(head) - 1
        pieces = [body] if len(body) <= room else cut_long(body, room, 0) if room > 0 else None
        texts = [head + "\n" + p for p in pieces] if pieces else cut_long(head + "\n" + body, most, 0)
        out += [(t, group[0], group[-1], numbers) for t in texts]
    return out


def table_chunk(docs: DataFrame, id_col: str, text_col: str = "text", most: int = MOST) -> DataFrame:
    """(id_col, ord, row_start, row_end, numbers, text) of documents that are table blocks."""

    @F.pandas_udf("array<struct<text string, row_start int, row_end int, numbers array<string>>>")
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"text": t, "row_start": a, "row_end": b, "numbers": n} for t, a, b, n in table_pieces(text, most)] for text in texts])

    pieces = docs.select(F.col(id_col), F.posexplode(chunks(F.col(text_col))).alias("ord", "c"))
    return pieces.select(id_col, "ord", "c.row_start", "c.row_end", "c.numbers", "c.text")
