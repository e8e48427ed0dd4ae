"""Lines of texts in their order: sections under headings, prose outside of code fences, and runs of failures.

Each is an associative state, so a text, or a sequence of outcomes, may be spread over any number of rows and tasks
(``scan``). Texts that are rows by themselves are read by the same rules in one go.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import scan

#: A heading, a fence, characters of a heading and of a title, failures in a row that stop a run.
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$", re.DOTALL)
HEADING_CHARS, TITLE_CHARS, FAILURE_LIMIT = 256, 256, 5


def _one_line(text: str, most: int) -> str:
    return " ".join(text.split())[:most]


# Sections. A state is [least level seen, the headings that are open]: a heading closes all of its level and deeper.


def heading_state(level: int | None, heading: str | None) -> list:
    return [7, []] if level is None else [level, [[level, heading]]]


def join_headings(a: list, b: list) -> list:
    return [min(a[0], b[0]), [h for h in a[1] if h[0] < b[0]] + b[1]]


def headings(text: str | None) -> Iterator[tuple[int, int, str]]:
    """(offset, level, heading) of the heading lines of a text."""
    at = 0
    for line in (text or "").splitlines(keepends=True):
        if m := HEADING.match(line.rstrip("\r\n")):
            yield at, len(m[1]), _one_line(m[2], HEADING_CHARS)
        at += len(line)


def heading_rows(docs: DataFrame) -> DataFrame:
    """(id, pos, level, heading) of the headings in ``docs`` (id, text)."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *h) for i, text in zip(b.id.tolist(), b.text.tolist(), strict=True) for h in headings(text)]
            yield pd.DataFrame(rows, columns=["id", "pos", "level", "heading"])

    return docs.where("id is not null").select("id", "text").mapInPandas(find, f"id {docs.schema['id'].dataType.simpleString()}, pos long, level int, heading string")


def sections(events: DataFrame) -> DataFrame:
    """(id, pos, section): the open headings at each row of ``events`` (id, pos, level, heading), outermost first, with
    `` > `` between them. Rows without a level are places to ask for; at one place headings come first."""
    placed = events.withColumn("_late", F.col("level").isNull())
    found = scan(placed, "id", ["pos", "_late"], lambda r: heading_state(None if pd.isna(r["level"]) else int(r["level"]), r["heading"]), join_headings, [7, []], ["pos", "_late", "level", "heading"])

    @F.pandas_udf("string")
    def path(states: pd.Series) -> pd.Series:
        return states.map(lambda s: " > ".join(h for _, h in json.loads(s)[1]))

    return found.select("id", "pos", "level", path("state").alias("section"))


def _given_and_name() -> list[Column]:
    """The title that the frontmatter of text gives, and the file's name."""
    short = lambda c: F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, TITLE_CHARS)
    block = F.regexp_extract("text", r"^\x{FEFF}?---[ \t]*\r?\n((?:[^\n]*\n)*?)---[ \t]*(?:\r?\n|$)", 1)
    given = F.trim(F.regexp_replace(F.trim(F.regexp_extract(block, r"(?im)^title[ \t]*:[ \t]*([^\r\n]*)", 1)), "^['\"]+|['\"]+$", ""))
    return [short(given).alias("given"), short(F.regexp_extract("file", r"([^/\\]*)$", 1)).alias("name")]


def titles(docs: DataFrame) -> DataFrame:
    """(id, title) of ``docs`` (id, file, text): the frontmatter's title at its margin, the first heading of level 1, or
    the file's name."""
    first = heading_rows(docs).where("level = 1").groupBy("id").agg(F.min_by("heading", "pos").alias("h1"))
    named = docs.select("id", *_given_and_name())
    return named.join(first, "id", "left").select("id", F.coalesce(F.when(F.col("given") != "", F.col("given")), F.col("h1"), "name").alias("title"))


def places(text: str | None, parts: list[str]) -> list[int | None]:
    """Where each of the parts begins in the text, whatever white space stands between its words there."""
    after, starts = 0, []
    for part in parts:
        at = (text or "").find(part, after)
        if at < 0:
            pattern = re.compile(r"\s+".join(map(re.escape, part.split())))
            m = pattern.search(text or "", after) or pattern.search(text or "")
            at = m.start() if m else -1
        starts.append(at if at >= 0 else None)
        after = at + 1 if at >= 0 else after
    return starts


def placed_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, ord, start): where each of ``chunks`` (id, ord, text) begins in its text, whatever white space stands between
    its words there; null if it doesn't occur. A document's own chunks are brought to it."""
    held = chunks.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda c: c["text"]).alias("chunks"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, text, parts in zip(b.id.tolist(), b.text.tolist(), b.chunks.tolist(), strict=True):
                starts = places(text, parts)
                yield pd.DataFrame({"id": i, "ord": range(len(starts)), "start": pd.Series(starts, dtype="Int64")})

    return docs.select("id", "text").join(held, "id").mapInPandas(place, f"id {docs.schema['id'].dataType.simpleString()}, ord long, start long")


def sectioned_chunks(docs: DataFrame, cut: Callable[[str | None], list[str]]) -> DataFrame:
    """(id, ord, start, title, section) of the chunks that ``cut`` makes of each text in ``docs`` (id, file, text): what
    ``placed_chunks``, ``sections`` and ``titles`` say of them, for texts that are rows. Nothing is shuffled."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text, given, name in b[["id", "text", "given", "name"]].itertuples(index=False, name=None):
                found, parts = list(headings(text)), cut(text)
                title = given or next((h for _, level, h in found if level == 1), name)
                states = list(accumulate((heading_state(level, h) for _, level, h in found), join_headings))
                at = [pos for pos, _, _ in found]
                for n, start in enumerate(places(text, parts)):
                    before = 0 if start is None else bisect_right(at, start)
                    out.append((i, n, start, title, " > ".join(h for _, h in states[before - 1][1]) if before else ""))
            made = pd.DataFrame(out, columns=["id", "ord", "start", "title", "section"])
            yield made.astype({"start": "Int64"})

    known = docs.where("id is not null").select("id", "text", *_given_and_name())
    return known.mapInPandas(read, f"id {docs.schema['id'].dataType.simpleString()}, ord long, start long, title string, section string")


# Fences. A state says where a stretch of lines leads: from outside, and from inside a fence of each character by its
# length. A fence is closed by the first bare one of its character that is as long or longer, so what counts is
# where the length of such lines reaches a new maximum. None is outside, [character, length] inside.

OUTSIDE = {"out": None, "`": [], "~": []}


def fence_state(line: str) -> dict:
    m = FENCE.match(line)
    if m is None:
        return OUTSIDE
    mark, size = m[1][0], len(m[1])
    return {"out": [mark, size], "`": [], "~": []} | ({mark: [[size, None]]} if not m[2].strip() else {})


def after_lines(state: dict, where: list | None) -> list | None:
    if where is None:
        return state["out"]
    return next((to for size, to in state[where[0]] if size >= where[1]), where)


def join_fences(a: dict, b: dict) -> dict:
    made = {"out": after_lines(b, a["out"])}
    for mark in "`~":
        longest = a[mark][-1][0] if a[mark] else 0
        made[mark] = [[size, after_lines(b, to)] for size, to in a[mark]] + [x for x in b[mark] if x[0] > longest]
    return made


def prose_lines(lines: DataFrame) -> DataFrame:
    """(id, n, line) of the ``lines`` (id, n, line) outside of code fences; the fences themselves are not prose. A fence
    that isn't closed goes on to the end."""
    found = scan(lines, "id", ["n"], lambda r: fence_state(r["line"] or ""), join_fences, OUTSIDE, ["n", "line"])

    @F.pandas_udf("boolean")
    def outside(states: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([json.loads(s)["out"] is None and not (FENCE.match(t or "") is not None) for s, t in zip(states, texts, strict=True)], dtype=bool)

    return found.where(outside("state", "line")).select("id", "n", "line")


def prose_only(text: str | None) -> str:
    """A text without its fenced blocks."""
    kept, where = [], None
    for line in (text or "").split("\n"):
        state = fence_state(line)
        inside, where = where, after_lines(state, where)
        if inside is None and where is None:
            kept.append(line)
    return "\n".join(kept)


def prose(text: Column) -> Column:
    """``prose_only`` of texts that are rows; null gives an empty text."""

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(prose_only, na_action=None)

    return read(text)


def fenced_share(text: Column) -> Column:
    """Share of a text's words that stand in fenced blocks; null without a word."""
    words = lambda t: F.size(F.regexp_extract_all(t, F.lit(r"\w+"), F.lit(0)))
    whole = words(F.coalesce(text, F.lit("")))
    return (whole - words(prose(text))) / F.nullif(whole, F.lit(0))


# Failures. A state is [failures at the start, failures at the end, whether all are, whether a run was too long],
# runs being of calls that were made: what a cache answers says nothing about the engine.


def outcome_state(failed: bool | None) -> list:
    return [0, 0, True, False] if failed is None else [1, 1, True, False] if failed else [0, 0, False, False]


def join_outcomes(limit: int):
    def join(a: list, b: list) -> list:
        middle = a[1] + b[0]
        return [a[0] + b[0] if a[2] else a[0], b[1] + a[1] if b[2] else b[1], a[2] and b[2], a[3] or b[3] or middle >= limit]

    return join


def breaker(outcomes: DataFrame, limit: int = FAILURE_LIMIT) -> DataFrame:
    """(run, seq, status, in_a_row): what became of each of ``outcomes`` (run, seq, cached, failed): cached, done, failed,
    or skipped, once ``limit`` calls in a row have failed. Cached answers are given after that too, and neither end a
    run nor add to it. A new run, after whatever was wrong is mended, begins with a closed breaker."""
    join = join_outcomes(limit)
    asked = outcomes.withColumn("_failed", F.when(F.col("cached"), None).otherwise(F.coalesce("failed", F.lit(False))))
    found = scan(asked, "run", ["seq"], lambda r: outcome_state(None if r["_failed"] is None or pd.isna(r["_failed"]) else bool(r["_failed"])), join, [0, 0, True, False], ["seq", "cached", "_failed"])
    fields = F.from_json("state", "array<string>")
    broken, run = F.get(fields, F.lit(3)) == "true", F.get(fields, F.lit(1)).cast("long")
    # The call that makes the run too long was still made.
    made = found.withColumn("_broken", broken).withColumn("_run", run)
    last = made.where("_broken").groupBy("run").agg(F.min("seq").alias("_at"))
    late = F.col("_at").isNotNull() & (F.col("seq") > F.col("_at"))
    status = F.when(F.col("cached"), "cached").when(late, "skipped").when(F.col("_failed"), "failed").otherwise("done")
    return made.join(last, "run", "left").select("run", "seq", status.alias("status"), F.when(~late | F.col("_at").isNull(), F.col("_run")).alias("in_a_row"))
