"""Secrets in texts, found through a trigram inverted index. Native: no Python runs on the executors.

The index has, for each trigram of graphic ASCII characters in lower case, bitmaps of the documents that hold it: one
64-bit mask for each block of 64 neighbouring identifiers. A rule's pattern is turned into a Boolean query over
trigrams that every match must have; its bitmaps are intersected and united with ``&`` and ``|``, and the patterns run
over the candidates' texts only. A rule whose matches need no trigram runs over all texts. Identifiers that several
rows share, or that are null, only make more candidates, as each text is verified by itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_KEYS, key_filter, marked, stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules. A run of 16 and more is a whole run that is long enough; so is a key of 18 and more,
#: as a run's first AKIA is its longest match.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Characters of a text that are looked at together, and spans of a text whose places are added up together.
PIECE, CHUNK = 4096, 1024
#: Strings up to which the ways to write a part of a pattern are listed.
MOST_STRINGS = 64
_GRAM = "[!-~]{3}"


def _written(node) -> set[str] | None:
    """All strings, in lower case, of one node of a parsed pattern; None where they are many or not graphic ASCII."""
    op, value = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(value).lower()} if 33 <= value <= 126 else None
    if op == "AT":
        return {""}
    if op == "IN":
        each = [_written(x) for x in value]
        return None if any(x is None for x in each) or len(each) > 4 else set().union(*each)
    if op == "SUBPATTERN":
        return _joined(value[-1])
    if op == "BRANCH":
        each = [_joined(x) for x in value[1]]
        return None if any(x is None for x in each) else set().union(*each)
    if op == "MAX_REPEAT" and tuple(map(int, value[:2])) == (0, 1):
        inner = _joined(value[2])
        return None if inner is None else inner | {""}
    return None


def _joined(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        some = _written(node)
        if some is None or len(found) * len(some) > MOST_STRINGS:
            return None
        found = {a + b for a, b in product(found, some)}
    return found


def trigram_query(pattern: str) -> list[list[frozenset]]:
    """What every match of ``pattern`` holds: of each list one set of trigrams, in lower case. Empty: nothing is known.

    Neighbouring parts that can be written out are joined; a list has a set for each way to write such a stretch.
    """
    found: list[list[frozenset]] = []

    def close(strings: set[str]) -> None:
        ways = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)]
        if all(ways):  # a way that asks for more than another adds nothing
            found.append([w for w in ways if not any(o < w for o in ways)])

    def visit(nodes) -> None:
        stretch = {""}
        for node in nodes:
            some = _written(node)
            if some is not None and len(stretch) * len(some) <= MOST_STRINGS:
                stretch = {a + b for a, b in product(stretch, some)}
                continue
            close(stretch)
            stretch = some or {""}
            if some is None and str(node[0]) == "SUBPATTERN":
                visit(node[1][-1])
            elif some is None and str(node[0]) == "MAX_REPEAT" and int(node[1][0]) >= 1:
                visit(node[1][2])
        close(stretch)

    visit(re._parser.parse(pattern))
    return found


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, block, slot): the place of each row in the bitmaps; null without an identifier."""
    kind = docs.schema["doc_id"].dataType.typeName()
    key = F.col("doc_id").cast("long") if kind in ("byte", "short", "integer", "long") else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), key.alias("key"))
    return rows.select("doc_id", "text", F.shiftright("key", 6).alias("block"), F.expr("cast(key & 63 as int)").alias("slot"))


def trigram_index(docs: DataFrame) -> DataFrame:
    """(gram, block, docs): for each trigram the bitmap of the documents of a block that hold it; stored by trigram.

    Texts of any length are read whole, in overlapping pieces; a task combines its masks before they are shuffled.
    """
    pieces = _keyed(docs).where("block is not null").select("block", "slot", F.explode(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{1,{PIECE + 2}}})).{{1,{PIECE}}}"), 1)).alias("piece"))
    grams = pieces.select("block", "slot", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("piece"), F.lit(f"(?=({_GRAM}))"), 1))).alias("gram"))
    masks = grams.groupBy("gram", "block").agg(F.bit_or(F.expr("shiftleft(1L, slot)")).alias("docs"))
    return stored(masks, sort=["gram", "block"])


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(block, m0, m1, ...): the bitmap of the candidates of each rule that has a trigram query, by its number."""
    asked = {n: q for n, rule in enumerate(rules) if (q := trigram_query(rule.pattern))}
    grams = sorted({g for q in asked.values() for ways in q for way in ways for g in way})
    names = {g: f"g{i}" for i, g in enumerate(grams)}
    held = index.where(F.col("gram").isin(grams)).groupBy("block").agg(
        *(F.coalesce(F.bit_or(F.when(F.col("gram") == g, F.col("docs"))), F.lit(0).cast("long")).alias(n) for g, n in names.items()), F.count(F.lit(1)).alias("_n")
    )

    def either(ways: list[frozenset]) -> str:
        return "(" + " | ".join("(" + " & ".join(names[g] for g in sorted(way)) + ")" for way in ways) + ")"

    masks = [F.expr(" & ".join(map(either, q))).alias(f"m{n}") for n, q in asked.items()]
    found = held.select("block", *masks)
    return found.where(" or ".join(["false", *(f"m{n} <> 0" for n in asked)]))


def _spans(rule: Rule, number: int) -> Column:
    """The rule's spans in ``text``: array of (start, rule, end), in code points.

    A text is cut at its matches; lengths of cuts and matches are added up in chunks, so that no array is copied once
    for each span. Arrays are bound to lambda variables, as an expression in a lambda is evaluated for each element.
    """
    pattern = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    zipped = f"arrays_zip(regexp_extract_all(text, '{pattern}', 0), regexp_extract_all(text, '{pattern}', {rule.group}), split(text, '{pattern}', -1))"
    sizes = f"transform(filter({zipped}, z -> z['0'] is not null), z -> struct(length(z['2']) as gap, length(z['0']) as size, length(z['1']) as tested))"
    none = "cast(array() as array<struct<start: int, rule: int, end: int, tested: int>>)"
    cut = f"transform(array({sizes}), l -> transform(sequence(0, (size(l) - 1) div {CHUNK}), c -> slice(l, cast(c * {CHUNK} + 1 as int), {CHUNK})))[0]"
    begins = "aggregate(transform(cs, c -> aggregate(c, 0, (s, x) -> s + x.gap + x.size)), struct(0 as at, cast(array() as array<int>) as held), (s, x) -> struct(s.at + x as at, concat(s.held, array(s.at)) as held)).held"
    step = f"(s, x) -> struct(s.at + x.gap + x.size as at, concat(s.held, array(struct(s.at + x.gap as start, {number} as rule, s.at + x.gap + x.size as end, x.tested as tested))) as held)"
    placed = f"flatten(transform(array({cut}), cs -> flatten(transform(arrays_zip(cs, {begins}), z -> aggregate(z.cs, struct(z.held as at, {none} as held), {step}).held))))"
    kept = f"transform(filter({placed}, x -> x.tested >= {rule.least}), x -> struct(x.start as start, x.rule as rule, x.end as end))"
    return F.expr(f"if(text rlike '{pattern}', {kept}, cast(array() as array<struct<start: int, rule: int, end: int>>))")


def _verified(rows: DataFrame, rules: tuple[Rule, ...], asked: set[int]) -> DataFrame:
    """Spans of ``rows`` (doc_id, text, block, slot, m0, ...): of each rule, where a row is a candidate."""
    found = []
    for n, rule in enumerate(rules):
        held = (F.col("block").isNull() | (F.expr(f"shiftright(m{n}, slot) & 1") == 1)) if n in asked else F.lit(True)
        found.append(F.when(held, _spans(rule, n)).otherwise(F.expr("cast(array() as array<struct<start: int, rule: int, end: int>>)")))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    merged = F.array_sort(F.concat(*found))
    return rows.select("doc_id", F.transform(merged, lambda s: F.struct(F.element_at(kinds, s["rule"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, spans) for each row of ``docs``: spans (kind, start, end) in code points by start, then rule.

    ``index`` is a ``trigram_index`` of the same rows and serves any rules; it is made where none is given. A null text
    is empty. Repeated rows are returned each; rows without an identifier are scanned. Texts of any length are read
    whole. An empty table gives no rows. Other columns are not read.
    """
    asked = {n for n, rule in enumerate(rules) if trigram_query(rule.pattern)}
    rows, masks = _keyed(docs), [f"m{n}" for n in sorted(asked)]
    if not asked:
        return _verified(rows, rules, asked)
    found = stored(candidates(trigram_index(docs) if index is None else index, rules))
    if found.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        joined = rows.join(F.broadcast(found), "block", "left")
    else:  # only rows of blocks in doubt are shuffled
        doubtful = marked(rows, "block", stored(key_filter(found, "block")), "_maybe")
        clear = doubtful.where("not _maybe").select(*rows.columns, *(F.lit(0).cast("long").alias(m) for m in masks))
        joined = doubtful.where("_maybe").drop("_maybe").join(found, "block", "left").select(clear.columns).union(clear)
    return _verified(joined.na.fill(0, masks), rules, asked)


def report(found: DataFrame, rules: tuple[Rule, ...] = BASE) -> DataFrame:
    """doc_id, a count for each kind, the SHA-256 of the spans and the spans as kind:start:end, comma-joined."""
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in rules]
    return found.select("doc_id", *counts, text.alias("spans")).withColumn("base_sha256", F.sha2("spans", 256))
