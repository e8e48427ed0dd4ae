"""Repair of conversations' structure by the cheapest edits, the ASCII-least of them where several are as cheap.

A legal conversation has the role initials ``(s?(ua)+)?``. A macro edit is a run of inserted turns and one edit of a
turn; its code is the run's ``I`` and the edit's initial. Codes end with a turn's edit, so none begins another, and
audits that have come as far as the same turn compare as their codes do, one by one. So a layer of the dynamic program
needs no audit strings: it keeps, for each of the STATES, the cost and the rank of its audit among the states', and
which state it came from. Audits and repaired turns are read off the parents afterwards. An insertion right before a
deletion is never least (behind it, it costs the same and D comes before I), so there is no code for it.

A turn is a matrix of costs and codes from state to state, and so is a run of turns, with ranks in place of codes. A
conversation is sorted by ranges, so that a long one is spread over tasks; it is cut into segments whose matrices are
chained, first those of a task, then those of the tasks, and each segment is repaired between the states found for
it. Turns that repeat whole are counted before they are shuffled: all but the first are deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ready_workers, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after the system turn, after a user's, after an assistant's; where an insertion or a new role
#: leads, and what it is named.
STATES = 4
_NEXT = (2, 2, 3, 2)
_NAMES = {2: "user", 3: "assistant"}
_KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: Insertions at the end that make a conversation legal.
_TAILS = ("", "II", "I", "")
#: The macro edits' codes in ASCII order.
CODES = sorted(["D"] + ["I" * run + edit for run in range(3) for edit in "KR"])
_LEGAL = {"su", "ua", "au"}
#: Distinct turns and characters of a segment.
SEGMENT_TURNS, SEGMENT_CHARS = 1024, 1 << 20
_SUMS = ("blank", "duplicate", "truncated", "illegal")
_COUNTS = ("gaps", *_SUMS, "cost")


@lru_cache(maxsize=None)
def turn_matrix(initial: str, truncated: bool) -> tuple[tuple, tuple]:
    """Costs (-1: no way) and code numbers of one turn's macro edits, from state to state, row by row."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for state in range(STATES):
        at = state
        for run in range(3):
            price = run * INSERT + (TRUNCATED if truncated else 0)
            ways = [("K", _KEPT.get((initial, at)), price + KEEP), ("R", _NEXT[at], price + REROLE)]
            for edit, to, cost in ways + ([("D", at, DELETE)] if run == 0 else []):
                if to is not None:
                    found = (cost, CODES.index("I" * run + edit))
                    best[state, to] = min(best.get((state, to), found), found)
            at = _NEXT[at]
    cells = [best.get((s, t), (-1, -1)) for s in range(STATES) for t in range(STATES)]
    return tuple(c for c, _ in cells), tuple(r for _, r in cells)


def advance(layer: tuple, costs, ranks) -> tuple[tuple, tuple]:
    """The next layer, (cost, rank) or None for each state, and the state that each came from."""
    found: dict[int, tuple] = {}
    for s, held in enumerate(layer):
        if held is not None:
            for t in range(STATES):
                if costs[STATES * s + t] >= 0:
                    way = (held[0] + costs[STATES * s + t], held[1], ranks[STATES * s + t], s)
                    if t not in found or way < found[t]:
                        found[t] = way
    order = {t: n for n, t in enumerate(sorted(found, key=lambda t: found[t][1:3]))}
    return tuple((found[t][0], order[t]) if t in found else None for t in range(STATES)), tuple(found[t][3] if t in found else None for t in range(STATES))


@lru_cache(maxsize=1 << 16)
def _turn_step(layer: tuple, initial: str, truncated: bool) -> tuple[tuple, tuple, int]:
    """``advance`` by a turn, with costs less the least of them, which comes third: such layers are few."""
    after, came = advance(layer, *turn_matrix(initial, truncated))
    least = min(x[0] for x in after if x is not None)
    return tuple(None if x is None else (x[0] - least, x[1]) for x in after), came, least


def _entered(state: int) -> tuple:
    return tuple((0, 0) if s == state else None for s in range(STATES))


def chain_turns(turns: list[tuple[str, int, int]], entry: int) -> tuple[tuple, list]:
    """The last layer and the parents of (initial, fault, copies) of each turn, from one state; None for a turn that
    must go, which leaves the layer as it is."""
    layer, total, parents = _entered(entry), 0, []
    for initial, fault, copies in turns:
        forced = fault in (1, 2)
        total += DELETE * (copies if forced else copies - 1)
        came = None
        if not forced:
            layer, came, least = _turn_step(layer, initial, fault == 3)
            total += least
        parents.append(came)
    return tuple(None if x is None else (x[0] + total, x[1]) for x in layer), parents


def chain(matrices: list[tuple], entry: int) -> tuple[tuple, list]:
    layer, parents = _entered(entry), []
    for costs, ranks in matrices:
        layer, came = advance(layer, costs, ranks)
        parents.append(came)
    return layer, parents


def walk(parents: list, last: int) -> list[int]:
    """The states from the entry to ``last``."""
    path = [last]
    for came in reversed(parents):
        path.append(path[-1] if came is None else came[path[-1]])
    return path[::-1]


def matrix(of) -> tuple[tuple, tuple]:
    """The costs and ranks from every state to every other, ``of(entry)`` being the last layer from one."""
    cells = [x or (-1, -1) for entry in range(STATES) for x in of(entry)]
    return tuple(c for c, _ in cells), tuple(r for _, r in cells)


def ending(layer: tuple) -> tuple[int, str, int]:
    """Cost, insertions at the end and state before them of the best whole conversation."""
    cost, _, state = min((held[0] + INSERT * len(_TAILS[s]), held[1], s) for s, held in enumerate(layer) if held is not None)
    return cost, _TAILS[state], state


class Piece:
    """Turns of one conversation in order, as many as a task holds at once, and their counts."""

    def __init__(self):
        self.turns, self.roles, self.texts, self.chars = [], [], [], 0
        self.counts = dict.fromkeys(_SUMS, 0)
        self.low = self.high = None
        self.distinct = 0
        self.first = self.last = None

    def add(self, turn, role: str, text: str, copies: int, fault: int) -> None:
        initial = role[:1]
        self.turns.append((initial, fault, copies))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(role) + len(text)
        self.counts["blank"] += copies if fault == 1 else 0
        self.counts["duplicate"] += copies if fault == 2 else copies - 1 if fault in (0, 3) else 0
        self.counts["truncated"] += fault == 3
        self.counts["illegal"] += copies - 1 + (self.last is not None and self.last + initial not in _LEGAL)
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self.distinct += self.high is None or turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def span(self) -> dict:
        """Turns as text: a column of numbers and nulls would come back in floating point."""
        low, high = (None if x is None else str(x) for x in (self.low, self.high))
        return {"low": low, "high": high, "distinct": self.distinct, "first": self.first, "last": self.last}

    def repaired(self, parents: list, last: int, tail: str) -> tuple[str, list[str], list[str]]:
        """The audit, and the roles and texts of the repaired turns, with ``tail`` inserted at the end."""
        audit, roles, texts, path = [], [], [], walk(parents, last)

        def insert(state: int, run: int) -> int:
            for _ in range(run):
                state = _NEXT[state]
                roles.append(_NAMES[state])
                texts.append("")
            return state

        for (initial, fault, copies), role, text, s, t in zip(self.turns, self.roles, self.texts, path, path[1:], strict=False):
            if fault in (1, 2):
                audit.append("D" * copies)
                continue
            code = CODES[turn_matrix(initial, fault == 3)[1][STATES * s + t]]
            audit.append(code + "D" * (copies - 1))
            at = insert(s, len(code) - 1)
            if code[-1] != "D":
                roles.append(role if code[-1] == "K" else _NAMES[_NEXT[at]])
                texts.append(text)
        insert(last, len(tail))
        return "".join(audit) + tail, roles, texts


def gaps(low, high, distinct: int) -> int:
    return 0 if low is None else int(high - low + 1 - distinct)


_SPAN = ("low", "high", "distinct", "first", "last")
_SEGMENT = "initials array<string>, faults array<int>, copies array<long>"
_MADE = (
    "kind string, part int, seq long, conv_id {id}, audit string, roles array<string>, texts array<string>, "
    + ", ".join(f"{c} long" for c in _COUNTS)
    + f", {_SEGMENT}, low string, high string, distinct long, first string, last string, costs array<long>, ranks array<long>, child_costs array<long>, child_ranks array<long>"
)
_NAMED = [c.split()[0] for c in _MADE.split(", ")]


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one sorted task: conversations that lie inside it, repaired; of others (the first, the last, and long
    ones) their segments with all turns, and one row with the chained matrix and the segments' own."""
    state = {"part": None, "seq": 0}
    out: list[dict] = []

    def flush(key, piece: Piece, matrices: list) -> None:
        made = matrix(lambda entry: chain_turns(piece.turns, entry)[0])
        initials, faults, copies = (list(x) for x in zip(*piece.turns, strict=True))
        out.append({"kind": "segment", "seq": state["seq"], "conv_id": key, "roles": piece.roles, "texts": piece.texts, "initials": initials, "faults": faults, "copies": copies})
        state["seq"] += 1
        matrices.append(made)

    def close(key, piece: Piece, matrices: list, edge: bool) -> None:
        if not edge and not matrices:
            layer, parents = chain_turns(piece.turns, 0)
            cost, tail, last = ending(layer)
            audit, roles, texts = piece.repaired(parents, last, tail)
            found = {"gaps": gaps(piece.low, piece.high, piece.distinct), **piece.counts, "cost": cost}
            out.append({"kind": "whole", "seq": state["seq"], "conv_id": key, "audit": audit, "roles": roles, "texts": texts, **found})
            state["seq"] += 1
            return
        if piece.turns:
            flush(key, piece, matrices)
        costs, ranks = matrix(lambda entry: chain(matrices, entry)[0])
        out.append(
            {"kind": "piece", "seq": state["seq"] - len(matrices), "conv_id": key, **piece.counts, **piece.span(), "costs": costs, "ranks": ranks}
            | {"child_costs": [c for m in matrices for c in m[0]], "child_ranks": [r for m in matrices for r in m[1]]}
        )

    def table() -> pd.DataFrame:
        made = pd.DataFrame(out, columns=_NAMED).astype({c: object for c in _NAMED}).assign(part=state["part"])
        out.clear()
        return made.where(made.notna(), None)

    current, piece, matrices, first = None, None, [], True
    for b in batches:
        for part, absent, conv, turn_absent, turn, role, text, copies, fault in zip(*(b[c].tolist() for c in ("part", "no_conv", "conv", "no_turn", "at_turn", "role", "text", "copies", "fault")), strict=True):
            state["part"] = part
            key = None if absent else conv
            if piece is None or key != current:
                if piece is not None:
                    close(current, piece, matrices, first)
                    first = False
                current, piece, matrices = key, Piece(), []
            if copies:
                piece.add(None if turn_absent else turn, role, text, copies, fault)
            if len(piece.turns) >= SEGMENT_TURNS or piece.chars >= SEGMENT_CHARS:
                flush(current, piece, matrices)
                piece.turns, piece.roles, piece.texts, piece.chars = [], [], [], 0
        if out:
            yield table()
    if piece is not None:
        close(current, piece, matrices, True)
        yield table()


def _whole(pieces: pd.DataFrame) -> pd.DataFrame:
    """One conversation's pieces, one a task: its counts, and the states between which each piece is repaired."""
    rows = pieces.sort_values("part").to_dict("records")
    layer, parents = chain([(r["costs"], r["ranks"]) for r in rows], 0)
    cost, tail, last = ending(layer)
    path = walk(parents, last)
    total = dict.fromkeys(_SUMS, 0)
    low = high = before = None
    distinct = 0
    for r in rows:
        for c in _SUMS:
            total[c] += r[c]
        if r["first"] is not None:
            total["illegal"] += before is not None and before + r["first"] not in _LEGAL
            before = r["last"]
        if r["low"] is not None:
            distinct += r["distinct"] - (high == int(r["low"]))
            low, high = int(r["low"]) if low is None else low, int(r["high"])
    found = {"gaps": gaps(low, high, distinct), **total, "cost": cost}
    ends = [""] * (len(rows) - 1) + [tail]
    return pd.DataFrame([{"part": r["part"], "seq": r["seq"], "entry": path[i], "exit": path[i + 1], "tail": ends[i], **found} for i, r in enumerate(rows)])


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The states between which each segment of a piece is repaired."""
    for b in batches:
        out = []
        for r in b.to_dict("records"):
            size = STATES * STATES
            each = [(r["child_costs"][i : i + size], r["child_ranks"][i : i + size]) for i in range(0, len(r["child_costs"]), size)]
            path = walk(chain(each, r["entry"])[1], r["exit"])
            counts = {c: r[c] for c in _COUNTS}
            for i in range(len(each)):
                out.append({"part": r["part"], "seq": r["seq"] + i, "entry": path[i], "exit": path[i + 1], "tail": r["tail"] if i + 1 == len(each) else "", **counts})
            if not each:  # no turn is left: a row of its own stands for the conversation
                out.append({"part": r["part"], "seq": r["seq"], "entry": path[0], "exit": path[0], "tail": r["tail"], **counts})
        yield pd.DataFrame(out, columns=["part", "seq", "entry", "exit", "tail", *_COUNTS])


def _rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for r in b.to_dict("records"):
            piece = Piece()
            if r["initials"] is not None:
                piece.turns = list(zip(r["initials"], r["faults"], r["copies"], strict=True))
                piece.roles, piece.texts = r["roles"], r["texts"]
            parents = chain_turns(piece.turns, r["entry"])[1]
            audit, roles, texts = piece.repaired(parents, r["exit"], r["tail"])
            out.append({"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "audit": audit, "roles": roles, "texts": texts, **{c: r[c] for c in _COUNTS}})
        made = pd.DataFrame(out, columns=["conv_id", "part", "seq", "audit", "roles", "texts", *_COUNTS]).astype({"conv_id": object})
        yield made.where(made.notna(), None)


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with their damage, and the number of copies: 0 for a dropped row."""
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.crc32(name) % 20
    hurt = F.when(fate <= 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long")
    return turns.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"), hurt.alias("text"), copies.alias("copies"))


def faults(turns: DataFrame) -> DataFrame:
    """Each distinct turn once, with its copies and first fault: 0 none, 1 blank, 2 duplicate, 3 truncated.

    A null text or role is one blank. conv and at_turn are 0 where no_conv and no_turn say that they are null.
    """
    def zero(c: str):
        return F.coalesce(F.col(c), F.lit("0").cast(turns.schema[c].dataType))

    copies = F.col("copies") if "copies" in turns.columns else F.lit(1).cast("long")
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    rows = turns.select(
        F.col("conv_id").isNull().alias("no_conv"), zero("conv_id").alias("conv"), F.col("turn").isNull().alias("no_turn"), zero("turn").cast("long").alias("at_turn"),
        role.alias("role"), text.alias("text"), copies.alias("copies"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    named = ["no_conv", "conv", "no_turn", "at_turn", "role", "digest"]
    once = rows.groupBy(*named).agg(F.max("text").alias("text"), F.sum("copies").alias("copies"))
    seen = rows.where("copies > 0").groupBy("no_conv", "conv", "role", "digest").agg(F.min(F.struct(~F.col("no_turn"), F.col("no_turn"), "at_turn")).alias("s"))
    firsts = seen.select("no_conv", "conv", "s.no_turn", "s.at_turn", "role", "digest", F.lit(True).alias("is_first"))
    fault = (
        F.when(~F.col("text").rlike("[^\\x20\\x09-\\x0D]"), 1).when(F.col("is_first").isNull(), 2)
        .when(~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), 3).otherwise(0)
    )
    return once.join(firsts, named, "left").select(*named[:-1], "text", "copies", fault.alias("fault"))


def repair(turns: DataFrame) -> DataFrame:
    """Repaired conversations of ``turns`` (conv_id, turn, role, text, and copies where rows are counted).

    A row for each conversation of up to SEGMENT_TURNS distinct turns; longer ones, and those that a task's range
    cuts, come as segments, ordered by part and seq: conv_id, part, seq, segments (1: the whole is here, 0: a part of
    it), audit, roles, texts, and the whole conversation's gaps, blank, duplicate, truncated, illegal and cost.
    Turns are taken by turn (nulls first), role and text. Null roles and texts are one blank; a null conv_id is a
    conversation. Texts of any length are kept whole. An empty table gives no rows; other columns are not read.
    """
    ready_workers(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    order = ["no_conv", "conv", F.desc("no_turn"), "at_turn", "role", "text"]
    ranged = faults(turns).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    made = stored(ranged.mapInPandas(_pieces, _MADE.format(id=kind)))
    columns = ["conv_id", "part", "seq", "audit", "roles", "texts", *_COUNTS]
    whole = made.where("kind = 'whole'").select(*columns, F.lit(1).alias("segments"))
    pieces = made.where("kind = 'piece'")
    # A task has two such pieces and its long conversations, so a group has a row a task at most.
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    led = f"part int, seq long, entry int, exit int, tail string, {counts}"
    tops = pieces.select("conv_id", "part", "seq", *_SUMS, *_SPAN, "costs", "ranks").groupBy("conv_id").applyInPandas(_whole, led)
    downs = pieces.select("part", "seq", "child_costs", "child_ranks").join(tops, ["part", "seq"]).mapInPandas(_segments, led)
    segments = made.where("kind = 'segment'").select("part", "seq", "conv_id", "roles", "texts", "initials", "faults", "copies")
    empty = pieces.where(F.size("child_costs") == 0).select("part", "seq", "conv_id", *(F.lit(None).cast(segments.schema[c].dataType).alias(c) for c in segments.columns[3:]))
    parts = segments.union(empty).join(downs, ["part", "seq"]).mapInPandas(_rendered, f"conv_id {kind}, part int, seq long, audit string, roles array<string>, texts array<string>, {counts}")
    return whole.unionByName(parts.withColumn("segments", F.lit(0)))


def report(repaired: DataFrame) -> DataFrame:
    """A row for each conversation of ``repair``: conv_id, its counts, the audit and the SHA-256 of the repaired
    turns as ``role:text`` lines. A hash has to read in order, so one task streams the segments of a long one."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit(":"), x["texts"])), "\n")
    columns = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    lined = repaired.withColumn("lines", lines)
    whole = lined.where("segments = 1").withColumn("repaired_sha256", F.sha2("lines", 256)).select(columns)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, audit, digest, some = None, [], None, False

        def row() -> pd.DataFrame:
            return pd.DataFrame([[None if pd.isna(held["conv_id"]) else held["conv_id"], *(held[c] for c in _COUNTS), "".join(audit), digest.hexdigest()]], columns=columns).astype({"conv_id": object})

        for b in batches:
            for r in b.to_dict("records"):
                if held is None or not (held["conv_id"] == r["conv_id"] or (pd.isna(held["conv_id"]) and pd.isna(r["conv_id"]))):
                    if held is not None:
                        yield row()
                    held, audit, digest, some = r, [], hashlib.sha256(), False
                audit.append(r["audit"])
                if r["lines"]:
                    digest.update((("\n" if some else "") + r["lines"]).encode())
                    some = True
        if held is not None:
            yield row()

    cut = lined.where("segments = 0").select("conv_id", "part", "seq", "lines", "audit", *_COUNTS).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return whole.unionByName(cut.mapInPandas(stream, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string"))
