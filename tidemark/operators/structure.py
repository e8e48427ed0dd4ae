"""Structure of a corpus: contexts of chunks, manifests, the supersession graph, near copies and unlinked chains."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.text import supersedes_key
from tidemark.functions.vectors import dot
from tidemark.operators.retrieval import small
from tidemark.operators.trust import resolve_references
from tidemark.sources.shared import stored

#: Characters of a neighbour, of a shortened section, and the rungs of the ladder from rich to poor.
NEIGHBOR_CHARS, SHORT_SECTION = 200, 60
RUNGS = ("full", "drop-neighbor", "shorten-section", "drop-section", "drop-title", "chunk-only")
KINDS = {"text": ("md", "txt", "rst"), "html": ("html", "htm"), "table": ("csv", "tsv"), "json": ("json",), "code": ("py",)}


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def contexts(chunks: DataFrame, budget: int) -> DataFrame:
    """(file, ord, rung, passage) of ``chunks`` (file, ord, text, title, section): each chunk with its title, section,
    source and the ends of its neighbours, as far as the words fit ``budget``.

    Neighbours go first, then the section is shortened and dropped, then the title, then the source; the chunk is
    never shortened. Neighbours are found by their place, so a document is never gathered.
    """
    line = one_line(F.col("text"))
    order = W.partitionBy("file").orderBy("ord")
    placed = chunks.withColumns({"before": F.lag(line).over(order), "after": F.lead(line).over(order)})
    tail, head = F.right(F.coalesce("before", F.lit("")), F.lit(NEIGHBOR_CHARS)), F.left(F.coalesce("after", F.lit("")), F.lit(NEIGHBOR_CHARS))

    def render(title=None, section=None, source=None, previous=None, following=None) -> Column:
        field = lambda name, value: F.when(value != "", F.concat(F.lit(f"{name}: "), value))
        parts = [field(n, v) for n, v in (("title", title), ("section", section), ("source", source), ("previous", previous)) if v is not None]
        parts.append(F.concat(F.lit("content: "), F.col("text")))
        parts += [field("following", following)] if following is not None else []
        return F.concat_ws("\n", *parts)

    title, section, source = one_line(F.col("title")), one_line(F.col("section")), F.col("file").cast("string")
    ladder = (
        render(title, section, source, tail, head), render(title, section, source), render(title, F.left(section, F.lit(SHORT_SECTION)), source),
        render(title, None, source), render(None, None, source), F.col("text"),
    )
    choice = F.lit(None)
    for rung, passage in reversed(list(zip(RUNGS[:-1], ladder[:-1], strict=True))):
        choice = F.when(n_words(passage) <= budget, F.struct(F.lit(rung).alias("rung"), passage.alias("passage"))).otherwise(choice if rung != RUNGS[-2] else F.struct(F.lit(RUNGS[-1]).alias("rung"), ladder[-1].alias("passage")))
    return placed.withColumn("chosen", choice).select("file", "ord", "chosen.rung", "chosen.passage")


#: Rows of a segment of ``packed``.
FOLD = 4096


def _pack_starts(ahead: np.ndarray, sizes: np.ndarray, most: int, used: int) -> np.ndarray:
    """Where batches begin among rows of these sizes, ``used`` being in the batch that is open before them. ``ahead``
    are the running sums of the sizes with what is paid between rows."""
    starts, at = [], int(np.searchsorted(ahead, most - used, side="right"))
    while at < len(sizes):
        starts.append(at)
        at = max(at + 1, int(np.searchsorted(ahead, most - sizes[at] + ahead[at], side="right")))
    return np.array(starts, dtype=np.int64)


def _pack_map(ahead: np.ndarray, sizes: np.ndarray, most: int) -> tuple[list, list, list]:
    """What a segment makes of the batch that is open before it: (top, fill, more). The first row that doesn't fit
    decides what follows; rows after which the same follows are one entry, with the greatest running sum."""
    n = len(sizes)
    follows = np.maximum(np.arange(1, n + 1), np.searchsorted(ahead, most - sizes + ahead, side="right"))
    fill, more = sizes + ahead[-1] - ahead, np.ones(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        if follows[i] < n:
            fill[i], more[i] = fill[follows[i]], more[follows[i]] + 1
    last = np.r_[(fill[1:] != fill[:-1]) | (more[1:] != more[:-1]), True]
    return ahead[last].tolist(), fill[last].tolist(), more[last].tolist()


def packed(rows: DataFrame, by: str, order: str, size: str, most: int, joint: int = 0) -> DataFrame:
    """(by, order, batch): rows packed in order into batches of ``most`` in all; ``joint`` is paid between two rows.

    A row over ``most`` has a batch of its own; a null size is 0. Rows are sorted by ranges and cut into segments of
    FOLD rows. A group that is one segment inside a task is packed as it is; segments of the others are turned into
    small maps from the open batch before them to the one behind. Only these maps are chained, group by group; then
    every segment is packed behind what the chain has left open for it.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (by, order)}
    ranged = rows.select(F.col(by).alias("g"), F.col(order).alias("o"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("s")).repartitionByRange("g", "o")
    ranged = ranged.sortWithinPartitions("g", "o").withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held_o, held_s, seq, nth, first, part = None, [], [], 0, 0, True, 0

        def segment(whole: bool) -> tuple:
            sizes = np.array(held_s, dtype=np.int64)
            top, fill, more = ([], [], []) if whole else _pack_map(np.cumsum(sizes + joint), sizes, most)
            return group, part, seq, held_o, sizes, top, fill, more, whole

        for b in batches:
            out, part = [], int(b.part.iloc[0]) if len(b) else part
            groups, orders, sizes = b.g.astype(object).tolist(), b.o.tolist(), b.s.tolist()
            codes = pd.factorize(b.g, use_na_sentinel=False)[0]
            for x, y in pairwise([*np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(b)]).tolist(), len(b)]):
                if held_o and groups[x] != group and not (pd.isna(groups[x]) and pd.isna(group)):
                    out.append(segment(nth == 0 and not first))
                    held_o, held_s, seq, nth, first = [], [], seq + 1, 0, False
                group = groups[x]
                while x < y:
                    if len(held_o) >= FOLD:
                        out.append(segment(False))
                        held_o, held_s, seq, nth = [], [], seq + 1, nth + 1
                    to = min(y, x + FOLD - len(held_o))
                    held_o, held_s, x = held_o + orders[x:to], held_s + sizes[x:to], to
            yield pd.DataFrame(out, columns=columns).astype({"g": object})
        if held_o:
            yield pd.DataFrame([segment(False)], columns=columns).astype({"g": object})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        used, batch, out = most + 1, -1, []  # the first row opens a batch
        for r in pdf.sort_values(["part", "seq"]).itertuples(index=False):
            out.append((r.part, r.seq, used, batch))
            at = int(np.searchsorted(r.top, most - used, side="right"))
            used, batch = (int(r.fill[at]), batch + int(r.more[at])) if at < len(r.top) else (used + int(r.top[-1]), batch)
        return pd.DataFrame(out, columns=["part", "seq", "used", "open"])

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            groups, orders, numbers = [], [], [np.zeros(0, dtype=np.int64)]
            for g, o, s, used, before in zip(b.g.astype(object), b.o, b.s, b.used.tolist(), b.open.tolist(), strict=True):
                sizes = np.asarray(s, dtype=np.int64)
                starts = _pack_starts(np.cumsum(sizes + joint), sizes, most, used)
                numbers.append(before + np.searchsorted(starts, np.arange(len(sizes)), side="right"))
                groups += [g] * len(sizes)
                orders += list(o)
            yield pd.DataFrame({by: pd.Series(groups, dtype=object), order: pd.Series(orders, dtype=object), "batch": np.concatenate(numbers)})

    columns = ["g", "part", "seq", "o", "s", "top", "fill", "more", "whole"]
    segments = stored(ranged.mapInPandas(cut, f"g {kinds[by]}, part int, seq long, o array<{kinds[order]}>, s array<long>, top array<long>, fill array<long>, more array<long>, whole boolean"))
    opened = segments.where("not whole").select("g", "part", "seq", "top", "fill", "more").groupBy("g").applyInPandas(chain, "part int, seq long, used long, open long")
    chained = segments.where("not whole").select("g", "part", "seq", "o", "s").join(opened, ["part", "seq"]).select("g", "o", "s", "used", "open")
    alone = segments.where("whole").select("g", "o", "s", F.lit(most + 1).cast("long").alias("used"), F.lit(-1).cast("long").alias("open"))
    return alone.unionByName(chained).mapInPandas(numbered, f"`{by}` {kinds[by]}, `{order}` {kinds[order]}, batch long")


def kind_of(file: Column) -> Column:
    """How a file is read, by its suffix; null for what is not supported."""
    suffix = F.lower(F.regexp_extract(file, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, suffixes in KINDS.items():
        out = F.when(suffix.isin(*suffixes), kind).otherwise(out)
    return out


def graph_edges(chunks: DataFrame, tenant_id: str, generation_id: str) -> DataFrame:
    """(edge_id, from_file, to_file, reference, asserted_at, conflicting): authored supersession edges of ``chunks``
    (file, supersedes, first_indexed). A claim that leaves any row undated is undated; a target with several
    claims is conflicting. Ambiguous references make no edge, dangling ones lead to a name without a node."""
    resolved = resolve_references(chunks).where("status <> 'ambiguous'")
    claims = resolved.groupBy(F.col("target").alias("from_file"), F.col("file").alias("to_file")).agg(
        F.min("supersedes").alias("reference"), F.when(F.count(F.lit(1)) == F.count("first_indexed"), F.min("first_indexed")).alias("asserted_at"))
    many = claims.groupBy(F.col("from_file").alias("_f")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    edge_id = F.md5(F.concat_ws("|", F.lit(tenant_id), F.lit(generation_id), F.lit("authored_supersedes"), "from_file", "to_file", "reference", F.coalesce(F.date_format("asserted_at", "yyyy-MM-dd HH:mm:ss"), F.lit(""))))
    return claims.join(many, F.col("from_file") == F.col("_f"), "left").select(edge_id.alias("edge_id"), "from_file", "to_file", "reference", "asserted_at", F.col("_n").isNotNull().alias("conflicting"))


def near_pairs(hits: DataFrame, threshold: float) -> DataFrame:
    """(query_id, a, b, cosine) of hits (query_id, id, vector) of one query; its pool bounds the pairs."""
    unit = hits.select("query_id", "id", F.transform("vector", lambda x: x.cast("double") / F.sqrt(dot(F.col("vector"), F.col("vector")))).alias("v"))
    a, b = unit.select("query_id", F.col("id").alias("a"), F.col("v").alias("va")), unit.select("query_id", F.col("id").alias("b"), F.col("v").alias("vb"))
    pairs = a.join(b, "query_id").where("a < b").withColumn("cosine", F.round(dot(F.col("va"), F.col("vb")), 9))
    return pairs.where(F.col("cosine") >= threshold).select("query_id", "a", "b", "cosine")


def unlinked_chains(similar: DataFrame, memos: DataFrame, threshold: float) -> DataFrame:
    """(file, candidate, cosine): closed decisions near a memo that neither of the two references.

    ``similar`` is (file, candidate, cosine), ``memos`` (file, supersedes, closed). Files that share a base name
    are left out: a reference can't tell them apart.
    """
    named = memos.withColumn("key", supersedes_key(F.col("file")))
    single = named.groupBy("key").agg(F.count_distinct("file").alias("n")).where("n = 1").select("key")
    known = named.join(single, "key", "left_semi")
    links = known.where("supersedes is not null").select(F.col("key").alias("x"), supersedes_key(F.col("supersedes")).alias("y"))
    both = links.union(links.select("y", "x")).distinct()
    near = similar.where((F.col("cosine") >= threshold) & (F.col("file") != F.col("candidate"))).withColumn("x", supersedes_key(F.col("file"))).withColumn("y", supersedes_key(F.col("candidate")))
    closed = known.where("closed").select(F.col("key").alias("y")).distinct()
    return near.join(small(single.withColumnRenamed("key", "x")), "x", "left_semi").join(small(closed), "y", "left_semi").join(both, ["x", "y"], "left_anti").select("file", "candidate", "cosine")


def proposal_scores(proposals: DataFrame, expected: DataFrame) -> DataFrame:
    """(rule, predicted, true_positive, precision, recall, referral_rate) against ``expected`` (subject, object):
    asserted proposals are scored as distinct pairs; those that ask for review are only counted."""
    asserted = proposals.where("status = 'proposed'").select("rule", "subject", "object").distinct()
    hits = asserted.join(expected.select("subject", "object", F.lit(1).alias("_hit")).distinct(), ["subject", "object"], "left")
    scored = hits.groupBy("rule").agg(F.count(F.lit(1)).alias("predicted"), F.count("_hit").alias("true_positive"))
    considered = proposals.groupBy("rule").agg(F.avg((F.col("status") == "requires_review").cast("double")).alias("referral_rate"))
    n = expected.select("subject", "object").distinct().agg(F.count(F.lit(1)).alias("n"))  # one row
    joined = considered.join(scored, "rule", "left").crossJoin(F.broadcast(n))
    tp = F.coalesce("true_positive", F.lit(0))
    return joined.select("rule", F.coalesce("predicted", F.lit(0)).alias("predicted"), tp.alias("true_positive"), (tp / F.col("predicted")).alias("precision"), (tp / F.nullif("n", F.lit(0))).alias("recall"), "referral_rate")


def coerced(proposals: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """(id, problem) of a provider's proposals (id, subject, object, relation, confidence, evidence): the first rule
    that one breaks, or null."""
    problem = (
        F.when(F.col("subject").isNull() | F.col("object").isNull() | (F.trim("subject") == "") | (F.trim("object") == ""), "names no two files")
        .when(F.col("subject") == F.col("object"), "relates a file to itself").when(~F.coalesce(F.col("relation").isin(*relations), F.lit(False)), "unknown relation")
        .when(F.col("confidence").isNull() | F.isnan("confidence") | ~F.col("confidence").between(0.0, 1.0), "confidence out of range").when(F.coalesce(F.size("evidence"), F.lit(0)) < 1, "no evidence")
    )
    return proposals.select("id", problem.alias("problem"))


def citations(answers: DataFrame) -> DataFrame:
    """(id, cited, problem) of (id, answer, evidence): ids in brackets in order of first use; an answer that cites
    nothing, or what it wasn't given, has a problem."""
    cited = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[([A-Za-z0-9_-]+)\]"), F.lit(1)))
    problem = F.when(F.size("cited") == 0, "cites nothing").when(F.size(F.array_except("cited", "evidence")) > 0, "cites what is not in evidence")
    return answers.withColumn("cited", cited).select("id", "cited", problem.alias("problem"))


def session_time(text: Column) -> Column:
    """Times such as ``1:56 pm on 8 May, 2023``; null for anything else."""
    shape = r"^(\d{1,2}):(\d{2}) (am|pm) on (\d{1,2}) ([A-Za-z]+), (\d{4})$"
    part = lambda i: F.regexp_extract(text, shape, i)
    hour = part(1).try_cast("int") % 12 + F.when(part(3) == "pm", 12).otherwise(0)
    day = F.try_to_timestamp(F.concat_ws(" ", part(4), part(5), part(6)), F.lit("d MMMM yyyy"))
    return F.when(text.rlike(shape), F.timestamp_add("MINUTE", hour * 60 + part(2).try_cast("int"), day))
