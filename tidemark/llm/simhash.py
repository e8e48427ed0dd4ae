"""SimHash fingerprints, linked by multi-index hashing.

A fingerprint is cut into two segments of 32 bits, with a table of fingerprints by value for each. Two fingerprints
that differ in RADIUS = 2 bits or fewer agree in one of the segments but for one bit at most. So each fingerprint
enumerates the ball of radius 1 around its value within each segment, fetches the fingerprints that the table holds
there, and the complete distance of each is verified. Of two values one bit apart only the one with the bit set
looks the other up; that finds the pair once and halves the probes.

A segment value that many fingerprints share (large groups of near copies make such) is split by the value of the
other segment: the table's fingerprints stand at every point of the ball around it, and probes ask for one point or
for the ball, as their distance so far leaves one bit or two. A split place holds 65 fingerprints at most and an unsplit one
HOT * 33, so no set of pairs grows with a group, and no link is lost.

``near_duplicates`` is the form for similar texts that lie further apart in bits. A wide fingerprint has many
segments, and each of them enumerates its ball of radius 1; texts whose segments meet at a point are candidates
for the least identifier there, complete distances prune them, and the exact similarity of word shingles decides.
Members that are not in one component then are matched with the next least ones, until no candidates are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import key_filter, marked, maybe_in, ready_workers, split_join, stored, without
from tidemark.llm.components import connected_components
from tidemark.llm.passages import dealt, verified_pairs

#: Bits in which linked fingerprints may differ.
RADIUS = 2
#: Shingles whose bits are counted at once; a long text needs no more memory than that.
BLOCK = 1 << 15
_digest = partial(xxh64_intdigest, seed=42)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(found: list[bytes], size: int) -> np.ndarray:
    """XXH64 with seed 42 of each run of ``size`` words; of all words if they are fewer."""
    if not found:
        return np.zeros(0, dtype=np.uint64)
    runs = zip(*(found[i:] for i in range(size)), strict=False) if len(found) >= size else [found]
    return np.fromiter(map(_digest, map(b" ".join, runs)), dtype=np.uint64, count=max(1, len(found) - size + 1))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): a 64-bit fingerprint of each whole text as a signed long; 0 if it has no word."""
    ready_workers(docs.sparkSession)

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([majority(shingle_hashes(words(t), shingle)) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", simhash("text").alias("fp"))


#: Fingerprints with one segment value from which the value is split by the other segment.
HOT = 32
_cleared = "transform(filter(sequence(0, 31), i -> shiftright(value, i) & 1 = 1), i -> value ^ shiftleft(1L, i))"
_ball = "concat(array(other), transform(sequence(0, 31), i -> other ^ shiftleft(1L, i)))"


def segment_places(distinct: DataFrame) -> DataFrame:
    """(segment, value, second, fp, own): where each fingerprint stands in the segments' tables (own) and where it
    looks for others. second is null, or a point of the other segment where the value is hot."""
    halves = ("shiftrightunsigned(fp, 32)", "fp & 4294967295L")
    cut = ", ".join(f"struct({k} as segment, {halves[k]} as value, {halves[1 - k]} as other)" for k in (0, 1))
    held = distinct.select("fp", F.explode(F.expr(f"array({cut})")).alias("s")).select("fp", "s.*")
    looked = F.expr(f"concat(array(struct(value, true as own)), transform({_cleared}, v -> struct(v as value, false as own)))")
    places = held.select("fp", "segment", "other", F.explode(looked).alias("at")).select("fp", "segment", "other", "at.*")
    crowded = held.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    hot = stored(crowded.select("segment", F.explode(F.expr(f"concat(array(value), {_cleared})")).alias("value")).distinct())
    if hot.isEmpty():
        return places.select("segment", "value", F.lit(None).cast("long").alias("second"), "fp", "own")
    # A bitmap of the hot values decides: a value that only shares its bit is split too, in table and probes alike.
    place = F.struct("segment", "value")
    split = marked(places, place, key_filter(hot, place), "hot")
    points = F.expr(f"if(not hot, array(cast(null as bigint)), if(own, {_ball}, array(other)))")
    return split.select("segment", "value", F.explode(points).alias("second"), "fp", "own")


def hamming_links(distinct: DataFrame) -> DataFrame:
    """All links (a, b), a < b, between the distinct fingerprints ``fp`` that differ in RADIUS bits or fewer."""
    met = segment_places(distinct).groupBy("segment", "value", "second").agg(
        F.collect_list(F.when(F.col("own"), F.col("fp"))).alias("held"), F.collect_list(F.when(~F.col("own"), F.col("fp"))).alias("probes")
    )
    met = met.where((F.size("held") > 0) & (F.size("held") + F.size("probes") > 1))
    pairs = met.select(F.explode("held").alias("x"), F.concat("held", "probes").alias("others")).select("x", F.explode("others").alias("y"))
    near = pairs.where((F.col("x") != F.col("y")) & (F.expr("bit_count(x ^ y)") <= RADIUS))
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row for each input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links reach, the row's own included; a null identifier is no
    candidate, so it is null where all rows of a component lack one. Null and blank texts have fingerprint zero
    and are linked like any other. Repeated rows are returned each. Other columns are not read.
    """
    rows = stored(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = stored(distinct)
    linked = connected_components(hamming_links(distinct))
    named = distinct.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = named.join(ids, "component").select("fp", "component_id")
    return rows.join(names, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The wide fingerprint, of the distinct shingles that are compared: SEGMENTS segments of SEGMENT_BITS bits. Sets of
#: similarity 0.8 differ in 0.15 of the bits, however the edits lie, and in up to 0.165 for texts of 8 to 32 shingles.
#: Two bits or fewer differ in one of 40 segments of 32 with 0.98 or more.
SEGMENTS, SEGMENT_BITS = 40, 32
#: Segments after the own one whose bits go with a row, and the share of them in which candidates differ at most: 3.5
#: standard deviations over 0.165.
CHECK_SEGMENTS, CHECK_DISTANCE = 4, 0.28
#: Distinct shingles of a long text; shares of differing bits up to which candidates are compared, for pairs of such and
#: for others: 4 standard deviations over 0.152 and over 0.165. Unrelated texts have a half.
LONG_TEXT, LONG_DISTANCE, WIDE_DISTANCE = 32, 0.195, 0.21
#: Distinct shingles up to which a text is looked up by its sets with one shingle left out: where one of two texts has
#: no more, similarity 0.8 means that at most one shingle is in one of them only.
SHORT = 7
#: Texts with one set of shingles from which they are dealt to several tasks.
HOT_ROWS = 4096
#: Rows of a segment that a group of ``segment_pairs`` should have, and points that it sorts at once.
GROUP_ROWS, POINTS = 1 << 18, 1 << 23
#: Members of a point up to which all its pairs are looked at to tell who can have a near copy.
POINT_PAIRS = 32
#: So many times as many members of a point are representatives when a round ends as when it begins.
RANKS = 8
#: Parts of the shingles' hashes in which shared ones are counted; a count of MOST_HELD stands for any higher one too.
PARTS, MOST_HELD = 128, 255
#: Rows packed for ``segment_pairs`` at once.
PACK = 1 << 14
_MIX = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 for k in range(SEGMENTS * SEGMENT_BITS // 64)], dtype=np.uint64)


def set_keys(hashes: np.ndarray) -> list[int]:
    """Keys of a short text's shingle set: of the whole first, then of the set without each one; none for long texts."""
    if not 0 < len(hashes) <= SHORT + 1:
        return []
    sets = [hashes, *(np.delete(hashes, i) for i in range(len(hashes) if len(hashes) > 1 else 0))]
    return np.array([xxh64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64).view(np.int64).tolist()


def wide_fingerprint(text: str | None, shingle: int = 5) -> bytes:
    """SEGMENTS * SEGMENT_BITS bits, from that many remixed copies of the distinct shingles' hashes."""
    return wide_bits(np.unique(shingle_hashes(words(text), shingle)))


def wide_bits(hashes: np.ndarray) -> bytes:
    ones = np.zeros(64 * len(_MIX), dtype=np.int64)
    for at in range(0, len(hashes), 255):  # counts of 255 rows fit in a byte
        mixed = (hashes[at : at + 255, None] ^ _MIX) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes()


def bucket_pairs(ids: np.ndarray, values: np.ndarray, labels: np.ndarray, checks: np.ndarray, sizes: np.ndarray, head: int, head_bits: int, lo: int, hi: int, similarity: float = 0.8, held: np.ndarray | None = None, near_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (rep, id) of one group, and the ids of buckets that have pairs left.

    Each value enumerates its ball of radius 1 as far as the points begin with the head_bits of ``head``. The
    members of a point, ordered by id, with a rank from lo to hi are matched with all later members of another label.
    Pairs that differ in over CHECK_DISTANCE of their ``checks``, bits of the next segments, are left out, and those
    whose ``sizes`` alone keep them under the similarity, or whose ``held`` do: counts of shingles by parts of their
    hashes, of which a pair shares the lesser of each at most. With lo = hi = 0 only buckets of several labels are told.
    With ``near_only`` the ids told are those with a pair of two labels, compared or not, that would not be left out;
    members of a point with over POINT_PAIRS are told without a look at their pairs. Unrelated texts often meet at a
    point where there are many texts; those are not told.
    """
    order = np.argsort(ids, kind="stable")
    held = None if held is None else held[order]
    ids, values, labels, checks, sizes = ids[order], values[order], labels[order], checks[order], sizes[order].astype(np.int64)
    tail, n = SEGMENT_BITS - head_bits, len(ids)
    low, row = values & np.uint64((1 << tail) - 1), np.arange(n, dtype=np.uint64)
    own = (values >> np.uint64(tail)) == head
    parts = 1 << max(0, (n * (tail + 1) // POINTS).bit_length())
    pairs, still = [], np.zeros(n, dtype=bool)

    def likely(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        other = (labels[a] != labels[b]) & (np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]))
        a, b = a[other], b[other]
        near = np.bitwise_count(checks[a] ^ checks[b]).sum(axis=1) <= CHECK_DISTANCE * 32 * CHECK_SEGMENTS
        return a[near], b[near]

    def fits(made: np.ndarray) -> np.ndarray:
        if held is None:
            return made
        room = []
        for x in np.split(made, range(PACK, len(made), PACK)):
            least = np.minimum(held[x // n], held[x % n])
            room.append(np.where((least == MOST_HELD).any(axis=1), np.inf, least.sum(axis=1, dtype=np.int64)))
        return made[(1 + similarity) * np.concatenate(room) >= similarity * (sizes[made // n] + sizes[made % n]) - 1e-6]

    for part in range(parts):
        some = []
        for points, rows in [(low, row)] + [(low[own] ^ np.uint64(1 << b), row[own]) for b in range(tail)]:
            here = (points & np.uint64(parts - 1)) == part
            some.append((points[here] << np.uint64(32)) | rows[here])
        keys = np.concatenate(some)
        if not len(keys):
            continue
        keys.sort()
        point = keys >> np.uint64(32)
        same = point[1:] == point[:-1]
        shared = np.r_[same, False] | np.r_[False, same]
        point, member = point[shared], (keys[shared] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if not len(member):
            continue
        starts = np.flatnonzero(np.r_[True, point[1:] != point[:-1]])
        start = np.repeat(starts, np.diff(np.r_[starts, len(member)]))
        rank = np.arange(len(member)) - start
        left = np.flatnonzero(rank > lo)
        for k in range(lo, hi):
            left = left[rank[left] > k]
            if not len(left):
                break
            a, b = likely(member[start[left] + k], member[left])
            pairs.append(fits(np.unique(a * n + b)))
        if near_only:
            large = np.diff(np.r_[starts, len(member)])[np.searchsorted(starts, start)] > POINT_PAIRS
            differ = np.isin(start, start[labels[member] != labels[member[start]]])
            still[member[large & differ]] = True
            left = np.flatnonzero(differ & ~large)
            for k in range(1, POINT_PAIRS):
                left = left[left + k < len(member)]
                left = left[start[left + k] == start[left]]
                if not len(left):
                    break
                a, b = likely(member[left], member[left + k])
                still[a] = still[b] = True
            continue
        late = np.flatnonzero(rank >= hi)
        late = late[labels[member[late]] != labels[member[start[late] + hi]]]
        still[member[np.isin(start, start[late])]] = True
    found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)
    return ids[found // max(1, n)], ids[found % max(1, n)], ids[still]


def segment_pairs(rows: DataFrame, head_bits: int, lo: int, hi: int, star: bool = False, similarity: float = 0.8) -> DataFrame:
    """(rep, id, more) of ``rows`` (id, wide, n, and label and held as far as there are): the pairs of ``bucket_pairs`` in
    all segments; where more is true, an id whose bucket has pairs left, or that has a likely pair if lo = 0. With
    ``star`` only the least rep of each id in a group is returned. Without labels each row has one of its own.

    A group is a segment and the first head_bits of its points; rows come packed, so a group is a few arrays. held is
    a list of part << 8 | count.
    """
    tail, has = SEGMENT_BITS - head_bits, set(rows.columns)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
            ids, sizes = b.id.to_numpy(np.int64), b.n.to_numpy(np.int32)
            labels = b.label.to_numpy(np.int64) if "label" in has else ids[:0]
            held = np.zeros((len(b) if "held" in has else 0, PARTS), dtype=np.uint8)
            if len(held):
                coded = np.concatenate(b.held.to_numpy()).astype(np.int64)
                held[np.repeat(np.arange(len(b)), [len(x) for x in b.held]), coded >> 8] = coded & 255
            wide = np.frombuffer(b"".join(b.wide), dtype="<u4").reshape(-1, SEGMENTS)
            for s in range(SEGMENTS):
                values, made = np.ascontiguousarray(wide[:, s]), []
                after = np.ascontiguousarray(wide[:, [(s + 1 + k) % SEGMENTS for k in range(CHECK_SEGMENTS)]])
                for head in range(1 << head_bits):
                    near = np.bitwise_count((values >> np.uint32(tail)) ^ np.uint32(head)) <= 1
                    if near.any():
                        more = [x[near].tobytes() if len(x) else b"" for x in (labels, held)]
                        made.append((s << head_bits | head, ids[near].tobytes(), values[near].tobytes(), more[0], after[near].tobytes(), sizes[near].tobytes(), more[1]))
                yield pd.DataFrame(made, columns=["grp", "ids", "vals", "labels", "checks", "sizes", "held"])

        kept, size = [], 0
        for b in batches:
            kept, size = [*kept, b], size + len(b)
            if size >= PACK:
                yield from out(pd.concat(kept))
                kept, size = [], 0
        if size:
            yield from out(pd.concat(kept))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(grp: int, parts: list[tuple]) -> pd.DataFrame:
            ids, vals, labels, checks, sizes, held = (np.frombuffer(b"".join(x), dtype=t) for x, t in zip(zip(*parts, strict=True), ("<i8", "<u4", "<i8", "<u4", "<i4", "<u1"), strict=True))
            labels, held = labels if "label" in has else ids, held.reshape(-1, PARTS) if "held" in has else None
            rep, other, still = bucket_pairs(ids, vals.astype(np.uint64), labels, checks.reshape(-1, CHECK_SEGMENTS), sizes, grp & ((1 << head_bits) - 1), head_bits, lo, hi, similarity, held, near_only=star or hi == 0)
            if star:
                order = np.lexsort((rep, other))
                rep, other = rep[order], other[order]
                first = np.r_[True, other[1:] != other[:-1]][: len(other)]
                rep, other = rep[first], other[first]
            return pd.DataFrame({"rep": np.r_[rep, still], "id": np.r_[other, still], "more": np.r_[np.zeros(len(rep), dtype=bool), np.ones(len(still), dtype=bool)]})

        current, parts = None, []
        for b in batches:
            for grp, *part in b.itertuples(index=False, name=None):
                if parts and grp != current:
                    yield out(current, parts)
                    parts = []
                current = grp
                parts.append(part)
        if parts:
            yield out(current, parts)

    groups = rows.select("id", "wide", "n", *(c for c in ("label", "held") if c in has)).mapInPandas(packed, "grp int, ids binary, vals binary, labels binary, checks binary, sizes binary, held binary")
    return groups.repartition(SEGMENTS << head_bits, "grp").sortWithinPartitions("grp").mapInPandas(match, "rep long, id long, more boolean")


def short_pairs(sketched: DataFrame) -> DataFrame:
    """(rep, id) of ``sketched`` (id, keys): texts whose shingle set, or it without one shingle, is that of rep; rep is
    the least with its set, and the others with that set are its pairs too, so none is lost."""
    keyed = stored(sketched.where(F.size("keys") > 0).select("id", F.posexplode("keys").alias("at", "key")))
    sets = stored(keyed.where("at = 0").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    met = split_join(keyed.select("key", "id"), sets.select("key", "rep"), "key", sets.where(F.col("n") > HOT_ROWS).select("key"), "id")
    return met.where("id <> rep").select(F.least("rep", "id").alias("rep"), F.greatest("rep", "id").alias("id")).distinct()


def held_shingles(texts: DataFrame, ids: DataFrame, hashes) -> DataFrame:
    """(id, held, n_held): how many shingles of each of the ``ids`` (id) the text (id, text) of another of them has too:
    in each of PARTS parts of the shingles that has any, as part << 8 | count up to MOST_HELD, and in all. Only shingles
    and counts are shuffled, not pairs."""

    def exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [hashes(t) for t in b.text]
            yield pd.DataFrame({"h": np.concatenate([np.zeros(0, dtype=np.uint64), *sets]).view(np.int64), "id": np.repeat(b.id.to_numpy(), [len(x) for x in sets])})

    some = stored(maybe_in(texts, "id", key_filter(ids, "id")).join(ids, "id", "left_semi").mapInPandas(exploded, "h long, id long"))
    alone = some.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    both = some.select("id", "h", F.lit(1).alias("n")).union(alone.select("id", "h", F.lit(-1)))
    counts = both.groupBy("id", F.pmod("h", F.lit(PARTS)).alias("part")).agg(F.sum("n").alias("n")).where("n > 0")
    coded = (F.col("part") * 256 + F.least("n", F.lit(MOST_HELD))).cast("int")
    return counts.groupBy("id").agg(F.collect_list(coded).alias("held"), F.sum("n").alias("n_held"))


def joined_groups(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): ``groups`` (node, component) with further ``links`` (rep, id). The links are between
    components then, so what was linked before isn't gone through again."""
    nodes = stored(groups.select("node").union(links.select("rep")).union(links.select("id")).distinct().join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    over = links.join(of("rep"), "rep").join(of("id"), "id").where("_rep <> _id").select(F.least("_rep", "_id").alias("a"), F.greatest("_rep", "_id").alias("b")).distinct()
    new = connected_components(stored(over)).select(F.col("node").alias("component"), F.col("component").alias("_least"))
    return stored(nodes.join(new, "component", "left").select("node", F.coalesce("_least", "component").alias("component")))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sorted sets of hashes; two empty sets are alike."""
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of the documents that have a near copy: shingle sets of that similarity or more.

    component_id is the smallest doc_id of the group. Identifiers must be unique; rows without one are left out.
    Texts without a word are not compared with anything. Members of a point are matched with its least id first; in
    the rounds after that those of points with more than one component go on with the next least ids, so in the end
    every two members of a point have been compared or are in one component. Large groups of copies hold many that
    were edited too much to be like any other: for these rounds each text's shingles that another candidate has are
    counted in PARTS parts, and pairs whose counts leave no room for the similarity are not made, which loses none.
    """
    ready_workers(docs.sparkSession)

    @F.pandas_udf("wide binary, n int, keys array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [np.unique(shingle_hashes(words(t), shingle)) for t in texts]
            yield pd.DataFrame({"wide": [wide_bits(x) for x in sets], "n": [len(x) for x in sets], "keys": [set_keys(x) for x in sets]})

    def prepare(text: str) -> np.ndarray:
        return np.unique(shingle_hashes(words(text), shingle))

    def compare(x: np.ndarray, y: np.ndarray) -> list:
        return [()] if jaccard(x, y) >= similarity else []

    apart = F.expr(
        f"aggregate(sequence(0, {SEGMENTS * SEGMENT_BITS // 64 - 1}), 0, (s, i) -> s + bit_count("
        "cast(conv(hex(substring(wide, i * 8 + 1, 8)), 16, -10) as bigint) ^ cast(conv(hex(substring(rep_wide, i * 8 + 1, 8)), 16, -10) as bigint)))"
    )
    some = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(F.col("doc_id").cast("long").alias("id"), "text")
    sketched = stored(some.select("id", sketch("text").alias("s")).select("id", "s.*"))
    rows = sketched.where(F.col("n") > SHORT).drop("keys")
    wides, reps = rows.select("id", "wide", "n"), rows.select(F.col("id").alias("rep"), F.col("wide").alias("rep_wide"), F.col("n").alias("rep_n"))
    head_bits = max(2, (rows.count() // GROUP_ROWS).bit_length())
    most = F.when((F.col("n") >= LONG_TEXT) & (F.col("rep_n") >= LONG_TEXT), LONG_DISTANCE).otherwise(WIDE_DISTANCE) * (SEGMENTS * SEGMENT_BITS)
    alike = (F.col("n") >= similarity * F.col("rep_n")) & (F.col("rep_n") >= similarity * F.col("n"))

    def among(of: DataFrame, ids: DataFrame) -> DataFrame:
        return maybe_in(of, "id", key_filter(ids, "id")).join(ids, "id", "left_semi")

    def labelled(of: DataFrame) -> DataFrame:
        names = groups.select(F.col("node").alias("id"), "component")
        return stored(of.drop("label").join(names, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component"))

    # First every text with the least id at any of its points: large groups of copies are in one component then.
    found = stored(segment_pairs(rows, head_bits, 0, 1, star=True, similarity=similarity))
    compared = stored(found.where("not more").groupBy("id").agg(F.min("rep").alias("rep")).select("rep", "id"))
    chunked = dealt(compared)
    heads = chunked.select("rep", "chunk").distinct().join(reps, "rep")
    close = stored(chunked.join(wides, "id").join(heads, ["rep", "chunk"]).where(alike & (apart <= most)).select("rep", "id"))
    links = stored(verified_pairs(close, some, prepare, compare, [])).union(stored(verified_pairs(stored(short_pairs(sketched)), some, prepare, compare, [])))
    groups = connected_components(links.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    # Whoever can meet in a later round; texts that can't be like any of these go before ranks are counted.
    rows = labelled(among(rows, stored(found.where("more").select("id").distinct())))
    left = stored(segment_pairs(rows, head_bits, 0, 0, similarity=similarity).select("id").distinct())
    held = held_shingles(some, left, prepare)
    rows = stored(rows.join(held, "id").where(F.col("n_held") >= similarity * F.col("n") - 1e-6).drop("n_held"))
    lo, hi = 0, 1
    while not left.isEmpty():
        found = stored(segment_pairs(rows, head_bits, lo, hi, similarity=similarity))
        met = stored(found.where("not more").select("rep", "id").distinct().join(compared, ["rep", "id"], "left_anti"))
        if not met.isEmpty():
            compared = compared.union(met)
            # The counts of shared shingles tell more than the bits, so all of these are compared.
            groups = joined_groups(groups, stored(verified_pairs(met, some, prepare, compare, [])))
        left = stored(found.where("more").select("id").distinct())
        rows = labelled(rows.join(left, "id", "left_semi"))
        lo, hi = hi, hi * RANKS
    return groups.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each group of ``near_duplicates`` the one with the smallest doc_id, and all
    documents without a near copy, with the columns of ``docs``."""
    return without(docs, near_duplicates(docs).where("component_id <> doc_id").select("doc_id"), "doc_id")
