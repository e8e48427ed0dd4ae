"""Near-duplicate passages by compact windows.

Tokens are runs of five words. For each hash function the Cartesian tree over a text's token hashes gives its
compact windows (l, c, r): every subsequence that begins in [l, c] and ends in [c, r] has its min-hash at c. The
windows divide all beginnings of RUN tokens into intervals of one signature; an interval join of two hash functions'
intervals gives the groups that share both signatures, and their keys are what texts are matched by. Two texts with
RUN equal tokens in a row always share such a key. Passages that reach the similarity have them: where words were
replaced, put in or taken out, each place of an edit costs 9 tokens of the two sets or more, so of 40 shared tokens
in 50 words one edit leaves 20 in a row, and longer passages more. Only passages that repeat their own words can
be edited more often at that similarity.

A key's texts are matched with its least identifier first, and every match is verified on the whole texts: the
passages' token sets must have the required similarity. Where a text's place with that key is in no passage that it
shares with the identifier, it goes on to further rounds with the texts that are left. Their keys are refined by
the min-hashes of more functions around the place, so texts that only share a common line part. A place that a
found passage holds looks for no further representative, but stays one for the others; rounds end when no two texts
are left at a key where one looks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from xxhash import xxh64_intdigest

from tidemark.llm.common import key_filter, maybe_in, ready_workers, stored
from tidemark.llm.passages import verified_pairs

#: Words of a token, least words of a passage, similarity of the token sets.
SHINGLE, LEAST_WORDS, SIMILARITY = 5, 50, 0.8
#: Tokens in a row whose keys are made: passages of that similarity share as many.
RUN = 20
#: Pairs of hash functions whose windows are joined.
PAIRS = ((0, 1),)
#: Characters of texts whose windows are made at once.
PART_CHARS = 2_000_000
#: Tokens that may differ in a row inside a passage, tried from the widest: two edits, one edit, none.
GAPS = (12, 5, 0)
#: A refined key holds the min-hashes of so many functions; so many of them are made of each place. Passages of
#: similarity 0.8 that share a key share one of the refined ones with 1 - (1 - 0.8^4)^8 = 0.985 at each place.
REFINED_BY, REFINED_KEYS = 4, 8
#: So many times as many texts of a key are representatives when a round ends as when it begins.
RANKS = 8
_FIRST, _GOLD = 2, np.uint64(0x9E3779B97F4A7C15)
_MIX = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 for k in range(_FIRST + REFINED_BY * REFINED_KEYS)], dtype=np.uint64)


#: Bytes that part words, and what is left of 8 bytes in which a word has so many.
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LEFT = np.array([2 ** (8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Bytes of a word that are read 8 at a time for all words of a batch at once; longer words are hashed alone.
LONG_WORD = 64


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of ``data``, and where it begins: 8 bytes of all words are mixed in at once."""
    padded = np.frombuffer(data + b" " * 16, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(_BLANK[padded], prepend=True))
    begins, sizes = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))  # the 8 bytes from each byte on
    out = sizes.astype(np.uint64) * _GOLD
    some = np.arange(len(begins))
    for at in range(0, LONG_WORD, 8):
        some = some[sizes[some] > at]
        if not len(some):
            break
        mixed = (out[some] ^ (eights[begins[some] + at] & _LEFT[np.minimum(sizes[some] - at, 8)])) * np.uint64(0xBF58476D1CE4E5B9)
        out[some] = mixed ^ (mixed >> np.uint64(32))
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = xxh64_intdigest(data[begins[i] : begins[i] + sizes[i]])
    return out, begins


def token_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """For each text a hash of each run of SHINGLE words, from the words' own; none if they are fewer."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    each, begins = word_hashes(b" ".join(coded).lower())
    bounds = np.searchsorted(begins, np.cumsum([0] + [len(c) + 1 for c in coded]))
    total = np.zeros(max(0, len(each) - SHINGLE + 1), dtype=np.uint64)
    for j in range(SHINGLE):
        total = total * np.uint64(0x9E3779B97F4A7C15) + each[j : j + len(total)]
    total ^= total >> np.uint64(32)
    return [total[a : max(a, b - SHINGLE + 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def remixed(hashes: np.ndarray, k) -> np.ndarray:
    mixed = (hashes ^ _MIX[k]) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    return mixed * np.uint64(0x94D049BB133111EB)


def _sliding(op, values: np.ndarray, size: int) -> np.ndarray:
    """op (minimum or maximum) over each run of ``size`` values along the last axis."""
    out, width = values, 1
    while width * 2 <= size:
        out = op(out[..., :-width], out[..., width:])
        width *= 2
    n = values.shape[-1] - size + 1
    return op(out[..., :n], out[..., size - width : size - width + n])


def nearest(values: np.ndarray, less) -> np.ndarray:
    """The nearest place before each whose value is ``less`` than its own; -1 if none is. All that look go on at once
    from the place they have come to, to the one that this has come to."""
    to = np.arange(-1, len(values) - 1)
    some = np.flatnonzero(to >= 0)
    while len(some):
        some = some[~less(values[to[some]], values[some])]
        to[some] = to[to[some]]
        some = some[to[some] >= 0]
    return to


def compact_windows(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compact windows of ``least`` tokens and more as arrays l, c, r in order of c; of equal values the first
    is less.

    Only tokens that are the minimum of some run of ``least`` can own such a window, and the nearest lesser tokens
    around an owner are owners too (or ends of the text). So the Cartesian tree is built over the owners alone,
    about 2 / least of all tokens.
    """
    n = len(values)
    if n < least:
        return (np.zeros(0, dtype=np.int64),) * 3
    low = np.concatenate([np.zeros(least - 1, dtype=values.dtype), _sliding(np.minimum, values, least), np.zeros(least - 1, dtype=values.dtype)])
    owners = np.flatnonzero(values <= _sliding(np.maximum, low, least))
    own = values[owners]
    left, right = nearest(own, np.less_equal), len(own) - 1 - nearest(own[::-1], np.less)[::-1]
    begin = np.where(left < 0, 0, owners[left] + 1)
    end = np.where(right == len(own), n, owners[np.minimum(right, len(own) - 1)]) - 1
    wide = end - begin + 1 >= least
    return begin[wide], owners[wide], end[wide]


def signature_runs(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each run of beginnings with one min-hash starts, that min-hash and its place; in order of the beginnings."""
    lo, c, hi = compact_windows(values, least)
    begin = np.maximum(lo, c - least + 1)
    some = np.flatnonzero(begin <= np.minimum(c, hi - least + 1))
    some = some[np.argsort(begin[some], kind="stable")]
    return begin[some], values[c[some]], c[some]


def passage_keys(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The keys of each whole text, and the spot of each: the place of its first min-hash and, in the low 32 bits, the
    first beginning it is of. A key stands once for each stretch of beginnings it is of, with the place of the last
    one. No key if a text has fewer than LEAST_WORDS words.

    Texts are laid one after the other with a zero between them: it is less than any token, so no window crosses.
    """
    hashed = [h if len(h) > LEAST_WORDS - SHINGLE else h[:0] for h in token_hashes(texts)]
    starts = np.cumsum([0] + [len(h) + 1 for h in hashed])
    laid = np.concatenate([x for h in hashed for x in (h, np.zeros(1, dtype=np.uint64))] or [np.zeros(1, dtype=np.uint64)])
    out_keys, out_texts, out_spots = [], [], []
    runs = []
    for k in range(_FIRST):
        values = np.maximum(remixed(laid, k), np.uint64(1))
        values[starts[1:] - 1] = 0
        runs.append(signature_runs(values, RUN))
    for a, b in PAIRS:
        (begin_a, low_a, place_a), (begin_b, low_b, _) = runs[a], runs[b]
        joined = np.union1d(begin_a, begin_b)
        if not len(joined):
            continue
        in_a, in_b = np.searchsorted(begin_a, joined, side="right") - 1, np.searchsorted(begin_b, joined, side="right") - 1
        inside = (low_a[in_a] != 0) & (low_b[in_b] != 0)
        of_a, of_b, first = low_a[in_a][inside], low_b[in_b][inside], joined[inside]
        owner = np.searchsorted(starts, first, side="right") - 1
        made = (of_a * _GOLD) ^ (of_b + np.uint64(a))
        begins = np.flatnonzero(np.r_[True, (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])][: len(made)])
        place = place_a[in_a][inside][np.r_[begins[1:], len(made)] - 1] if len(made) else first
        owner, first = owner[begins], first[begins]
        out_keys.append(made[begins])
        out_texts.append(owner)
        out_spots.append(((place - starts[owner]) << 32) | (first - starts[owner]))
    if not out_keys:
        return [(np.zeros(0, dtype=np.int64),) * 2] * len(texts)
    keys, owner, spots = np.concatenate(out_keys), np.concatenate(out_texts), np.concatenate(out_spots)
    order = np.lexsort((keys, owner))
    keys, owner, spots = keys[order], owner[order], spots[order]
    cut = np.searchsorted(owner, np.arange(1, len(texts)))
    return list(zip(np.split(keys.view(np.int64), cut), np.split(spots, cut), strict=True))


def stretches(hashes: np.ndarray, spots: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(spot, tokens): the tokens of all passages of the least length that hold the spot's place; a passage that holds
    several places is in the first one's stretch only."""
    least, out, done = LEAST_WORDS - SHINGLE + 1, [], -1
    for spot in np.unique(spots >> 32).tolist():  # in order of the places
        first, last = max(done + 1, spot - least + 1, 0), min(spot, len(hashes) - least)
        if first <= last:
            out.append((spot << 32, hashes[first : last + least]))
            done = last
    return out


def stretch_keys(stretch: list[np.ndarray], alone: np.ndarray) -> list[np.ndarray]:
    """REFINED_KEYS keys or more of each stretch: the least hashes, by REFINED_BY functions, of each of its passages of
    the least length; without those that have more tokens of ``alone`` than similar passages of as many tokens can."""
    least = LEAST_WORDS - SHINGLE + 1
    laid = np.concatenate([np.zeros(0, dtype=np.uint64), *stretch])
    owner = np.repeat(np.arange(len(stretch)), [len(h) for h in stretch])
    if len(laid) < least:
        return [laid[:0]] * len(stretch)
    order = np.lexsort((laid, owner))  # a token that repeats counts once, where it is first
    again = np.flatnonzero((laid[order[1:]] == laid[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])) + 1
    once = np.isin(laid, alone).astype(np.int64)
    once[order[again]] = 0
    own = np.r_[0, np.cumsum(once)]
    own = own[least:] - own[:-least]
    begins = np.flatnonzero((owner[least - 1 :] == owner[: len(own)]) & (own <= (1 - SIMILARITY) / (1 + SIMILARITY) * least))
    made = np.repeat(np.arange(1, REFINED_KEYS + 1, dtype=np.uint64)[:, None] * _GOLD, len(begins), axis=1)
    for j in range(REFINED_BY):
        low = _sliding(np.minimum, remixed(laid[None], np.arange(_FIRST + j, len(_MIX), REFINED_BY)[:, None]), least)[:, begins]
        made = (made ^ low) * _GOLD
        made = made ^ (made >> np.uint64(29))
    # Neighbours mostly share a key; the rest of what repeats goes with the sort.
    new = np.ones(made.shape, dtype=bool)
    new[:, 1:] = (made[:, 1:] != made[:, :-1]) | (owner[begins[1:]] != owner[begins[:-1]])
    keys, of = made[new], np.broadcast_to(owner[begins], made.shape)[new]
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    return np.split(keys[first], np.searchsorted(of[first], np.arange(1, len(stretch)))) if stretch else []


def refined_keys(text: str | None, keys: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all stretches around the spots of a text, whatever their keys were, and the spots they are of."""
    around = stretches(token_hashes([text])[0], spots)
    made = stretch_keys([h for _, h in around], np.zeros(0, dtype=np.uint64))
    return np.concatenate([np.zeros(0, dtype=np.uint64), *made]).view(np.int64), np.repeat(np.array([x for x, _ in around], dtype=np.int64), [len(k) for k in made])


class Tokens:
    """A text's token hashes in order, and what look-ups need, made where there are any."""

    def __init__(self, text: str | None, hashes: np.ndarray | None = None):
        self.hashes = token_hashes([text])[0] if hashes is None else hashes

    @cached_property
    def _sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places in order of their hashes, the hashes in that order, and whether each is the first of its value."""
        order = np.argsort(self.hashes, kind="stable")
        hashes = self.hashes[order]
        first = np.ones(len(hashes), dtype=bool)
        first[1:] = hashes[1:] != hashes[:-1]
        return order, hashes, first

    @cached_property
    def before(self) -> np.ndarray:
        """The place of the same token before each; -1 if there is none."""
        order, _, first = self._sorted
        out = np.full(len(order), -1)
        again = (~first).nonzero()[0]
        out[order[again]] = order[again - 1]
        return out

    @cached_property
    def distinct(self) -> np.ndarray:
        """The distinct hashes in order."""
        _, hashes, first = self._sorted
        return hashes[first]

    @cached_property
    def numbers(self) -> np.ndarray:
        """Each token's place in ``distinct``."""
        order, _, first = self._sorted
        out = np.empty(len(order), dtype=np.int64)
        out[order] = np.cumsum(first) - 1
        return out

    def numbered(self, some: np.ndarray) -> np.ndarray:
        """The place in ``distinct`` of each of ``some``; their number for hashes that aren't there."""
        n = len(self.distinct)
        if not n:
            return np.zeros(len(some), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.distinct, some), n - 1)
        return np.where(self.distinct[at] == some, at, n)

    def n_distinct(self, a: int, b: int) -> int:
        """How many distinct tokens a to b are."""
        return int(np.count_nonzero(self.before[a : b + 1] < a))


def tokens_of(texts: Iterable[str | None]) -> Iterator[Tokens]:
    return (Tokens(None, h) for part in batched(texts) for h in token_hashes(part))


def _alike(x: Tokens, y: Tokens, own: np.ndarray, a: int, b: int, c: int, d: int) -> bool:
    """Whether the sets of tokens a to b of x, whose numbers in y are ``own``, and c to d of y are similar."""
    held = np.zeros(len(y.distinct) + 1, dtype=bool)
    held[own[a : b + 1]] = True
    both = int(np.count_nonzero(held[y.numbers[c : d + 1]] & (y.before[c : d + 1] < c)))
    return both / (x.n_distinct(a, b) + y.n_distinct(c, d) - both) >= SIMILARITY


def _grown(x: Tokens, y: Tokens, own: np.ndarray, a: int, b: int, c: int, d: int, least: int) -> tuple[int, int, int, int] | None:
    """Tokens a to b of x and c to d of y, both with as many more in front and behind as make ``least``, if they are
    similar then: an edit near an end of a passage leaves the tokens there without a match."""
    more = max(0, least - (b - a + 1), least - (d - c + 1))
    for front in range(more + 1):
        e, f, g, h = a - front, b + more - front, c - front, d + more - front
        if min(e, g) >= 0 and f < len(x.hashes) and h < len(y.hashes) and _alike(x, y, own, e, f, g, h):
            return e, f, g, h
    return None


def matched_passages(x: Tokens, y: Tokens) -> list[tuple[int, int, int, int]]:
    """(start, end, start, end) in words of passages of x and of y that are near-equal."""
    least, out = LEAST_WORDS - SHINGLE + 1, []
    floor = SIMILARITY * least  # tokens that a passage of the least length shares
    if min(len(x.hashes), len(y.hashes)) < least:
        return out
    own = y.numbered(x.hashes)
    shared = np.flatnonzero(own < len(y.distinct))

    def runs(where: np.ndarray, gap: int) -> list[tuple[int, int]]:
        """First and last of each run of ``floor`` places or more."""
        if len(where) < floor:
            return []
        cut = (where[1:] - where[:-1] > gap + 1).nonzero()[0]
        ends = zip([int(where[0]), *where[cut + 1].tolist()], [*where[cut].tolist(), int(where[-1])], strict=True)
        return [(a, b) for a, b in ends if b - a + 1 >= floor]

    def search(where: np.ndarray, level: int) -> None:
        for a, b in runs(where, GAPS[level]):
            held = np.zeros(len(y.distinct) + 1, dtype=bool)
            held[own[a : b + 1]] = True
            for c, d in runs(held[y.numbers].nonzero()[0], GAPS[0]):
                if found := _grown(x, y, own, a, b, c, d, least):
                    out.append((found[0], found[1] + SHINGLE, found[2], found[3] + SHINGLE))
                    break
            else:
                if level + 1 < len(GAPS):
                    search(where[slice(*np.searchsorted(where, [a, b + 1]))], level + 1)

    search(shared, 0)
    return out


def batched(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Texts in parts of about PART_CHARS, one long text alone."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t or "") > PART_CHARS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def _refined(state: DataFrame, texts: DataFrame) -> DataFrame:
    """``state`` (key, id, spot, looks) with refined keys; texts of its documents are read once more. Tokens that no
    other of these documents has around its places are told first: an edited passage has too many of them to be like
    any. Places that look have stretches of their own, so no other place stands for them."""

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hashed = (h for part in batched(b.text) for h in token_hashes(part))
            rows = [(i, looks, *x) for i, looks, h, spots in zip(b.id.tolist(), b.looks.tolist(), hashed, b.spots.tolist(), strict=True) for x in stretches(h, np.array(spots, dtype=np.int64))]
            yield pd.DataFrame([(i, looks, spot, h.view(np.int64)) for i, looks, spot, h in rows], columns=["id", "looks", "spot", "tokens"])

    def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, dtype=np.int64)
        for b in batches:
            # A token that one document has alone is in no other's stretch.
            alone = np.concatenate([none, *(x for x in b.alone if x is not None)]).astype(np.int64).view(np.uint64)
            keys = stretch_keys([np.asarray(h).view(np.uint64) for h in b.tokens], alone)
            times = [len(k) for k in keys]
            made = {c: np.repeat(b[c].to_numpy(), times) for c in ("id", "spot", "looks")}
            yield pd.DataFrame({"key": np.concatenate([none, *(k.view(np.int64) for k in keys)]), **made})

    # What is gathered by id is a part of the document's own places and tokens.
    held = state.groupBy("id", "looks").agg(F.collect_set("spot").alias("spots"))
    some = maybe_in(texts, "id", key_filter(state.select("id"), "id"))
    parts = stored(held.join(some, "id").mapInPandas(around, "id long, looks boolean, spot long, tokens array<long>"))
    tokens = parts.select("id", F.explode("tokens").alias("h")).groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("high"))
    alone = tokens.where("id = high").groupBy("id").agg(F.collect_list("h").alias("alone"))
    return parts.join(alone, "id", "left").mapInPandas(refine, "key long, id long, spot long, looks boolean")


def _shared(keyed: DataFrame, looked: bool = True) -> DataFrame:
    """The rows of ``keyed`` (key, id, spot, and looks for ``looked``) whose key another document has too and, if ``looked``, where one
    looks, and the least identifier there (low)."""
    key = W.partitionBy("key")
    met = keyed.withColumns({"low": F.min("id").over(key), "high": F.max("id").over(key)})
    if not looked:
        return met.where("low <> high").drop("high")
    return met.withColumn("any", F.max("looks").over(key)).where("low <> high and any").drop("high", "any")


def _looking(left: DataFrame, found: DataFrame) -> DataFrame:
    """``left`` (key, id, spot) and whether the place is in none of the ``found`` occurrences (looks)."""
    own = found.select("id", "start_word", "end_word").union(found.select("rep", "rep_start", "rep_end")).distinct()
    own = own.withColumnRenamed("id", "_id")
    left = left.withColumn("place", F.shiftright("spot", 32))
    inside = (F.col("id") == F.col("_id")) & (F.col("place") >= F.col("start_word")) & (F.col("place") < F.col("end_word"))
    parts = [left.join(own, inside, how).withColumn("looks", F.lit(how == "left_anti")) for how in ("left_anti", "left_semi")]
    return parts[0].union(parts[1]).drop("place")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of LEAST_WORDS words and more that repeat, nearly or exactly, in another document.

    One row for each occurrence: doc_id, start_word, end_word (exclusive; words are split at white space),
    rep_id, rep_start, rep_end and is_rep. An occurrence is given with the matched passage of a representative: the
    smallest doc_id of those that share a key, or the next smallest that shares the passage where that one doesn't.
    The representative's own occurrence has is_rep true. Repeats inside one document are not reported. Identifiers
    must be unique; rows without one, and null or short texts, have no passages. Very long texts are read whole, one
    at a time. Other columns are not read.
    """
    ready_workers(docs.sparkSession)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [k for part in batched(b.text) for k in passage_keys(part)]
            rows = [(i, k, s) for i, (k, s) in zip(b.id.tolist(), made, strict=True) if len(k)]
            yield pd.DataFrame(rows, columns=["id", "keys", "spots"])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    made = texts.mapInPandas(keys, "id long, keys array<long>, spots array<long>")
    keyed = made.select("id", F.explode(F.arrays_zip("keys", "spots")).alias("k")).select(F.col("k.keys").alias("key"), "id", F.col("k.spots").alias("spot"))
    keyed = keyed.withColumn("spot", F.shiftleft(F.shiftright("spot", 32), 32))  # the place is enough, and packs better
    bounds = ["start_word", "end_word", "rep_start", "rep_end"]
    place = F.shiftright("spot", 32)
    state = stored(_shared(keyed, looked=False))
    compared = found = None
    reps, refined = 1, False
    while True:
        if reps == 1:
            met = state.where("id > low").select("key", "id", "spot", F.col("low").alias("rep"))
            pairs = met.select("rep", "id").distinct()
        else:
            # Of two places one has to look; a row has the representatives that it meets, so a pair is made once.
            ranked = state.withColumn("rank", F.dense_rank().over(W.partitionBy("key").orderBy("id")))
            firsts = ranked.where(F.col("rank") <= reps).groupBy("key").agg(F.collect_set("id").alias("reps"), F.collect_set(F.when(F.col("looks"), F.col("id"))).alias("looking"))
            met = ranked.join(firsts, "key").withColumn("reps", F.filter(F.when(F.col("looks"), F.col("reps")).otherwise(F.col("looking")), lambda r: r < F.col("id")))
            met = stored(met.select("key", "id", "spot", "rank", "reps"))
            pairs = met.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("reps"))).alias("reps")).select(F.explode("reps").alias("rep"), "id")
        new = stored(pairs if compared is None else pairs.join(compared, ["rep", "id"], "left_anti"))
        some = stored(verified_pairs(new, texts, Tokens, matched_passages, bounds, tokens_of))
        every = some if found is None else found.union(some)
        # Done at a key: its representatives, and texts that share a passage there with one of them.
        if reps == 1:
            # A row of the pair's passages meets all its keys; a key has one representative, so it is told there.
            held = every.groupBy("rep", "id").agg(F.collect_list(F.struct(*bounds)).alias("here"))
            told = met.join(held, ["rep", "id"], "left").withColumn("here", F.filter("here", lambda p: (place >= p["start_word"]) & (place < p["end_word"])))
            told = told if found is None else stored(told)
            covered = told.select("rep", "id", F.explode("here").alias("p")).select("rep", "id", "p.*")
            told = told.withColumn("done", F.max(F.coalesce(F.size("here"), F.lit(0)) > 0).over(W.partitionBy("rep", "id", "key")))
            left = told.where("not done").select("key", "id", "spot")
        else:
            here = (place >= F.col("start_word")) & (place < F.col("end_word")) & F.array_contains("reps", F.col("rep"))
            covered = stored(met.where(F.size("reps") > 0).join(every, "id").where(here).select("key", "rep", "id", *bounds).distinct())
            left = met.where(F.col("rank") > reps).join(covered, ["key", "id"], "left_anti").select("key", "id", "spot")
        # After the first round only passages around the places that were left are new.
        found = some if found is None else stored(found.union(covered.select(*some.columns)).distinct())
        compared = new if compared is None else compared.union(new)
        # Refined keys bring places of other keys together, so until then none is left out.
        left = stored(_shared(_looking(stored(left), found), looked=refined))
        if left.isEmpty():
            break
        if refined:
            reps *= RANKS
        else:
            left, refined = stored(_shared(_refined(left, texts))), True
        state = left
    own = found.select("rep", F.col("rep").alias("id"), F.col("rep_start").alias("start_word"), F.col("rep_end").alias("end_word"), "rep_start", "rep_end").distinct()
    both = found.withColumn("is_rep", F.lit(False)).unionByName(own.withColumn("is_rep", F.lit(True)))
    return both.select(F.col("id").alias("doc_id"), "start_word", "end_word", F.col("rep").alias("rep_id"), "rep_start", "rep_end", "is_rep")
