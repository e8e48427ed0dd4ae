"""Toxicity: gradient-boosted trees over dense features of a whole text, with isotonic calibration.

The lexicon is learned: terms (words, and word beginnings of 4 and 5 letters) that labelled toxic documents hold
far oftener than others. It is learned on one half of the labelled rows and the trees on the other half, so a
term's density means the same in training as later. Training takes a bounded sample of labelled rows; scores use
the text alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, hashed_unit, labelled_sample, ready_workers, table

#: Labelled rows that are learned from, about; terms in the lexicon, at most.
TRAIN_ROWS, LEXICON_TERMS = 12_000, 600
#: A term enters the lexicon from this signed G statistic on (25 is p < 1e-6).
LEAST_G = 25.0
#: Words that a worker remembers; the table is emptied when it is full.
MEMO_ENTRIES = 300_000
#: Words between a lexicon hit and a second-person word that still count as close.
NEAR = 5
#: Second-person words of the four languages, and stand-ins for letters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner euch euer ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros vuestro".split())
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})

WORD_HIT, PREFIX_HIT, DISGUISED, SECOND, CAPS, ODD = 1, 2, 4, 8, 16, 32
_words = re.compile(r"[\w@$*!.\-]*[\w@$*]").findall
_odd = re.compile(r"[^\W\d_][\d@$*!.\-_]+[^\W\d_]").search
FEATURES = 19


class WordCodes(dict):
    """Maps a word as written to (flags, weight); fills itself."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str):
        flags, weight, low = 0, 0.0, word.lower()
        if (w := self.lexicon.get("w:" + low)) is not None:
            flags, weight = WORD_HIT, w
        else:
            w = max(self.lexicon.get("p:" + low[:4], 0.0), self.lexicon.get("p:" + low[:5], 0.0) if len(low) > 4 else 0.0)
            if w:
                flags, weight = PREFIX_HIT, w
        if low in SECOND_PERSON:
            flags |= SECOND
        if len(word) > 1 and word.isupper():
            flags |= CAPS
        if _odd(word):
            flags |= ODD
            if not weight and (w := self.lexicon.get("w:" + low.translate(STAND_INS))) is not None:
                flags, weight = flags | DISGUISED, w
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        if len(word) < 64:
            self[word] = (flags, weight)
        return flags, weight


def features(text: str | None, codes: WordCodes) -> np.ndarray:
    """The dense features of one whole text."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    words = _words(text)
    n = max(1, len(words))
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if words:
        coded = list(map(codes.__getitem__, words))
        flags = np.fromiter((f for f, _ in coded), dtype=np.int16, count=len(words))
        kinds = np.bincount(flags, minlength=64)
        total = lambda bit: float(kinds[(np.arange(len(kinds)) & bit) > 0].sum())
        hits = np.flatnonzero(flags & (WORD_HIT | PREFIX_HIT | DISGUISED))
        you = np.flatnonzero(flags & SECOND)
        weights = [coded[i][1] for i in hits]
        out[1:6] = total(WORD_HIT) / n, np.log1p(total(WORD_HIT)), total(PREFIX_HIT) / n, np.log1p(total(PREFIX_HIT)), len({words[i] for i in hits})
        out[6:9] = sum(weights) / n, max(weights, default=0.0), sum(weights)
        out[9], out[10], out[11] = total(DISGUISED), 50.0, total(SECOND) / n
        if len(hits) and len(you):
            at = np.searchsorted(you, hits)
            gap = np.minimum(np.abs(hits - you[np.minimum(at, len(you) - 1)]), np.abs(hits - you[np.maximum(at - 1, 0)]))
            out[10], out[12] = min(50, gap.min()), float((gap <= NEAR).mean())
        out[13], out[14] = total(CAPS) / n, total(ODD) / n
    size = len(raw)
    out[0] = np.log1p(len(words))
    out[15] = np.count_nonzero((raw >= 65) & (raw <= 90)) / size
    out[16] = np.count_nonzero((raw >= 33) & (raw <= 47)) / size
    out[17] = np.count_nonzero(raw == 33) / size
    out[18] = np.count_nonzero((raw >= 48) & (raw <= 57)) / size
    return out


@dataclass
class Boosted:
    """Trees of a fixed depth over binned features, fitted to the logistic loss by Newton steps."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    ridge: float = 1.0
    base: float = 0.0
    edges: list = field(default_factory=list)
    splits: list = field(default_factory=list)
    leaves: list = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        prior = (y.sum() + 0.5) / (len(y) + 1.0)
        self.base = float(np.log(prior / (1 - prior)))
        if not len(y) or y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned, width, margin = self._binned(x), self.bins + 1, np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node, feature, cut = np.zeros(len(y), dtype=np.int64), np.zeros(2**self.depth - 1, dtype=np.int64), np.full(2**self.depth - 1, width, dtype=np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                best = np.full(count, 1e-6)
                for j in range(x.shape[1]):
                    slot = (node - first) * width + binned[:, j]
                    gs = np.bincount(slot, g, count * width).reshape(count, width).cumsum(1)
                    hs = np.bincount(slot, h, count * width).reshape(count, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    k = gain.argmax(1)
                    top = gain[np.arange(count), k]
                    new = top > best
                    best[new] = top[new]
                    feature[first : first + count][new], cut[first : first + count][new] = j, k[new]
                node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = -self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.ridge)
            margin += value[leaf]
            self.splits.append((feature, cut))
            self.leaves.append(value)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not self.splits or not len(x):
            return out
        binned, rows = self._binned(x), np.arange(len(x))
        for (feature, cut), value in zip(self.splits, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and values of the nondecreasing step function nearest to y."""
    order = np.argsort(margins, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first margin, last margin
    for m, v in zip(margins[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(m), float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + c, blocks[-1][2], last]
    knots = [m for b in blocks for m in (b[2], b[3])]
    values = [b[0] / b[1] for b in blocks for _ in (0, 1)]
    return np.array(knots), np.array(values)


@dataclass
class ToxicityModel:
    lexicon: dict
    trees: Boosted
    knots: np.ndarray
    values: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; a thousandth of the uncalibrated one keeps their order inside a step."""
        margin = self.trees.margin(x)
        plain = 1 / (1 + np.exp(-margin))
        level = np.interp(margin, self.knots, self.values) if len(self.knots) else plain
        return np.clip(0.999 * level + 0.001 * plain, 0.0, 1.0)


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms of (doc_id, text, label) rows and their log-odds; counted by Spark over whole texts."""
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("t")).first()
    n, t = totals["n"], totals["t"]
    if not 0 < t < n:
        return {}
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0)))
    whole = F.transform("words", lambda w: F.concat(F.lit("w:"), w))
    starts = lambda k: F.transform(F.filter("words", lambda w: F.length(w) >= k), lambda w: F.concat(F.lit("p:"), F.substring(w, 1, k)))
    terms = sample.select("label", words.alias("words")).select("label", F.explode(F.array_distinct(F.concat(whole, starts(4), starts(5)))).alias("term"))
    counted = terms.groupBy("term").agg(F.sum("label").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("df"))
    share = t / n
    part = lambda seen, want: F.when(seen > 0, seen * F.ln(seen / want)).otherwise(0.0)
    g = 2 * (part(F.col("a"), F.col("df") * share) + part(F.col("df") - F.col("a"), F.col("df") * (1 - share)))
    odds = F.ln(((F.col("a") + 0.5) / (t + 1.0)) / ((F.col("df") - F.col("a") + 0.5) / (n - t + 1.0)))
    kept = counted.where(F.col("a") > F.col("df") * share).withColumn("g", g).withColumn("odds", odds).where((F.col("g") >= LEAST_G) & (F.col("odds") > 1.5))
    found = kept.orderBy(F.desc("g"), "term").limit(LEXICON_TERMS).collect()
    words = [(r.term[2:], r.df) for r in found if r.term.startswith("w:")]
    # A beginning that one word accounts for says no more than the word, and would match harmless others.
    alone = lambda r: r.term.startswith("p:") and any(w.startswith(r.term[2:]) and df >= 0.8 * r.df for w, df in words)
    return {r.term: r.odds for r in found if not alone(r)}


def _featured(rows: DataFrame, lexicon: dict) -> DataFrame:
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = WordCodes(lexicon)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "label": b.label, "x": [features(t, codes).tolist() for t in b.text]})

    return rows.select("doc_id", "text", "label").mapInPandas(make, "doc_id long, label int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn from labelled documents whose crc32 fold (of 5) is not 0; a null or unlabelled row teaches nothing."""
    ready_workers(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", train_rows, fold("doc_id", 5) != 0)
    first = hashed_unit(F.lit("half"), F.col("doc_id").cast("string")) < 0.5
    lexicon = learn_lexicon(sample.where(first))
    got = _featured(sample.where(~first), lexicon).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got.x.tolist(), dtype=float).reshape(len(got), FEATURES)
    y = got.label.to_numpy(dtype=float)
    part = np.arange(len(y)) % 3
    out_of_fold = np.zeros(len(y))
    for k in range(3):
        out_of_fold[part == k] = Boosted().fit(x[part != k], y[part != k]).margin(x[part == k])
    trees = Boosted().fit(x, y)
    knots, values = isotonic(out_of_fold, y) if 0 < y.sum() < len(y) else (np.zeros(0), np.zeros(0))
    return ToxicityModel(lexicon, trees, knots, values)


def _scorer(model: ToxicityModel):
    """A pandas UDF from text to score."""

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codes = WordCodes(model.lexicon)
        for texts in batches:
            yield pd.Series(model.scores(np.array([features(t, codes) for t in texts]).reshape(len(texts), FEATURES)))

    return toxic


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; null texts are scored as empty, long ones whole.

    Repeated identifiers are scored each; held_out is false for a null identifier. Other columns are not read.
    """
    ready_workers(docs.sparkSession)
    scored = docs.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), _scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Score ``docs`` by a model learned from the tables documents and labels under ``sf_dir``."""
    return score(docs, train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic, with the columns of ``docs``."""
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    ready_workers(spark)
    return docs.where(_scorer(model)("text") < 0.5)
