"""Language identification by a byte convolutional network, trained in numpy on labelled text.

Filters of several widths read a window's bytes one-hot, so a filter is a table of one number for each place and
byte; the largest response of each filter in the window goes through a softmax. A text is cut into windows of a
fixed length, all of them are read, and the windows' probabilities are averaged by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, hashed_unit, ready_workers

#: Bytes of a window, filter widths, filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: Documents that are learned from, about (whole texts, gathered by the driver), and passes over their windows.
TRAIN_ROWS, EPOCHS, RATE = 2_000, 4, 0.25
#: Windows that are convolved at once.
CHUNK = 1024
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether any character is of a category L*; numerals such as ½ and Ⅷ aren't."""
    return any(map(str.isalpha, text))


def windows(raw: bytes) -> np.ndarray:
    """All windows of a text's bytes, the last one padded with zeros; one window at least."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class ByteNet:
    """filters[k]: (width, 256, FILTERS); output: (features, classes)."""

    classes: list
    filters: list
    output: np.ndarray
    bias: np.ndarray

    def tables(self) -> list[list[tuple[int, int, np.ndarray]]]:
        """For each width, lookups of one byte or of two at once: (place, bytes, table)."""
        out = []
        for f in self.filters:
            steps, place = [], 0
            while place < len(f):
                if place + 1 < len(f):
                    steps.append((place, 2, (f[place][:, None, :] + f[place + 1][None, :, :]).reshape(65536, -1)))
                    place += 2
                else:
                    steps.append((place, 1, f[place]))
                    place += 1
            out.append(steps)
        return out

    def probabilities(self, cut: np.ndarray, tables: list) -> np.ndarray:
        """Softmax of each window."""
        out = np.empty((len(cut), len(self.classes)))
        for at in range(0, len(cut), CHUNK):
            part = cut[at : at + CHUNK]
            pairs = part[:, :-1].astype(np.uint16) * 256 + part[:, 1:]
            pooled = []
            for width, steps in zip(WIDTHS, tables, strict=True):
                span = WINDOW - width + 1
                total = None
                for place, size, lookup in steps:
                    got = lookup.take((pairs if size == 2 else part)[:, place : place + span], axis=0)
                    total = got if total is None else np.add(total, got, out=total)
                pooled.append(total.max(axis=1))
            logits = np.concatenate(pooled, axis=1) @ self.output + self.bias
            logits -= logits.max(axis=1, keepdims=True)
            e = np.exp(logits)
            out[at : at + CHUNK] = e / e.sum(axis=1, keepdims=True)
        return out


def fit(cut: np.ndarray, y: np.ndarray, classes: list, seed: int = 7) -> ByteNet:
    """Stochastic gradient descent over windows in small batches; only each filter's best place learns."""
    rng = np.random.default_rng(seed)
    filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    output = rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
    bias = np.zeros(len(classes), dtype=np.float32)
    net = ByteNet(classes, filters, output, bias)
    if not len(y):
        return net
    lanes = np.arange(FILTERS)
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            x, places, pooled = cut[rows], [], []
            for f, w in zip(filters, WIDTHS, strict=True):
                total = sum(f[o].take(x[:, o : o + WINDOW - w + 1], axis=0) for o in range(w))
                best = total.argmax(axis=1)
                places.append(best)
                pooled.append(np.take_along_axis(total, best[:, None, :], axis=1)[:, 0])
            hidden = np.concatenate(pooled, axis=1)
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = p @ output.T
            output -= rate * (hidden.T @ p).astype(np.float32)
            bias -= rate * p.sum(axis=0).astype(np.float32)
            for k, (f, w) in enumerate(zip(filters, WIDTHS, strict=True)):
                step = (rate * back[:, k * FILTERS : (k + 1) * FILTERS]).astype(np.float32)
                for o in range(w):
                    np.subtract.at(f[o], (x[np.arange(len(rows))[:, None], places[k] + o], lanes[None, :]), step)
    return net


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> ByteNet:
    """Learn from text and non-null lang of documents whose crc32 fold (of 5) is not 0."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 5) != 0))
    total = known.select("lang").count()
    sample = known.where(hashed_unit(F.lit("lang"), F.col("doc_id").cast("string")) < min(1.0, train_rows / max(1, total)))
    rows = sample.select("doc_id", "lang", "text").toPandas().sort_values("doc_id", kind="stable")
    classes = sorted(rows.lang.unique().tolist())
    at = {c: i for i, c in enumerate(classes)}
    cuts = [(windows(t.encode("utf-8", "surrogatepass")), at[lang]) for lang, t in zip(rows.lang, rows.text, strict=True) if has_letter(t)]
    cut = np.concatenate([w for w, _ in cuts]) if cuts else np.zeros((0, WINDOW), dtype=np.uint8)
    return fit(cut, np.repeat([c for _, c in cuts], [len(w) for w, _ in cuts]).astype(np.int64), classes or [UNKNOWN])


def predict(docs: DataFrame, net: ByteNet) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row.

    A text that is null or has no letter (category L*) is ``und`` with score 0; long texts are read whole, in windows. Repeated identifiers are read each; held_out is
    false for a null identifier. Other columns are not read.
    """
    ready_workers(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = net.tables()
        for texts in batches:
            names, scores = [], []
            for text in texts:
                if text is None or not has_letter(text):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                raw = text.encode("utf-8", "surrogatepass")
                total = np.zeros(len(net.classes))
                for at in range(0, len(raw), WINDOW * CHUNK):  # a long text needs no more memory than a chunk
                    part = raw[at : at + WINDOW * CHUNK]
                    weight = np.full(-(-len(part) // WINDOW), float(WINDOW))
                    weight[-1] -= len(weight) * WINDOW - len(part)
                    total += weight @ net.probabilities(windows(part), tables)
                best = int(total.argmax())
                names.append(net.classes[best])
                scores.append(float(min(1.0, total[best] / len(raw))))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    rows = docs.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), read("text").alias("found"))
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score")


def language(docs: DataFrame) -> DataFrame:
    """Predict ``docs`` by a network learned from its own labelled rows."""
    return predict(docs, train(docs))
