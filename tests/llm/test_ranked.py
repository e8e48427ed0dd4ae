"""Ranked search against scores of all documents, and block boundaries against all ways to cut."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import blockmax
from tidemark.functions.blockmax import best_documents
from tidemark.llm import ranked_search
from tidemark.llm.ranked_search import block_ends, postings, ranked_index, terms

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def plain(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, k=50):
    counted = [(i, Counter(plain(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(plain(t))
    out = []
    for item, some in asked.items():
        scores = []
        for i, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in some if c[t])
            scores += [(-s, i is None, i or 0)] if s > 0 else []
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items):
    index = ranked_index(spark.createDataFrame(docs, DOCS).repartition(3).withColumn("term", F.lit("x")).withColumn("shard", F.lit(1)))
    got = ranked_search.ranked_search(index, spark.createDataFrame(items, ITEMS).withColumn("rank", F.lit(9)))
    return sorted(map(tuple, got.collect()), key=str)


def sample(seed, n, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "é", "Über", "ÜBER", "K9", "k9", "x_y", "naïve"]
    return [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.choice([0, 1, 3, 10, 40, 200]))) for _ in range(n)]


@pytest.mark.parametrize("size", [20, 1 << 15])
def test_search_equals_all_scores(spark, monkeypatch, size):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", size)
    monkeypatch.setattr(blockmax, "FIRST_DOCS", 8)
    docs = [(i % 390, t) for i, t in enumerate(sample(1, 420))] + [(None, "w1 w2 w59"), (None, None), (900, ""), (901, "w1 w1"), (902, "w1 w1")]
    items = [(i, t) for i, t in enumerate(sample(2, 25))] + [(3, "w40 w41"), (None, "w5 É"), (77, None), (78, "absent")]
    assert found(spark, docs, items) == brute(docs, items)


def test_passes_of_items_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "PASS_WORDS", 4)
    monkeypatch.setattr(ranked_search, "SHARD_CHARS", 3000)
    docs = [(i, t) for i, t in enumerate(sample(3, 150))] + [(500, "w3 " * 30_000 + "w7"), (501, "w7" * 40_000)]
    items = [(i, t[:60]) for i, t in enumerate(sample(4, 9))]
    assert found(spark, docs, items) == brute(docs, items)


def test_copies_tie_by_identifier(spark):
    docs = [(i, "same words here") for i in range(300, 0, -1)] + [(400, "other")]
    got = found(spark, docs, [(1, "words"), (2, "other")])
    assert [r[2] for r in sorted(got) if r[0] == 1] == list(range(1, 51)) and got == brute(docs, [(1, "words"), (2, "other")])


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a b")], []) == []
    assert found(spark, [(1, ""), (2, None)], [(1, "a")]) == []


def test_terms_lower_only_ascii():
    assert terms("Ab_É-ÜBER\x7fK9") == [w.encode() for w in plain("Ab_É-ÜBER\x7fK9")] == [b"ab", "É".encode(), "Ü".encode() + b"ber", b"k9"]


def test_blocks_have_the_least_cost(monkeypatch):
    monkeypatch.setattr(ranked_search, "MOST_BLOCK", 4)
    monkeypatch.setattr(ranked_search, "BLOCK_COST", 200)
    monkeypatch.setattr(ranked_search, "TOGETHER", 3)
    rng = np.random.default_rng(1)
    sizes = np.array([1, 2, 9, 10, 5, 7, 8, 1])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    values = rng.integers(0, 100, sizes.sum())
    docs = np.concatenate([np.sort(rng.choice(30, n, replace=False)) for n in sizes])
    ends = block_ends(values, docs, starts, sizes)

    def cost(x, d, cuts):
        return sum(200 + (d[b - 1] - d[a] + 1) * x[a:b].max() for a, b in zip([0, *cuts], [*cuts, len(x)], strict=True))

    for s, n in zip(starts, sizes, strict=True):
        x, d, mine = values[s : s + n], docs[s : s + n], ends[s : s + n]
        assert mine[-1]
        ways = [[i + 1 for i in range(n - 1) if bits >> i & 1] for bits in range(1 << (n - 1))]
        least = min(cost(x, d, c) for c in ways if max(np.diff([0, *c, n])) <= 4)
        assert cost(x, d, (np.flatnonzero(mine[:-1]) + 1).tolist()) == least


def test_blocks_are_skipped():
    rng = np.random.default_rng(2)
    n, lists, total = 20_000, [], np.zeros(20_000, dtype=np.int64)
    for weight, share in ((50, 0.6), (900, 0.02), (2000, 0.002)):
        docs = np.flatnonzero(rng.random(n) < share)
        values = rng.integers(200_000, 300_000, len(docs)) + 400_000 * (docs // 1000 % 10 == 3)  # good documents lie together
        cuts = np.arange(0, len(docs), 1024)
        ends = np.flatnonzero(block_ends(values, docs, cuts, np.minimum(1024, len(docs) - cuts)))
        tops = np.maximum.reduceat(values, np.r_[0, ends[:-1] + 1])
        lists.append((weight, postings(docs.astype(np.uint32).tobytes(), values.astype(np.int32).tobytes(), ends.astype(np.uint32).tobytes(), tops.astype(np.int32).tobytes())))
        total[docs] += weight * values
    docs, scores, read = best_documents(lists, n, 50, 1)
    want = np.lexsort((np.arange(n), -total))[:50]
    assert docs.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    assert read < 0.5 * sum(len(p.docs) for _, p in lists)
