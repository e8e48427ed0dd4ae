"""Toxicity, quality and language models: held-out accuracy, pieces against plain versions, edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
EDGES = [(9000, None), (9001, ""), (9002, " \n"), (9003, "123 !!"), (9004, "Word " * 40_000), (9004, "again"), (None, "no id")]


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(12)
    syllables = {"aa": ["the", "ing", "on", "er"], "bb": ["schö", "ung", "ein", "ver"], "cc": ["ció", "ñar", "os", "el"]}
    docs, labels = [], []
    for i in range(900):
        lang = rng.choice(list(syllables))
        ws = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8, 120))]
        toxic, good = int(rng.random() < 0.25), int(rng.random() < 0.7)
        if toxic:
            for _ in range(3):
                ws[rng.randrange(len(ws))] = rng.choice(["blargon", "zorkface", "vexite", "vexora"])
        if not good:
            ws = [w + rng.choice(["###", "$$$"]) for w in ws] if i % 2 else [w.upper() + "!!" for w in ws]
        docs.append((i, " ".join(ws), lang, "s", 0))
        labels.append((i, good, toxic))
    docs += [(i, t, None, None, None) for i, t in EDGES]
    labels += [(9000, 1, None), (None, 0, 1), (0, labels[0][1], labels[0][2]), (12345, 1, 1)]
    return spark.createDataFrame(docs, DOCS).withColumn("label", F.lit("clash")).cache(), spark.createDataFrame(labels, LABELS).cache()


def check_scores(got, corpus, label, m, remainder):
    docs, labels = corpus
    assert len(got) == docs.count()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth and r.doc_id < 900]
    assert np.mean([a == b for a, b in held]) > 0.95 and len(held) > 100
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and fold(r.doc_id, m) == remainder)


def test_toxicity(spark, corpus):
    model = toxicity.train(*corpus)
    assert "w:blargon" in model.lexicon or any(k.startswith("p:blar") for k in model.lexicon)
    check_scores(toxicity.score(corpus[0], model).collect(), corpus, "toxic", 5, 0)


def test_toxicity_learns_nothing_from_held_out_rows(spark, corpus):
    docs, labels = corpus
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(str, toxicity.score(docs, toxicity.train(docs, x)).collect())) for x in (labels, flipped))
    assert a == b


def test_quality(spark, corpus):
    check_scores(quality.score(corpus[0], quality.train(*corpus)).collect(), corpus, "quality", 3, 1)


def test_models_without_labels(spark, corpus):
    docs, labels = corpus
    for module in (toxicity, quality):
        got = module.score(docs, module.train(docs, labels.limit(0))).collect()
        assert len({round(r.score, 9) for r in got}) == 1
        assert module.score(docs.limit(0), module.train(docs.limit(0), labels)).count() == 0


def test_language(spark, corpus):
    got = language.language(corpus[0]).collect()
    truth = {r.doc_id: r.lang for r in corpus[0].collect()}
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id < 900]
    assert np.mean(held) > 0.95 and len(held) > 100
    by = {r.doc_id: r for r in got if r.doc_id != 9004}
    for i in (9000, 9001, 9002, 9003):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert len(got) == corpus[0].count() and all(0 <= r.score <= 1 for r in got)
    nobody = corpus[0].withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.language(nobody).collect()} == {"und"}
    assert language.language(corpus[0].limit(0)).count() == 0


def test_network_lookups_equal_a_plain_convolution():
    rng = np.random.default_rng(0)
    net = language.fit(rng.integers(0, 256, (6, language.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1, 0, 1]), ["a", "b"])
    cut = language.windows(bytes(rng.integers(0, 256, 700).astype(np.uint8)))
    assert cut.shape == (3, language.WINDOW)
    for row, got in zip(cut, net.probabilities(cut, net.tables()), strict=True):
        hidden = []
        for f, w in zip(net.filters, language.WIDTHS, strict=True):
            hidden += [max(sum(f[o][row[p + o]][k] for o in range(w)) for p in range(language.WINDOW - w + 1)) for k in range(language.FILTERS)]
        logits = np.array(hidden) @ net.output + net.bias
        want = np.exp(logits - logits.max())
        assert np.allclose(got, want / want.sum(), atol=1e-4)


def test_isotonic_is_the_nearest_nondecreasing_function():
    rng = np.random.default_rng(3)
    for _ in range(20):
        y = rng.integers(0, 2, 12).astype(float)
        m = rng.normal(size=12)
        knots, values = toxicity.isotonic(m, y)
        fitted = np.interp(np.sort(m), knots, values)
        ordered = y[np.argsort(m)]
        minimax = [max(min(ordered[i : j + 1].mean() for j in range(k, 12)) for i in range(k + 1)) for k in range(12)]
        assert np.allclose(fitted, minimax)


def test_boosted_trees_separate_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = toxicity.Boosted(trees=80).fit(x[:1500], y[:1500])
    assert np.mean((model.margin(x[1500:]) > 0) == y[1500:]) > 0.9


def test_word_buckets_score_equals_the_mean_of_vectors():
    rng = np.random.default_rng(2)
    numbers = rng.normal(size=quality.BUCKETS).astype(np.float32)
    model = quality.QualityModel(numbers, 0.25)
    text = "one two two  three\nOne é😀 two two"
    ids, counts = quality.bag(text)
    want = 1 / (1 + np.exp(-(0.25 + (numbers[ids] * counts).sum() / counts.sum())))
    assert abs(model.score(text, quality.WordSums(numbers)) - want) < 1e-5
