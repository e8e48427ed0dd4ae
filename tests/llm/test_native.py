"""Exact dedup, mixing, chat formatting and token counts on small fixtures."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, exact_dedup, mixing, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


ROWS = [
    (1, "a", "en", "s1", 1), (2, "a", "en", "s2", 1), (3, None, None, None, None), (4, "", "en", "s1", 0),
    (5, "b" * 300_000, "en", "s1", 1), (6, "b" * 300_000, "en", "s1", 1), (6, "b" * 300_000, "en", "s1", 1), (None, "a", "de", "s1", 1), (None, "z", "de", "s1", 1),
]


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda text: F.substring(F.sha2(text, 256), 1, 1), lambda text: F.lit("same")])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup_against_groups(spark, digest, keep):
    random.seed(3)
    rows = ROWS + [(i, random.choice("pqrstuv") * random.randint(0, 2), "en", "s", 0) for i in range(10, 90)]
    got = exact_dedup.exact_dedup(frame(spark, rows), keep=keep, digest=digest).collect()
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(text or "", []).append(i)
    pick = max if keep == "largest" else min
    want = []
    for ids in groups.values():
        best = pick((i for i in ids if i is not None), default=None)
        want += [(i, best, len(ids), i == best) for i in ids]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=key) == sorted(want, key=key)


def test_exact_dedup_digest_and_empty_table(spark):
    got = {r.doc_id: r.digest for r in exact_dedup.exact_dedup(frame(spark, ROWS[:4])).collect()}
    assert got[1] == hashlib.sha256(b"a").hexdigest() and got[3] == got[4] == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_ignores_clashing_columns(spark):
    docs = frame(spark, ROWS[:3]).withColumn("digest", F.lit("x")).withColumn("keep_id", F.lit(0)).withColumn("body", F.lit(1))
    assert exact_dedup.exact_dedup(docs).where("kept").count() == 2
    assert exact_dedup.keep_first_copies(docs).columns == docs.columns


def test_mixing_reaches_targets_and_repeats(spark):
    rows = [(i, "x" * (10 + i % 7), "en", "big" if i % 3 else "small", 0) for i in range(6000)]
    docs = frame(spark, rows)
    out = mixing.mix(docs, {"big": 1.0, "small": 3.0}).cache()
    mass = {r.source: r.m for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("m")).collect()}
    assert abs(mass["small"] / sum(mass.values()) - 0.75) < 0.02
    again = mixing.mix(docs.repartition(7), {"big": 1.0, "small": 3.0})
    assert sorted(r.shuffle_key for r in out.collect()) == sorted(r.shuffle_key for r in again.collect())
    assert out.groupBy("shuffle_key").count().where("count > 1").isEmpty()


def test_mixing_inverts_poisson(spark):
    """Counts equal a direct inversion of the distribution at the same hashed numbers."""
    import math

    rows = [(i, "abcd", "en", "a" if i % 10 else "b", 4) for i in range(500)]
    docs = frame(spark, rows)
    rates = {r.source: r.rate for r in mixing.source_rates(docs, {"a": 1.0, "b": 400.0}, 30.0).collect()}
    assert rates["b"] > 200  # drawn in parts
    got = {r.doc_id: r.n for r in mixing.mix(docs, {"a": 1.0, "b": 400.0}, 30.0).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}

    def invert(mean, u):
        k, p, c = 0, math.exp(-mean), math.exp(-mean)
        while c <= u and k < mean + 12 * math.sqrt(mean) + 20:
            k += 1
            p *= mean / k
            c += p
        return k

    for i, _, _, source, _ in rows:
        parts = max(1, math.ceil(rates[source] / mixing.PART_MEAN))
        us = [int(hashlib.md5(f"mix-1|draw|{p}|{i}".encode()).hexdigest()[:13], 16) / 2**52 for p in range(parts)]
        assert got.get(i, 0) == sum(invert(rates[source] / parts, u) for u in us)


def test_mixing_edges(spark, monkeypatch):
    assert mixing.mix(frame(spark, [])).count() == 0
    docs = frame(spark, ROWS).withColumn("copy", F.lit("mine")).withColumn("rate", F.lit(1))
    out = mixing.mix(docs, epochs=2.0)
    assert out.where("text is null").count() == 0  # its source has no character
    before = sorted(r.shuffle_key for r in out.collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(r.shuffle_key for r in mixing.mix(docs, epochs=2.0).collect()) == before
    assert mixing.mix(docs, {"none": 1.0}).count() == 0


CONV = "conv_id long, turn long, role string, text string, perspective string"


def plain(rows):
    """The rendering written as loops."""
    convs, out = {}, {}
    for c, turn, role, text, _ in rows:
        convs.setdefault(c, []).append((-(10**9) if turn is None else turn, role or "unknown", text or ""))
    for c, turns in convs.items():
        turns.sort()
        for who in {r for _, r, _ in turns} - {"system"}:
            rendered, said = "", []
            for _, role, text in turns:
                rendered += "<|assistant|>" if role == who else "<|system|>" if role == "system" else f"<|user:{role}|>"
                if role == who:
                    said.append(text + "<|end|>")
                rendered += text + "<|end|>\n"
            out[c, who] = rendered, said
    return out


def test_chat_rotation_against_loops(spark):
    random.seed(5)
    rows = [(1, i, random.choice(["ann", "bob", "cy", "system", None]), random.choice(["hi", "", None, "é😀"]), "x") for i in range(200)]
    rows += [(2, 0, "system", "s", "x"), (3, 5, "ann", "once", "x"), (3, 5, "ann", "once", "x"), (None, None, "eve", "w", "x"), (4, 1000, "a'b", "y" * 200_000, "x"), (4, -3, "c", None, "x")]
    got = chat_format.rotate(spark.createDataFrame(rows, CONV)).orderBy("conv_id", "perspective", "segment").collect()
    whole, said = {}, {}
    for r in got:
        key = (r.conv_id, r.perspective)
        whole[key] = whole.get(key, "") + r.rendered
        chars = [ord(c) for c in r.rendered]
        said.setdefault(key, []).extend("".join(map(chr, chars[s.start : s.end])) for s in r.spans)
        assert r.n_turns <= chat_format.SEGMENT and r.n_loss_chars == sum(s.end - s.start for s in r.spans)
    want = plain(rows)
    assert whole == {k: v[0] for k, v in want.items()}
    assert said == {k: v[1] for k, v in want.items()}


def test_chat_empty(spark):
    assert chat_format.rotate(spark.createDataFrame([], CONV)).count() == 0


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    random.seed(2)
    path = token_counts.vocabulary_path()
    letters = "ab  tehñé<s>\n\t€😀中0x▁\x00"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(400)]
    texts += ["", " ", "   end  ", "<unk></s><0x0A>", "word " * 9000, "ab" * 20_000, " " * 3000]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, None, None, None, None), (7, "dup", None, None, None)]
    docs = frame(spark, rows).withColumn("n_tokens", F.lit("clash"))
    got = token_counts.token_counts(docs, path, limit=5).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 5) for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(frame(spark, []), path).count() == 0
