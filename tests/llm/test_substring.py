"""Near-duplicate passages: hashes of a batch, plans of the rounds, places that look for a partner."""

import random

from test_search import frame, prose

from tidemark.llm import common, passages, simhash, substring_dedup


def test_words_of_a_batch_are_hashed_together():
    rng = random.Random(17)
    odd = [None, "", " ", "a b c d e", "\x00 a\x00 a\x00\x00 a b", "x" * 63 + " " + "x" * 64 + " " + "x" * 65 + " " + "y" * 200 + " z", "Ä b  c \ud800 d e f g", "\t\n\x0b\x0c\r\x1c A B C D E"]
    texts = odd + [" ".join(prose(rng, rng.randrange(60), 40)) for _ in range(40)]
    known = {}
    for t in texts:
        hashes, begins = substring_dedup.word_hashes((t or "").encode("utf-8", "surrogatepass").lower())
        for word, h in zip(simhash.words(t), hashes.tolist(), strict=True):
            assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)
    for t, h in zip(texts, substring_dedup.token_hashes(texts), strict=True):
        assert h.tolist() == substring_dedup.token_hashes([t])[0].tolist()
        runs = list(zip(*(simhash.words(t)[j:] for j in range(substring_dedup.SHINGLE)), strict=False))
        assert len(h) == len(runs) and len(set(h.tolist())) == len(set(runs))


def test_first_keys_are_shuffled_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(substring_dedup, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or common.stored(df))
    rng = random.Random(18)
    text = " ".join(prose(rng, 80, 10**6))
    assert substring_dedup.repeated_passages(frame(spark, [(i, text) for i in range(3)])).count() == 3
    assert "MapInPandas" in plans[0] and "key" in plans[0] and plans[0].count("Exchange hashpartitioning(key") == 1 and "Join" not in plans[0]


def test_places_in_found_passages_look_for_no_partner(spark, monkeypatch):
    """Texts share both ends with the least identifier; only a middle that is edited too much is left, and no pair of
    texts is compared again for keys at places that the ends hold."""
    rng = random.Random(19)
    front, middle, back = prose(rng, 90, 10**6), prose(rng, 60, 10**6), prose(rng, 90, 10**6)
    rows = []
    for i in range(48):
        own = [w if rng.random() > 0.07 else f"own{i}x{j}" for j, w in enumerate(middle)]
        rows.append((i, " ".join(front + own + back)))
    counts = []

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return passages.verified_pairs(pairs, *rest)

    monkeypatch.setattr(substring_dedup, "verified_pairs", counted)
    got = substring_dedup.repeated_passages(frame(spark, rows)).collect()
    held = {}
    for r in got:
        held.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert all(set(range(90)) | set(range(150, 240)) <= held[i] for i, _ in rows)
    assert sum(counts[1:]) < 30  # 49 where all places look
