"""SimHash groups, wide-fingerprint duplicates, components, passages and decontamination against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import components, decontamination, passages, simhash, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


def prose(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def least_reachable(nodes, linked):
    """Union by repeated passes, written without the library."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components_against_loops(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [x for x in links if x[0] is not None]
    assert got == least_reachable({n for x in real for n in x}, real)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    found = [w.encode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    runs = [b" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([b" ".join(found)] if found else [])
    hashes = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_against_all_pairs(spark):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        base = prose(rng, rng.choice([1, 2, 3, 40, 200, 400]))
        rows.append((i * 10, " ".join(base)))
        for k in range(rng.randrange(4)):
            edited = list(base)
            edited[rng.randrange(len(edited))] = "É"
            rows.append((i * 10 + 1 + k, " ".join(edited)))
    rows += [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "Ab aB"), (9005, "ab AB"), (9006, "x y " * 40_000), (9006, "x y " * 40_000), (None, "ab ab")]
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    distinct = {f for _, f in prints}
    linked = [(a, b) for a in distinct for b in distinct if a < b and bin(a ^ b).count("1") <= 2]
    label = least_reachable(distinct, linked)
    least = {}
    for i, f in prints:
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    docs = frame(spark, rows).withColumn("fp", F.lit("clash")).withColumn("component", F.lit(1))
    got = simhash.near_groups(docs).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted([(i, f"{f:016x}", least[label[f]]) for i, f in prints], key=key)
    assert len(linked) > 5
    assert simhash.near_groups(frame(spark, [])).count() == 0


def test_hamming_links_join_every_near_pair(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        for _ in range(6):
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                f ^= 1 << b
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.hamming_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = least_reachable(signed, [(r.a, r.b) for r in links.collect()])
    want = least_reachable(signed, [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2])
    assert got == want


def shingle_set(text, n=5):
    ws = text.lower().split()
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        base = prose(rng, 150, 3000)
        rows.append((i * 10, " ".join(base)))
        for k in range(3):
            edited = list(base)
            for _ in range(rng.randrange(1, 7)):
                edited[rng.randrange(150)] = f"e{rng.randrange(9999)}"
            rows.append((i * 10 + 1 + k, " ".join(edited)))
    rows += [(9001, None), (9002, " "), (9003, "one two"), (9004, "ONE two"), (None, "one two")]
    sets = {i: shingle_set(t) for i, t in rows if t and t.strip() and i is not None}
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = least_reachable({n for x in alike for n in x}, alike)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert set(got) <= set(want)  # nothing that is not similar
    assert sum(got.get(n) == c for n, c in want.items()) >= 0.9 * len(want)
    stay = simhash.one_of_each_group(frame(spark, rows))
    assert stay.columns == frame(spark, []).columns and stay.where("doc_id = 9002 or doc_id = 9001").count() == 2
    assert simhash.one_of_each_group(frame(spark, [])).count() == 0


def test_near_duplicates_of_short_texts_lose_no_pair(spark):
    rng = random.Random(8)
    rows = []
    for group in range(60):
        base = [f"g{group}w{i}" for i in range(rng.randint(1, 14))]
        rows.append(" ".join(base))
        for _ in range(4):
            some = list(base)
            edit = rng.choice(["add", "cut", "swap", "case"])
            some = some + ["more"] if edit == "add" else some[1:] if edit == "cut" else some[:-1] + ["other"] if edit == "swap" else [w.upper() for w in some]
            rows.append("  ".join(some))
    rows = [(i, t) for i, t in enumerate(rows) if t]
    sets = {i: set(simhash.shingle_hashes(simhash.words(t), 5).tolist()) for i, t in rows}
    label = {i: i for i, _ in rows}
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            la, lb = sorted((label[a], label[b]))
            label = {k: la if v == lb else v for k, v in label.items()}
    want = {i: c for i, c in label.items() if list(label.values()).count(c) > 1}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    short = {i for i in want if min(len(sets[j]) for j in want if want[j] == want[i]) <= simhash.SHORT}
    assert len(short) > 50 and {i: got.get(i) for i in short} == {i: want[i] for i in short}
    assert len(set(want.items()) & set(got.items())) >= 0.95 * len(want) and set(got) <= set(want)


def test_near_duplicates_of_appended_cut_and_replaced_texts(spark):
    rng = random.Random(31)
    rows, want = [], set()
    for i in range(240):
        base = prose(rng, 200, 10**6)
        extra = rng.randrange(36, 48)
        other = [
            base + prose(rng, extra, 10**6),
            base[: 200 - rng.randrange(30, 38)],
            base[:90] + prose(rng, rng.randrange(10, 17), 10**6) + base[106:],
        ][i % 3]
        texts = [" ".join(base), " ".join(other)]
        x, y = map(shingle_set, texts)
        assert 0.79 < len(x & y) / len(x | y) < 0.9
        if len(x & y) / len(x | y) >= 0.8:
            want |= {i * 2, i * 2 + 1}
        rows += [(i * 2 + k, t) for k, t in enumerate(texts)]
    got = {r.doc_id for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got <= want and len(want) > 300
    assert len(got) >= 0.96 * len(want)


def test_near_duplicates_go_on_after_the_least_id_fails(spark):
    rng = random.Random(12)
    rows = []
    for i in range(30):  # a template: the least ids are under 0.8 to all others, the last two are alike
        base = prose(rng, 200, 10**6)
        fill = lambda n: " ".join(base[:100] + prose(rng, n, 10**6) + base[100 + n :])  # noqa: E731,B023
        rows += [(i * 10 + k, fill(24)) for k in range(4)]
        full = fill(24)
        rows += [(i * 10 + 8, full), (i * 10 + 9, full + " " + " ".join(prose(rng, 4, 10**6)))]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i * 10 + k: i * 10 + 8 for i in range(30) for k in (8, 9)}


def test_near_misses_of_one_text_are_not_all_paired(spark, monkeypatch):
    """Copies edited too much to be like one another: their counts of shared shingles tell, without a pair each."""
    rng = random.Random(77)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for k in range(60):
        text = list(base)
        for at in rng.sample(range(5, 290, 10), 8):  # 40 of 296 shingles are its own: similarity 0.79 at most
            text[at] = f"own{k}x{at}"
        rows.append((k, " ".join(text)))
    like = rows[7][1].split()
    like[2] = "edited"
    rows.append((100, " ".join(like)))
    made = []

    def counted(pairs, *rest):
        made.append(pairs.count())
        return passages.verified_pairs(pairs, *rest)

    monkeypatch.setattr(simhash, "verified_pairs", counted)
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(7, 7), (100, 7)}
    assert sum(made) < 200  # of 1830


def test_rounds_of_bucket_pairs_end_with_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "POINTS", 64)
    ids, values = np.arange(30, dtype=np.int64), np.full(30, 7, dtype=np.uint64)
    labels = np.where(ids < 4, 0, ids)
    got, lo, hi = set(), 0, 1
    while True:
        rep, other, still = simhash.bucket_pairs(ids, values, labels, np.zeros((30, 4), dtype=np.uint32), np.ones(30, dtype=np.int32), 0, 0, lo, hi)
        got |= set(zip(rep.tolist(), other.tolist(), strict=True))
        if not len(still):
            break
        assert set(still.tolist()) == set(range(30))
        lo, hi = hi, hi * simhash.RANKS
    assert got == {(a, b) for b in range(30) for a in range(b) if labels[a] != labels[b]}


def test_bucket_pairs_against_all_pairs():
    rng = np.random.default_rng(5)
    bases = rng.integers(0, 2**32, 40, dtype=np.uint64)
    values = np.repeat(bases, 5)
    for _ in range(3):
        values ^= np.where(rng.random(200) < 0.5, np.uint64(1) << rng.integers(0, 32, 200).astype(np.uint64), np.uint64(0))
    ids = rng.permutation(200).astype(np.int64)
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(200) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 2}
    for head_bits in (0, 2, 3):
        got = set()
        for head in range(1 << head_bits):
            near = np.bitwise_count((values >> np.uint64(32 - head_bits)) ^ np.uint64(head)) <= 1
            rep, other, still = simhash.bucket_pairs(ids[near], values[near], ids[near], np.zeros((near.sum(), 4), dtype=np.uint32), np.ones(near.sum(), dtype=np.int32), head, head_bits, 0, 10**3)
            assert not len(still)
            got |= set(zip(rep.tolist(), other.tolist(), strict=True))
        assert got == want


def test_verified_pairs_split_a_hot_representative(spark, monkeypatch):
    monkeypatch.setattr(passages, "CHUNK", 8)
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "id long, text string")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 100)], "rep long, id long")
    got = passages.verified_pairs(pairs, texts, lambda t: int(t[1:]), lambda x, y: [(x + y,)] * (x % 2), ["total"]).collect()
    assert sorted((r.rep, r.id, r.total) for r in got) == [(0, i, i) for i in range(1, 100, 2)]


@pytest.mark.parametrize("n,high", [(30, 50), (46, 5), (200, 10), (400, 10**6), (300, 1)])
def test_compact_windows_hold_every_run(n, high):
    rng = np.random.default_rng(n)
    for least in (1, 7, 46):
        values = rng.integers(0, high, n).astype(np.uint64)
        found = zip(*(x.tolist() for x in substring_dedup.compact_windows(values, least)), strict=True)
        owner = {}
        for lo, c, hi in found:
            for i in range(lo, c + 1):
                for j in range(max(c, i + least - 1), hi + 1):
                    assert (i, j) not in owner
                    owner[i, j] = c
        want = {(i, j): i + int(values[i : j + 1].argmin()) for i in range(n) for j in range(i + least - 1, n)}
        assert owner == want
        starts, low, _ = substring_dedup.signature_runs(values, least)
        if n >= least:
            runs = [low[np.searchsorted(starts, i, side="right") - 1] for i in range(n - least + 1)]
            assert runs == [values[i : i + least].min() for i in range(n - least + 1)]


def test_passage_keys_of_a_batch_equal_those_of_single_texts():
    rng = random.Random(2)
    texts = [None, "", *(" ".join(prose(rng, n)) for n in (10, 49, 50, 51, 300, 60)), "a " * 200]
    batch = substring_dedup.passage_keys(texts)
    alone = [substring_dedup.passage_keys([t])[0] for t in texts]
    assert [(k.tolist(), s.tolist()) for k, s in batch] == [(k.tolist(), s.tolist()) for k, s in alone]
    assert [len(k) > 0 for k, _ in batch] == [False, False, False, False, True, True, True, True, True]


def test_repeated_passages(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(prose(rng, 200, 10**6))) for i in range(60)]
    exact, near = prose(rng, 55, 10**6), prose(rng, 120, 10**6)
    put = lambda i, passage: (i, " ".join(prose(rng, 80, 10**6) + passage + prose(rng, 70, 10**6)))
    rows += [put(100 + i, exact) for i in range(6)]
    for i in range(12):
        edited = list(near)
        edited[rng.randrange(40, 80)] = f"edit{i}"
        rows.append(put(200 + i, edited))
    rows += [put(300 + i, prose(rng, 3, 10**6) + exact[:30]) for i in range(5)]  # too short to count
    rows += [(400, None), (401, ""), (402, "a " * 60_000), (403, "a " * 55), (None, " ".join(exact)), (404, rows[0][1])]
    got = substring_dedup.repeated_passages(frame(spark, rows)).collect()
    seen = {}
    text = {i: t.split() for i, t in rows if t and i is not None}
    for r in got:
        seen.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
        a, b = " ".join(text[r.doc_id][r.start_word : r.end_word]), " ".join(text[r.rep_id][r.rep_start : r.rep_end])
        x, y = shingle_set(a), shingle_set(b)
        assert len(x & y) / len(x | y) >= 0.8 and r.end_word - r.start_word >= 50
    assert set(seen) >= {0, 404, 402, 403, *range(100, 106)} and not set(seen) & {*range(1, 60), *range(300, 305)}
    assert len(set(seen) & set(range(200, 212))) >= 11
    for i in range(100, 106):
        assert any(s <= 80 and e >= 135 for s, e in seen[i])
    assert substring_dedup.repeated_passages(frame(spark, [])).count() == 0


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, s in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (s != t)))
        row = new
    return min(row)


def test_decontamination_against_edit_distance(spark):
    rng = random.Random(7)
    items = [(i, " ".join(prose(rng, rng.choice([6, 14, 25, 40, 60]), 500))) for i in range(40)]
    items += [(90, None), (91, ""), (92, "the end"), (93, items[0][1])]
    rows = [(i, " ".join(prose(rng, 150, 500))) for i in range(60)]
    for i in range(150):
        k = rng.randrange(40)
        ws = items[k][1].split()
        for _ in range(rng.randrange(0, len(ws) // 4 + 1)):
            at = rng.randrange(len(ws))
            ws[at : at + rng.choice([0, 1])] = [f"W{rng.randrange(900)}"] * rng.choice([0, 1])
        rows.append((1000 + i, " ".join(prose(rng, 50, 500)) + "\n" + ", ".join(ws).upper() + ". " + " ".join(prose(rng, 40, 500))))
    rows += [(5000, None), (5001, ""), (5002, items[3][1] + " z" * 30_000), (None, items[4][1])]
    found = decontamination.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))).collect()
    words = decontamination._words
    want = {}
    for i, t in rows[:-4]:
        for k, item in items:
            s = words((item or "").lower())
            if s:
                d = edit_distance_in(s, words(t.lower()))
                if d <= int(0.2 * len(s)):
                    want[i, k] = d
    got = {(r.doc_id, r.item_id): r for r in found}
    assert {(5002, 3), (None, 4)} <= set(got)
    mine = {x: r.distance for x, r in got.items() if x[0] is not None and x[0] < 5000}
    assert set(mine) <= set(want)
    assert len(mine) >= decontamination.RECALL * len(want)
    assert sum(mine[x] == want[x] for x in mine) >= 0.98 * len(mine)
    for (i, k), r in got.items():
        if i is not None and r.distance == 0:
            text = dict(rows)[i]
            assert words(text.lower())[r.start_word : r.end_word] == words(dict(items)[k].lower())


def test_decontamination_in_blocks_and_empty(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"alpha{i} beta gamma delta epsilon zeta") for i in range(6)], "item_id long, text string")
    docs = frame(spark, [(i, f"so alpha{i} beta gamma delta epsilon zeta end") for i in range(6)])
    whole = sorted(map(tuple, decontamination.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 60)
    assert sorted(map(tuple, decontamination.contaminated(docs, items).collect())) == whole and len(whole) >= 6
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0
    assert decontamination.contaminated(frame(spark, []), items).count() == 0
    assert decontamination.drop_contaminated(docs, items).count() == 0


def test_texts_that_meet_by_chance_are_not_candidates():
    rng = np.random.default_rng(6)
    n, bases = 400, np.array([0, 1 << 9], dtype=np.uint64)
    ids, values = np.arange(n, dtype=np.int64), np.repeat(rng.permutation(2**20)[: n // 2].astype(np.uint64) << np.uint64(12), 2)
    checks = rng.integers(0, 2**32, (n, 4), dtype=np.uint32)
    checks[1:20:2] = checks[0:20:2] ^ np.uint32(1)  # ten pairs are alike, the others only meet
    for large in (False, True):
        values = np.where(ids < 100, bases[0], bases[1]) if large else values
        told = simhash.bucket_pairs(ids, values, ids, checks, np.full(n, 50, dtype=np.int32), 0, 0, 0, 0, near_only=True)[2]
        assert set(told.tolist()) >= set(range(20)) and (len(told) == n if large else set(told.tolist()) == set(range(20)))


def test_counts_of_shared_shingles_drop_no_similar_pair_and_most_others():
    rng = np.random.default_rng(8)
    made, n = {}, 60
    for parts in (32, simhash.PARTS):  # so many were counted before
        held, sets = np.zeros((n, parts), dtype=np.uint8), []
        rng = np.random.default_rng(8)
        base = rng.integers(0, 2**63, 160)
        for i in range(n):
            kept = base[rng.random(160) < (0.97 if i < 10 else 0.86)]
            sets.append((set(kept.tolist()), len(kept) + (0 if i < 10 else 3)))
            np.add.at(held[i], kept % parts, 1)
        sizes, ids = np.array([m for _, m in sets], dtype=np.int32), np.arange(n, dtype=np.int64)
        rep, other, _ = simhash.bucket_pairs(ids, np.zeros(n, dtype=np.uint64), ids, np.zeros((n, 4), dtype=np.uint32), sizes, 0, 0, 0, n, held=held)
        made[parts] = set(zip(rep.tolist(), other.tolist(), strict=True))
        similar = {(a, b) for b in range(n) for a in range(b) if 1.8 * len(sets[a][0] & sets[b][0]) >= 0.8 * (sets[a][1] + sets[b][1])}
        assert similar and similar <= made[parts]
    assert len(made[simhash.PARTS]) < len(made[32]) / 2
    full = np.full((n, simhash.PARTS), simhash.MOST_HELD, dtype=np.uint8)  # a full count leaves room for any number
    rep, _, _ = simhash.bucket_pairs(ids, np.zeros(n, dtype=np.uint64), ids, np.zeros((n, 4), dtype=np.uint32), np.full(n, 10**6, dtype=np.int32), 0, 0, 0, n, held=full)
    assert len(rep) == n * (n - 1) // 2


def test_only_the_representative_is_sorted():
    rng = random.Random(23)
    passage = prose(rng, 60)
    x, y = (substring_dedup.Tokens(" ".join(prose(rng, 30) + passage + prose(rng, 30))) for _ in range(2))
    assert substring_dedup.matched_passages(x, y)
    assert "order" in vars(y) and "order" not in vars(x)
