"""Generations, calibration, corpus rules and statistics on small tables."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import chunking, stats
from tidemark.operators import calibration, corpus, evaluation, lifecycle
from tidemark.sources import files, synthetic
from tidemark.streaming import ingest

CHUNK = "id string, source string, text string, indexed_at timestamp, first_indexed timestamp"
DAY1, DAY2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
NOW = "2024-02-01 00:00:00"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture
def store(spark):
    return spark.createDataFrame([("1", "a", "x", DAY2, DAY1), ("2", "a", "y", DAY2, None), ("3", "b", "z", DAY2, DAY2)], CHUNK)


def test_upsert_keeps_first_seen(spark, store):
    new = spark.createDataFrame([("2", "a", "new"), ("4", "c", "n"), ("4", "c", "m")], "id string, source string, text string")
    out = {r.id: r for r in lifecycle.upsert(store, new, NOW).collect()}
    assert {k: r.text for k, r in out.items()} == {"1": "x", "2": "new", "3": "z", "4": "n"}
    assert out["2"].first_indexed == DAY2 and out["2"].indexed_at == datetime(2024, 2, 1)
    assert out["4"].first_indexed == datetime(2024, 2, 1)


def test_replacing_sources_drops_what_is_not_given_again(spark, store):
    new = spark.createDataFrame([("1", "a", "again")], "id string, source string, text string")
    out = {r.id: r for r in lifecycle.replace_sources(store, new, spark.createDataFrame([("a",)], "source string"), NOW).collect()}
    assert set(out) == {"1", "3"} and out["1"].first_indexed == DAY1


def test_manifest_diff_and_delta(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "uri string, sha256 string")
    new = spark.createDataFrame([("b", "2"), ("c", "4"), ("d", "5")], "uri string, sha256 string")
    assert dict(rows(lifecycle.manifest_diff(old, new), "uri", "change")) == {"a": "removed", "b": "same", "c": "modified", "d": "added"}
    assert lifecycle.corpus_delta(old, new).first().delta == 0.75
    assert lifecycle.corpus_delta(old.limit(0), new.limit(0)).first().delta == 0.0


def test_parity_names_every_problem(spark):
    side = lambda *r: spark.createDataFrame(list(r), "source string, hash string")
    found = lifecycle.parity(side(("a", "1"), ("b", "1"), ("c", "1"), ("e", None)), side(("b", "2"), ("c", "1"), ("c", "1"), ("d", "1"), ("e", None)))
    assert dict(rows(found, "source", "problem")) == {"a": "missing", "b": "hash", "c": "count", "d": "extra"}


def test_pruning_is_refused_if_half_would_go(spark):
    known = spark.createDataFrame([(str(i),) for i in range(6)], "source string")
    assert lifecycle.vanished(known, known.limit(3)).first().refused is True
    assert lifecycle.vanished(known, known.limit(4)).first().refused is False


def test_retention_keeps_the_newest(spark):
    made = [("t", i, "retired", datetime(2024, 1, i), None) for i in range(1, 6)]
    g = spark.createDataFrame(made, "tenant_id string, generation_id long, state string, created_at timestamp, retired_at timestamp")
    assert rows(lifecycle.collectable(g, NOW), "generation_id") == [(1,), (2,), (3,)]


def test_fitted_threshold_lies_in_the_gap(spark):
    samples = spark.createDataFrame([(True, 0.7 + i / 1000) for i in range(40)] + [(False, 0.3 + i / 1000) for i in range(40)], "label boolean, score double")
    fit = calibration.fit(samples).first()
    assert fit.threshold == 0.52 and fit.auc == 1.0 and fit.certified is True
    alone = calibration.fit(samples.where("label")).first()
    assert alone.threshold == 0.702 and alone.auc is None and alone.scale == 0.05
    assert calibration.fit(samples.limit(0)).first().threshold == 0.5


def test_leave_one_out_refits_without_the_sample(spark):
    pos, neg = [0.52, 0.6, 0.7, 0.9, 0.95], [0.1, 0.3, 0.5, 0.55]
    cut = lambda p, n: int((sorted(p)[min(len(p) - 1, int(0.05 * len(p)))] + sorted(n)[min(len(n) - 1, int(0.95 * len(n)))]) / 2 * 1000) / 1000
    fa = sum(x < cut([y for y in pos if y != x], neg) for x in pos) / len(pos)
    fc = sum(x >= cut(pos, [y for y in neg if y != x]) for x in neg) / len(neg)
    samples = spark.createDataFrame([(True, x) for x in pos] + [(False, x) for x in neg], "label boolean, score double")
    out = calibration.leave_one_out(samples).first()
    assert (out.false_abstain, out.false_confirm) == (fa, fc)


def test_overlapping_windows_equal_all_pairs(spark):
    at = lambda d: datetime(2024, 1 + d // 28, 1 + d % 28) if d is not None else None
    made = [("s", f"f{i}", (1, -1, 0)[i % 3], s, e) for i, (s, e) in enumerate([(0, 10), (10, 20), (5, 300), (None, 8), (9, None), (200, 210), (301, 305), (None, None), (40, 30)])]
    w = spark.createDataFrame([(a, f, p, at(s), at(e)) for a, f, p, s, e in made], "subject string, file string, polarity int, valid_from timestamp, valid_until timestamp")
    low, high = (lambda s: -1 if s is None else s), (lambda e: 10**6 if e is None else e)
    proper = [r for r in made if low(r[3]) <= high(r[4])]
    expected = [(a[1], b[1]) for a in proper for b in proper if a[1] < b[1] and a[2] * b[2] == -1 and max(low(a[3]), low(b[3])) <= min(high(a[4]), high(b[4]))]
    assert rows(corpus.overlapping_pairs(w), "left", "right") == sorted(expected)


def test_claim_drift_needs_a_changed_number(spark):
    revs = spark.createDataFrame([("p", 1, "The limit is 40 MB now\nfixed words here"), ("p", 2, "The limit is 50 MB now"), ("p", 3, "The limit is 50 MB now"), ("q", 1, None)], "path string, rev long, text string")
    assert rows(corpus.claim_drift(revs), "rev", "old_line", "new_line") == [(1, "The limit is 40 MB now", "The limit is 50 MB now")]


def test_claim_drift_is_one_number_of_a_line(spark):
    old = "gpt3 scored 88 points\n2. The first step is this\nThe share is 5,5% of it\nissue #281 took 4 days\n2. It took 3 days in all"
    new = "gpt4 scored 91 points\n3. The first step is this\nThe share is 6% of it\nissue 281 took # days\n2. It took 4 days in all"
    got = corpus.claim_drift(spark.createDataFrame([("a", 1, old), ("a", 2, new)], "path string, rev long, text string")).collect()
    assert {(r.old_line, r.new_line) for r in got} == {("The share is 5,5% of it", "The share is 6% of it"), ("2. It took 3 days in all", "2. It took 4 days in all")}


def test_lint_reports_each_rule(spark):
    made = [
        ("a.md", "x", "a", None, None), ("b.md", "x", "nowhere", None, None), ("c.md", "x", None, "2024-99-01", None), ("n_v1.md", "x", None, None, None), ("n_v2.md", "x", None, None, None),
        ("p.md", "x", "q", None, None), ("q.md", "x", "p", None, None), ("z.md", "this is superseded by something", None, None, None), ("f.md", "```\nsuperseded by\n```", None, None, None),
    ]
    docs = spark.createDataFrame(made, "file string, text string, supersedes string, valid_from string, valid_until string")
    assert rows(corpus.lint(docs), "file", "code") == [
        ("a.md", "self-supersedes"), ("b.md", "dangling-supersedes"), ("c.md", "invalid-date"), ("n_v2.md", "version-sibling-unlinked"), ("p.md", "supersession-cycle"), ("z.md", "closure-marker-unlinked"),
    ]


def test_ranking_metrics(spark):
    ranking = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, id long, rank long")
    relevant = spark.createDataFrame([(1, 11), (1, 99), (2, 5)], "query_id long, id long")
    out = {r.query_id: r for r in evaluation.ranking_metrics(ranking, relevant, 3).collect()}
    assert out[1].precision == pytest.approx(1 / 3) and out[1].recall == 0.5 and out[1].mrr == 0.5
    assert out[1].ndcg == pytest.approx((1 / 1.5849625) / (1 + 1 / 1.5849625), abs=1e-6)
    assert (out[2].recall, out[2].mrr, out[2].ndcg) == (0.0, 0.0, 0.0)


def test_token_f1(spark):
    pairs = spark.createDataFrame([("The cat sat!", "a cat sat down"), ("", ""), (None, "x")], "prediction string, gold string")
    assert [round(r.f1, 4) for r in evaluation.token_f1(pairs).collect()] == [0.8, 1.0, 0.0]


def test_exact_sign_test(spark):
    out = spark.createDataFrame([(1, 9), (0, 0), (5, 5)], "b long, c long").select(F.round(stats.exact_two_sided(F.col("b"), F.col("c")), 6).alias("p")).collect()
    assert [r.p for r in out] == [0.021484, 1.0, 1.0]


def test_chunks_hold_the_text_in_order():
    text = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(40 * i + 1)) for i in range(8))
    pieces = chunking.prose_chunks(text, 200, 0)
    assert all(len(p) <= 200 for p in pieces)
    assert " ".join(" ".join(pieces).split()) == " ".join(text.split())
    assert chunking.prose_chunks(None) == [] and chunking.prose_chunks("  \n\n ") == []
    assert chunking.cut_long("x" * 450, 200, 0) == ["x" * 200, "x" * 200, "x" * 50]
    with pytest.raises(ValueError):
        chunking.cut_long("x", 0)
    code = chunking.code_chunks("import os\n\ndef f():\n    pass\n\nclass A:\n    pass\n", 20)
    assert [c.split("\n")[0] for c in code] == ["import os", "def f():", "class A:"]


def test_corpus_walk_and_manifest(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "notes/a.md").write_bytes(b"\xef\xbb\xbfhello\x00 there")
    (tmp_path / "notes/b.bin").write_bytes(b"x")
    (tmp_path / ".git/c.md").write_text("hidden")
    (tmp_path / "my_secret.txt").write_text("hidden")
    found = files.read_corpus(spark, str(tmp_path)).collect()
    assert [(r.file.rsplit("/", 1)[-1], r.text) for r in found] == [("a.md", "hello there")]
    objects = [{"uri": found[0].file, "version_id": "1", "media_type": "text/markdown", "size": found[0].size, "sha256": found[0].content_hash}, {"uri": "/none", "version_id": "1", "media_type": "x", "size": 1, "sha256": "0"}]
    (tmp_path / "manifest.json").write_text(json.dumps({"tenant_id": "t", "corpus_version": "1", "objects": objects}))
    manifest = files.read_manifest(spark, str(tmp_path / "manifest.json"))
    assert dict(rows(files.verified_objects(files.read_corpus(spark, str(tmp_path / "notes")), manifest), "uri", "status")) == {found[0].file: "ok", "/none": "missing"}


def test_frontmatter_and_pages(spark):
    texts = spark.createDataFrame([("---\nsupersedes: \"a.md\"\nvalid_until: 2024-01-01\n---\nbody",), ("no block",), (None,)], "text string")
    s, f, u, b = files.frontmatter(F.col("text"))
    assert [tuple(r) for r in texts.select(s, f, u, b).collect()] == [("a.md", None, "2024-01-01", "body"), (None, None, None, "no block"), (None, None, None, None)]
    pages = spark.createDataFrame([("<p>Hi <b>you</b></p><script>var x = '</p>'</script><p>end</p>",), (None,)], "html string")
    assert [r.t for r in pages.select(files.visible_text(F.col("html")).alias("t")).collect()] == ["Hi\nyou\nend", ""]


def test_generations_are_pruned_on_read(spark, tmp_path, store):
    files.write_generation(store, str(tmp_path / "g"), "t", "g1")
    files.write_generation(store.limit(1), str(tmp_path / "g"), "t", "g2")
    assert files.read_generation(spark, str(tmp_path / "g"), "t", "g2").count() == 1


def test_ledger_leaves_damaged_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"question_id": "1", "x": 1}\n{"question_id": "2"\n')
    asked = spark.createDataFrame([("1",), ("2",)], "question_id string")
    assert rows(files.unfinished(asked, files.read_ledger(spark, str(tmp_path / "l.jsonl"))), "question_id") == [("2",)]


def test_stream_ingests_each_version_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    memo = lambda text, day: spark.createDataFrame([("a.md", text, datetime(2024, 1, day))], ingest.MEMO)
    for text, day in (("old words", 1), ("new words", 2)):
        memo(text, day).write.mode("append").json(source)
        ingest.ingest(ingest.stream_memos(spark, source), out, state).awaitTermination(60)
    assert rows(ingest.current_chunks(spark.read.parquet(out)), "text") == [("new words",)]


def test_synthetic_corpus_repeats(spark):
    a, b = (synthetic.corpus(spark, 5, 4, 3, 2) for _ in range(2))
    assert rows(a, *a.columns) == rows(b, *b.columns) and a.count() == 5 + 8 + 3 + 2
