"""Scans of lines and outcomes against plain loops, typed blocks of pages, and subword cutting."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import chunking
from tidemark.operators import evaluation, lines, resampling, scan
from tidemark.sources import files


def fenced(seed, n):
    rng = random.Random(seed)
    marks = ["```", "````", "~~~", "~~~~~", "   ```", "    ```", "```py", "~~~ a", "``", "text", "deprecated", "", "`````"]
    return [rng.choice(marks) for _ in range(n)]


def prose_by_loop(rows):
    out, fence = [], None
    for n, line in rows:
        bare = line.lstrip(" ")
        size = len(bare) - len(bare.lstrip(bare[:1])) if bare[:1] in ("`", "~") and bare else 0
        marked = size >= 3 and len(line) - len(bare) <= 3
        if fence is None:
            if marked:
                fence = (bare[0], size)
            else:
                out.append((n, line))
        elif marked and bare[0] == fence[0] and size >= fence[1] and not bare[size:].strip():
            fence = None
    return out


def test_prose_outside_of_fences(spark):
    rows = [(t, n, line) for t in range(4) for n, line in enumerate(fenced(t, 300))]
    got = lines.prose_lines(spark.createDataFrame(rows, "id long, n long, line string").repartition(5)).collect()
    for t in range(4):
        mine = [(n, line) for i, n, line in rows if i == t]
        assert sorted((r.n, r.line) for r in got if r.id == t) == prose_by_loop(mine)
        assert lines.prose_only("\n".join(x for _, x in mine)) == "\n".join(x for _, x in prose_by_loop(mine))


def test_states_of_fences_compose():
    rng = random.Random(9)
    for _ in range(300):
        rows = fenced(rng.random(), 12)
        at = rng.randint(0, 12)
        whole, one, two = lines.OUTSIDE, lines.OUTSIDE, lines.OUTSIDE
        for n, line in enumerate(rows):
            whole = lines.join_fences(whole, lines.fence_state(line))
            one, two = (lines.join_fences(one, lines.fence_state(line)), two) if n < at else (one, lines.join_fences(two, lines.fence_state(line)))
        assert lines.join_fences(one, two) == whole
        for where in (None, ["`", 3], ["`", 4], ["~", 3], ["~", 9]):
            step = where
            for line in rows:
                step = lines.after_lines(lines.fence_state(line), step)
            assert lines.after_lines(whole, where) == step


def test_a_long_fence_is_not_closed_by_a_short_one(spark):
    df = spark.createDataFrame([(1, "````\n```\ndeprecated word\n````\nfine"), (2, "no code"), (3, None), (4, "~~~\nall the rest"), (5, "")], "id long, text string")
    got = {r.id: (r.p, r.s) for r in df.select("id", lines.prose(F.col("text")).alias("p"), lines.fenced_share(F.col("text")).alias("s")).collect()}
    assert got == {1: ("fine", 2 / 3), 2: ("no code", 0.0), 3: ("", None), 4: ("", 1.0), 5: ("", None)}


def stacks_by_loop(events):
    out, held = [], []
    for pos, level, heading in events:
        if level is not None:
            held = [h for h in held if h[0] < level] + [(level, heading)]
        out.append((pos, " > ".join(h for _, h in held)))
    return out


def test_sections_of_long_and_short_texts(spark):
    rng = random.Random(4)
    rows = [(t, n, rng.choice([None, 1, 2, 3, 4, 6]), f"h{n}") for t, size in ((0, 900), (1, 5), (2, 1), (3, 200)) for n in range(size)]
    df = spark.createDataFrame(rows, "id long, pos long, level int, heading string").repartition(7)
    got = lines.sections(df).collect()
    for t in range(4):
        assert sorted((r.pos, r.section) for r in got if r.id == t) == stacks_by_loop([(n, lv, h) for i, n, lv, h in rows if i == t])


def test_headings_titles_and_places(spark):
    text = "---\ntitle: 'A  title'\nsub:\n  title: no\n---\n# One\nwords here\n\n\n## Two \nmore\n#no heading\n####### seven\n# Three\nend"
    docs = spark.createDataFrame([(1, "x/a.md", text), (2, "x/b.md", "plain\n# First\n"), (3, "c\\d.md", "none"), (4, "e.md", None)], "id long, file string, text string")
    assert {r.id: r.title for r in lines.titles(docs).collect()} == {1: "A title", 2: "First", 3: "d.md", 4: "e.md"}
    found = [(r.pos, r.level, r.heading) for r in lines.heading_rows(docs).where("id = 1").orderBy("pos").collect()]
    assert found == [(text.index("# One"), 1, "One"), (text.index("## Two"), 2, "Two"), (text.index("# Three"), 1, "Three")]
    chunks = spark.createDataFrame([(1, 0, "words here\n\n## Two"), (1, 1, "more"), (1, 2, "absent"), (2, 0, "plain")], "id long, ord long, text string")
    placed = {(r.id, r.ord): r.start for r in lines.placed_chunks(docs, chunks).collect()}
    assert placed == {(1, 0): text.index("words here"), (1, 1): text.index("more"), (1, 2): None, (2, 0): 0}


@pytest.mark.parametrize("limit", [1, 3])
def test_breaker_stops_after_failures_in_a_row(spark, limit):
    rng = random.Random(limit)
    rows = [(run, n, rng.random() < 0.3, rng.random() < 0.5) for run in range(30) for n in range(rng.choice([1, 4, 60]))]
    got = lines.breaker(spark.createDataFrame(rows, "run long, seq long, cached boolean, failed boolean").repartition(6), limit).collect()
    want, last, streak, broken = [], None, 0, False
    for run, n, cached, failed in rows:
        if run != last:
            last, streak, broken = run, 0, False
        was = broken
        if not cached and not was:
            streak = streak + 1 if failed else 0
            broken = streak >= limit
        want.append((run, n, "cached" if cached else "skipped" if was else "failed" if failed else "done", None if was else streak))
    assert sorted((r.run, r.seq, r.status, r.in_a_row) for r in got) == want


def test_scan_equals_a_loop_over_any_partitions(spark):
    rows = [(g, n, (n * 7 + g) % 5) for g, size in ((1, 500), (2, 3), (3, 1), (4, 120)) for n in range(size)]
    df = spark.createDataFrame([*rows, (None, 1, 1)], "g long, n long, v long")
    found = scan.scan(df, "g", ["n"], lambda r: [int(r["v"])], lambda a, b: (a + b)[-3:], [], ["n"])
    got = {(r.g, r.n): r.state for r in found.collect()}
    assert len(got) == len(rows)
    for g, n, _ in rows:
        assert got[g, n] == str([v for i, m, v in rows if i == g and m <= n][-3:])
    assert scan.scan(df.limit(0), "g", ["n"], lambda r: [1], lambda a, b: a + b, [], ["n"]).count() == 0


PAGE = """<html><head><title>t</title><style>x</style></head><body><h1>Head <b>line</b></h1><p>One.<p>Two &amp; more<table><tr><th rowspan=2>Name</th><th colspan="2">Size</th></tr>
<tr><th>w</th><th>h</th></tr><tr><td>a|b</td><td>1<td>2<script>no</script></tr><tr></tr></table><h2>Next</h2>tail<table><td>lone<table><tr><td>inner</td></tr></table></table><h3>open"""


def test_pages_have_typed_blocks(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "just text")], "page_id long, html string")
    got = {(r.page_id, r.ord): (r.kind, r.heading, r.table_index, r.text) for r in files.page_blocks(pages).collect()}
    grid = "| Name | Size | Size |\n| --- | --- | --- |\n| Name | w | h |\n| a\\|b | 1 | 2 |"
    assert got == {
        (1, 0): ("text", None, None, "t"), (1, 1): ("heading", "# Head line", None, "Head line"), (1, 2): ("text", "# Head line", None, "One.\nTwo & more"), (1, 3): ("table", "# Head line", 1, grid),
        (1, 4): ("heading", "## Next", None, "Next"), (1, 5): ("text", "## Next", None, "tail"), (1, 6): ("table", "## Next", 2, "| inner |\n| --- |"), (1, 7): ("table", "## Next", 3, "| lone |\n| --- |"),
        (1, 8): ("heading", "# open", None, "open"), (3, 0): ("text", None, None, "just text"),
    }


def test_grids_place_spanning_cells():
    rng = random.Random(6)
    for _ in range(200):
        rows = [[(f"{y}.{x}", rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2])) for x in range(rng.randint(0, 4))] for y in range(rng.randint(1, 5))]
        grid = files.table_grid(rows)
        assert len({len(r) for r in grid}) == 1 and len(grid) == len(rows)
        for y, row in enumerate(rows):
            places = [grid[y].index(t) for t, _, _ in row if t in grid[y]]
            assert places == sorted(places) and len(places) == len(row)


def test_words_are_cut_by_the_longest_piece(spark, monkeypatch):
    vocabulary = ["a", "ab", "abc", "##c", "##d", "##cd", "x", "##y", "é", "##é"]
    words = ["abcd", "abd", "a", "xyy", "xz", "é", "éé", "abcc", "q", "a" * 101, ""]

    def pieces(word):
        at, n = 0, 0
        while at < len(word):
            size = next((k for k in range(len(word) - at, 0, -1) if ("##" if at else "") + word[at : at + k] in vocabulary), 0)
            if not size:
                return 0
            at, n = at + size, n + 1
        return n

    table = spark.createDataFrame([(p,) for p in vocabulary], "piece string")
    for most in (200_000, 1):
        monkeypatch.setattr(evaluation.small, "__defaults__", (most,))
        got = {r.word: r.pieces for r in evaluation.subword_counts(spark.createDataFrame([(w,) for w in words], "word string"), table).collect()}
        assert got == {w: pieces(w) if len(w) <= 100 else 0 for w in words}
    docs = spark.createDataFrame([("g", 1, "ABCD abd, a a xyy"), ("h", 2, "a q"), ("i", 3, None)], "g string, id long, text string")
    assert {r.g: (r.n_types, round(r.rate, 6)) for r in evaluation.oov_rates(docs, "g", table).collect()} == {"g": (4, 0.75), "h": (2, 0.0)}
    assert evaluation.oov_rates(docs, "g", table, budget=1.0).count() <= 2


def test_cluster_bootstrap_draws_whole_clusters(spark):
    rng = random.Random(1)
    rows = [(s, f"c{c}", float(c % 2), 1.0) for c in range(40) for s in range(2) for _ in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, "stratum long, cluster string, num double, den double")
    r = resampling.cluster_bootstrap(df).first()
    alone = resampling.cluster_bootstrap(df.withColumn("cluster", F.monotonically_increasing_id().cast("string"))).first()
    assert r.n_clusters == 40 and abs(r.ratio - sum(x[2] for x in rows) / len(rows)) < 1e-9 and r.low < r.ratio < r.high
    assert r.high - r.low > 2 * (alone.high - alone.low)


def test_sectioned_chunks_of_rows_are_what_the_scan_gives(spark):
    text = "---\ntitle: 'Given'\n---\n# One\n\n" + "word " * 300 + "\n\n## Two\n\nshort\n\n# Three\n\n" + "other " * 200
    rows = [(1, "a/b.md", text), (2, "c.md", text[23:]), (3, "d/e.md", None), (4, None, "no heading\n\nat all"), (5, "f.md", "x\n### Deep\n" + "word\n" * 400 + "\n## Up\nend"), (None, "g.md", "# Lost")]
    docs = spark.createDataFrame(rows, "id long, file string, text string")
    placed = lines.placed_chunks(docs, chunking.chunk(docs.select("id", "text"), "id"))
    empty = [F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("heading")]
    events = lines.heading_rows(docs).unionByName(placed.where("start is not null").select("id", F.col("start").alias("pos"), *empty))
    under = lines.sections(events).where("level is null").select("id", F.col("pos").alias("start"), "section").distinct()
    want = placed.join(under, ["id", "start"], "left").join(lines.titles(docs), "id").select("id", "ord", "start", "title", F.coalesce("section", F.lit("")).alias("section"))
    got = lines.sectioned_chunks(docs, chunking.prose_chunks)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.section for r in got.collect()} >= {"One", "Three", "Deep"} and {r.title for r in got.collect()} >= {"Given", "One", "f.md"}
