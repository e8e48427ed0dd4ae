"""The pipeline's stages over small tables, against plain versions of what each must keep."""

import random

import corpus_pipeline

from tidemark.llm import decontamination, toxicity
from tidemark.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write_tables(spark, path):
    rng = random.Random(21)
    prose = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    items = [(i, prose(25)) for i in range(5)]
    docs, labels = [], []
    for i in range(300):
        text = prose(rng.randrange(30, 120))
        toxic = i % 5 == 0
        if toxic:
            text = "blargon " + text + " zorkface blargon"
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(toxic)))
    clean = docs[1:]
    docs += [(1000 + i, clean[i][1], "en", "s1", 0) for i in (0, 1, 2, 7)]  # exact copies of clean and toxic rows
    near = docs[11][1].split()
    near[3] = "edited"
    docs.append((2000, " ".join(near), "en", "s2", 0))
    docs.append((3000, prose(30) + " " + items[2][1] + " " + prose(30), "en", "s3", 0))
    docs += [(4000, None, None, None, None), (4001, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, items


def similar(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y) >= 0.8


def test_stages_against_plain_versions(spark, tmp_path):
    rows, items = write_tables(spark, str(tmp_path))
    docs, sf = table(spark, str(tmp_path), "documents"), str(tmp_path)
    model = toxicity.train(docs, table(spark, sf, "labels"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    assert {i for i, t, *_ in rows if t and "blargon" in t} == toxic
    want = {i: t for i, t, *_ in rows if i not in toxic}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
        if k == 1:
            want = {max(j for j, u in want.items() if (u or "") == (t or "")): t for t in want.values()}
        if k == 2:
            want = {i: t for i, t in want.items() if not any(j < i and t and u and similar(t, u) for j, u in want.items())}
        if k == 3:
            ids = {w: n for n, w in enumerate({w for _, t in items for w in t.split()})}
            code = lambda t: [ids.get(w, -1) for w in decontamination._words((t or "").lower())]
            import numpy as np

            holds = lambda t: any(decontamination.infix_distance(np.array(code(x)), np.array(code(t)))[0] <= 5 for _, x in items)
            want = {i: t for i, t in want.items() if not holds(t)}
        assert docs.columns == COLUMNS and {r.doc_id for r in docs.collect()} == set(want)
    assert 3000 not in want and 2000 not in want
    mixed = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    again = corpus_pipeline.run(spark, sf)
    assert mixed.columns == COLUMNS + ["repeats", "copy", "shuffle_key"]
    assert sorted(r.shuffle_key for r in mixed.collect()) == sorted(r.shuffle_key for r in again.collect())


def test_an_empty_table(spark, tmp_path):
    write_tables(spark, str(tmp_path / "a"))
    empty = str(tmp_path / "b")
    for name in ("documents", "labels", "benchmark"):
        table(spark, str(tmp_path / "a"), name).limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
