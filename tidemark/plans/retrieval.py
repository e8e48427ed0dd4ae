"""Retrieval queries over documents, benchmark and embeddings.

Queries of the text legs are the items of ``benchmark``; those of the dense legs the vectors whose id is
divisible by 50. All rows of the corpus are searched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import text as T
from tidemark.functions import vectors as V
from tidemark.operators import evaluation, retrieval, vector_index
from tidemark.operators.text_index import SHARD_DOCS
from tidemark.sources import tables
from tidemark.sources.shared import named


def _docs(spark, sf):
    return retrieval.spread(tables.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


def _stamp(spark, path: str) -> tuple:
    """Number, size and last change of a table's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime")).first())


def text_index(spark, sf) -> retrieval.TextIndex:
    """The index of documents: written once a session, and again when a file of the table has changed."""
    path = f"{sf}/documents.parquet"
    return retrieval.read_index(spark, named(spark, ("text", path, *_stamp(spark, path)), lambda folder: retrieval.write_index(_docs(spark, sf), folder)))


def _asked(spark, sf):
    return tables.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark, sf):
    return tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _vector_queries(spark, sf):
    return _vectors(spark, sf).where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of vector 0."""
    return retrieval.dense_topk(_vectors(spark, sf), _vector_queries(spark, sf).where("query_id = 0"), 10).select("id", F.round("score", 6).alias("score"), "rank")


def dense_topk_batch(spark, sf):
    return retrieval.dense_topk(_vectors(spark, sf), _vector_queries(spark, sf), 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def dense_topk_filtered(spark, sf):
    """Only vectors of label 3: the filter reaches the scan."""
    return retrieval.dense_topk(_vectors(spark, sf).where("label = 3"), _vector_queries(spark, sf), 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _vector_index(spark, sf):
    path = f"{sf}/embeddings.parquet"
    folder = named(spark, ("vectors", path, *_stamp(spark, path)), lambda f: vector_index.write_vector_index(_vectors(spark, sf), f))
    return vector_index.read_vector_index(spark, folder)


def indexed_topk_exact(spark, sf):
    """The rows of dense_topk_batch from the stored cells; cells that can't hold any of them are not read."""
    found = vector_index.indexed_topk(_vector_index(spark, sf), _vector_queries(spark, sf), 5, exact=True)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def indexed_recall(spark, sf):
    """Whether the nearest cells alone hold 0.95 of the ten nearest vectors of all queries, and read fewer vectors."""
    index, asked = _vector_index(spark, sf), _vector_queries(spark, sf)
    best = retrieval.dense_topk(_vectors(spark, sf), asked, 10).select("query_id", "id")
    found = vector_index.indexed_topk(index, asked, 10).select("query_id", "id", F.lit(1).alias("hit"))
    recall = best.join(found, ["query_id", "id"], "left").agg(F.count(F.lit(1)).alias("n_neighbours"), (F.count("hit") >= 0.95 * F.count(F.lit(1))).alias("recall_reached"))
    read = vector_index.cells_read(index, asked).agg(F.sum("n_vectors").alias("n"), F.count(F.lit(1)).alias("q")).crossJoin(index.cells.agg(F.count(F.lit(1)).alias("all")))
    return recall.crossJoin(read.select((F.col("n") < F.col("q") * F.col("all")).alias("reads_less")))  # one row each


DENSE = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS s
  FROM embeddings q, embeddings c WHERE {where}
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM pairs)
SELECT {columns} id, round(s, 6) AS score, rank FROM ranked WHERE rank <= {k}
"""

TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
#: Common table expressions of the text legs.
TEXT = f"""
docs AS (SELECT doc_id AS id, {TOKENS.format('text')} AS words, text FROM documents),
qterms AS (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark),
post AS (SELECT id, len(words) AS n_tokens, term, count(*) AS tf FROM (SELECT id, words, unnest(words) AS term FROM docs)
         WHERE term IN (SELECT term FROM qterms) GROUP BY ALL),
bm AS (
  SELECT w.query_id, p.id,
         round(sum(w.times * ln(1.0 + (s.n_docs - d.df + 0.5) / (d.df + 0.5)) * (p.tf * 2.5) / (p.tf + 1.5 * (0.25 + 0.75 * (p.n_tokens / s.avgdl)))), 6) AS score
  FROM post p JOIN (SELECT query_id, term, count(*) AS times FROM qterms GROUP BY ALL) w USING (term)
  JOIN (SELECT term, count(*) AS df FROM post GROUP BY ALL) d USING (term),
       (SELECT count(*) AS n_docs, avg(len(words)) AS avgdl FROM docs) s
  GROUP BY ALL
),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 20),
"""
LEX = """
lexs AS (
  SELECT w.query_id, p.id, round(count(*) + sum(p.tf / (p.tf + 1.0)) / 1000.0, 9) AS score
  FROM post p JOIN (SELECT DISTINCT query_id, term FROM qterms) w USING (term) GROUP BY ALL
),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lexs QUALIFY rank <= 20)
"""


def bm25_topk(spark, sf):
    return retrieval.bm25_topk(text_index(spark, sf), _asked(spark, sf), 10).select("query_id", "id", "score", "rank")


def lexical_topk(spark, sf):
    return retrieval.lexical_topk(text_index(spark, sf), _asked(spark, sf), 10, boost=0.0).select("query_id", "id", "score", "rank")


def lexical_topk_boosted(spark, sf):
    """Conversation turns with a number ask for documents: a shared number lifts a document."""
    return retrieval.lexical_topk(text_index(spark, sf), _numbered(spark, sf), 10).select("query_id", "id", "score", "rank")


def _numbered(spark, sf):
    """Every benchmark item with a number of its own in front."""
    return _asked(spark, sf).select("query_id", F.concat(((F.col("query_id") * 7) % 100).cast("string"), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


def _legs(spark, sf):
    index, asked = text_index(spark, sf), _asked(spark, sf)
    return [retrieval.bm25_topk(index, asked, 20), retrieval.lexical_topk(index, asked, 20, boost=0.0)]


def rrf_fused(spark, sf):
    return retrieval.fuse(_legs(spark, sf), k=10)


def rrf_weighted(spark, sf):
    return retrieval.fuse(_legs(spark, sf), [2.0, 0.5], k=10)


def rrf_nested(spark, sf):
    """Fusion of a fusion and a leg: the form that history queries take."""
    legs = _legs(spark, sf)
    return retrieval.fuse([retrieval.fuse(legs, k=20), legs[1]], k=10)


FUSE = """
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_leg, first_rank, id) AS rank, first_leg, first_rank
FROM (
  SELECT query_id, id, round(sum(w / (60 + rank)), 9) AS score, arg_min(leg, leg * 1000 + rank) AS first_leg, arg_min(rank, leg * 1000 + rank) AS first_rank
  FROM ({legs}) GROUP BY ALL
) QUALIFY rank <= {k}
"""


def _legs_sql(a: str, b: str, wa: float, wb: float) -> str:
    return f"SELECT query_id, id, 0 AS leg, rank, {wa}::DOUBLE AS w FROM {a} UNION ALL SELECT query_id, id, 1, rank, {wb}::DOUBLE FROM {b}"


def hashing_embed(spark, sf):
    return V.hashed_buckets(_docs(spark, sf), "id").withColumnRenamed("id", "doc_id")


def hashed_cosine(spark, sf):
    """Benchmark items against documents by hashed 64-dimension vectors."""
    docs = V.hashed_vectors(_docs(spark, sf), "id").select("id", F.col("embedding").alias("vector"))
    asked = V.hashed_vectors(tables.table(spark, sf, "benchmark"), "item_id").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.dense_topk(docs, asked, 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


HASHED = f"""
WITH b AS (
  SELECT src, id, ('0x' || right(md5(t), 2))::INT % 64 AS bucket, count(*)::DOUBLE AS n FROM (
    SELECT 'd' AS src, doc_id AS id, unnest({TOKENS.format('text')}) AS t FROM documents
    UNION ALL SELECT 'q', item_id, unnest({TOKENS.format('text')}) FROM benchmark) GROUP BY ALL
), v AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY src, id)) AS x FROM b),
p AS (SELECT q.id AS query_id, d.id, round(sum(q.x * d.x), 9) AS s FROM v q JOIN v d ON q.bucket = d.bucket AND q.src = 'q' AND d.src = 'd' GROUP BY ALL)
SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM p QUALIFY rank <= 5
"""


def _sidecar(rows, key="id"):
    """Weights ln(1 + tf) of postings, the 200 heaviest terms of each text."""
    weighed = rows.select(key, "term", F.round(F.ln(1.0 + F.col("tf")), 9).alias("weight"))
    order = W.partitionBy(key).orderBy(F.desc("weight"), "term")
    return weighed.withColumn("_n", F.row_number().over(order)).where("_n <= 200").drop("_n")


def _dealt_terms(spark, sf):
    """Postings of documents dealt by id, so that a task has about SHARD_DOCS documents however many there are."""
    index = text_index(spark, sf)
    return index.terms.repartition(max(spark.sparkContext.defaultParallelism, -(-index.stats.first()["n_docs"] // SHARD_DOCS)), "id")


def sparse_sidecar(spark, sf):
    """The sparse sidecar of documents: (id, term, weight); a text without a term has no row."""
    return _sidecar(_dealt_terms(spark, sf))


def learned_sparse_topk(spark, sf):
    """Weights are ln(1 + tf), each document pruned to its 200 heaviest terms."""
    asked = retrieval.postings(_asked(spark, sf).withColumnRenamed("query_id", "id")).select(F.col("id").alias("query_id"), "term", F.round(F.ln(1.0 + F.col("tf")), 9).alias("weight"))
    return retrieval.sparse_topk(_sidecar(_dealt_terms(spark, sf)), asked, 10).select("query_id", "id", "score", "rank")


SPARSE = f"""
WITH d AS (
  SELECT id, term, round(ln(1.0 + count(*)), 9) AS w FROM (SELECT doc_id AS id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY id, term
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, term) <= 200
), q AS (SELECT id AS query_id, term, round(ln(1.0 + count(*)), 9) AS w FROM (SELECT item_id AS id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, id, round(sum(d.w * q.w), 6) AS x FROM d JOIN q USING (term) GROUP BY ALL)
SELECT query_id, id, x AS score, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, id) AS rank FROM s WHERE x > 0 QUALIFY rank <= 10
"""


def rerank_overlap(spark, sf):
    docs, asked = _docs(spark, sf), _asked(spark, sf)
    return retrieval.rerank_by_overlap(retrieval.bm25_topk(text_index(spark, sf), asked, 10), docs, asked).select("query_id", "id", "score", F.round("overlap", 6).alias("overlap"), "rank")


def gap_warnings(spark, sf):
    asked = _vector_queries(spark, sf)
    hits = retrieval.dense_topk(_vectors(spark, sf).where("label <> 3"), asked, 3)
    return retrieval.gap_warning(hits, asked, 0.9999).select("query_id", F.round("best", 6).alias("best"), "gap_warning")


def _turn_hits(spark, sf):
    """Every conversation's second turn is a hit of query conv_id // 100."""
    turns = tables.table(spark, sf, "conversations").where("turn = 1")
    return turns.select(F.expr("conv_id div 100").alias("query_id"), F.col("conv_id").alias("file"), F.col("turn").alias("ord"), F.expr("conv_id + 1").alias("rank"))


def neighbour_expansion(spark, sf):
    chunks = tables.table(spark, sf, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("ord"))
    return retrieval.neighbours(_turn_hits(spark, sf), chunks, radius=1, sources=2, most=4)


NEIGHBOURS = """
WITH hits AS (SELECT conv_id // 100 AS query_id, conv_id AS file, turn AS ord, conv_id + 1 AS rank FROM conversations WHERE turn = 1),
kept AS (SELECT query_id, file, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), file) AS place FROM hits GROUP BY query_id, file QUALIFY place <= 2),
ends AS (SELECT conv_id AS file, max(turn) AS ord FROM conversations GROUP BY 1),
found AS (
  SELECT DISTINCT h.query_id, h.file, c.turn AS ord FROM hits h JOIN kept k USING (query_id, file) JOIN conversations c ON c.conv_id = h.file AND abs(c.turn - h.ord) <= 1
  UNION SELECT k.query_id, k.file, l.ord FROM kept k JOIN ends l USING (file))
SELECT query_id, file, ord, row_number() OVER (PARTITION BY query_id, file ORDER BY ord) AS nth FROM found QUALIFY nth <= 4
"""


def interleaved_evidence(spark, sf):
    turns = tables.table(spark, sf, "conversations")
    hits = turns.select(F.expr("conv_id div 3").alias("query_id"), F.col("conv_id").alias("file"), F.col("turn").alias("ord"), F.expr("turn * 10 + conv_id % 3").alias("rank"))
    return retrieval.interleave(hits, 5, 2)


INTERLEAVE = """
WITH hits AS (SELECT conv_id // 3 AS query_id, conv_id AS file, turn AS ord, turn * 10 + conv_id % 3 AS rank FROM conversations),
docs AS (SELECT query_id, file, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), file) AS doc FROM hits GROUP BY query_id, file QUALIFY doc <= 2),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, file ORDER BY ord, rank) AS turn FROM hits JOIN docs USING (query_id, file)),
p AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY turn, doc) <= 5)
SELECT query_id, file, ord, row_number() OVER (PARTITION BY query_id ORDER BY doc, ord, rank) AS position FROM p
"""


def history_queries(spark, sf):
    turns = tables.table(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: F.concat(F.lit("|user|: "), s["text"])).alias("turns"))
    return turns.select("conv_id", F.md5(T.history_query(F.col("turns"))).alias("query_md5"))


HISTORY = """
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations WHERE role = 'user')
SELECT conv_id, md5(coalesce(string_agg(trim(line), chr(10) ORDER BY turn, i) FILTER (trim(line) <> ''), '')) AS query_md5 FROM l GROUP BY conv_id
"""


def sparse_arms_differ(spark, sf):
    """Whether the two text legs return other documents, or only another order."""
    a, b = (leg.where("rank <= 5") for leg in _legs(spark, sf))
    return evaluation.arms_differ(a, b)


def max_sim_pairs(spark, sf):
    """Late interaction of the query vectors with all vectors of each label."""
    rows = _vectors(spark, sf).select(F.col("label").cast("long").alias("grp"), "vector")
    return retrieval.max_sim_by_group(rows, _vector_queries(spark, sf)).select(F.col("grp").alias("label"), F.round("score", 4).alias("score"))


MAXSIM = """
SELECT label, round(sum(best), 4) AS score FROM (
  SELECT d.label::BIGINT AS label, q.vec_id, max(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[])) AS best
  FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0 GROUP BY ALL) GROUP BY label
"""

QUERIES = {f.__name__: f for f in (
    dense_topk, dense_topk_batch, dense_topk_filtered, indexed_topk_exact, indexed_recall, bm25_topk, lexical_topk, lexical_topk_boosted, sparse_sidecar, rrf_fused, rrf_weighted, rrf_nested, hashing_embed, hashed_cosine,
    learned_sparse_topk, rerank_overlap, gap_warnings, neighbour_expansion, interleaved_evidence, history_queries, sparse_arms_differ, max_sim_pairs,
)}
ORACLES = {
    "dense_topk": DENSE.format(where="q.vec_id = 0", columns="", k=10),
    "dense_topk_batch": DENSE.format(where="q.vec_id % 50 = 0", columns="query_id,", k=5),
    "indexed_topk_exact": DENSE.format(where="q.vec_id % 50 = 0", columns="query_id,", k=5),
    "indexed_recall": "SELECT sum(least(10, (SELECT count(*) FROM embeddings)))::BIGINT AS n_neighbours, true AS recall_reached, true AS reads_less FROM embeddings WHERE vec_id % 50 = 0",
    "dense_topk_filtered": DENSE.format(where="q.vec_id % 50 = 0 AND c.label = 3", columns="query_id,", k=5),
    "bm25_topk": f"WITH {TEXT} z AS (SELECT 1) SELECT query_id, id, score, rank FROM bm25 WHERE rank <= 10",
    "lexical_topk": f"WITH {TEXT} {LEX} SELECT query_id, id, score, rank FROM lex WHERE rank <= 10",
    "lexical_topk_boosted": rf"""WITH asked AS (SELECT item_id AS query_id, ((item_id * 7) % 100)::VARCHAR || ' ' || coalesce(text, '') AS text FROM benchmark),
        docs AS (SELECT doc_id AS id, {TOKENS.format('text')} AS words, text FROM documents), qterms AS (SELECT DISTINCT query_id, unnest({TOKENS.format('text')}) AS term FROM asked),
        post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(words) AS term FROM docs) WHERE term IN (SELECT term FROM qterms) GROUP BY ALL),
        base AS (SELECT query_id, id, count(*) + sum(tf / (tf + 1.0)) / 1000.0 AS base FROM post JOIN qterms USING (term) GROUP BY ALL),
        dn AS (SELECT DISTINCT id, replace(unnest(regexp_extract_all(' ' || regexp_replace(text, '(\s)', '\1\1', 'g') || ' ', '[^\w.]([+-]?\d+(?:[.,]\d+)?%?)[^\w.]', 1)), ',', '.') AS number FROM docs),
        qn AS (SELECT DISTINCT query_id, replace(unnest(regexp_extract_all(' ' || regexp_replace(text, '(\s)', '\1\1', 'g') || ' ', '[^\w.]([+-]?\d+(?:[.,]\d+)?%?)[^\w.]', 1)), ',', '.') AS number FROM asked),
        b AS (SELECT DISTINCT query_id, id FROM dn JOIN qn USING (number)), s AS (SELECT query_id, id, round(base + CASE WHEN b.id IS NULL THEN 0 ELSE 0.25 END, 9) AS score FROM base LEFT JOIN b USING (query_id, id))
        SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10""",
    "sparse_sidecar": f"""SELECT id, term, round(ln(1.0 + count(*)), 9) AS weight FROM (SELECT doc_id AS id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY id, term
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) <= 200""",
    "rrf_fused": f"WITH {TEXT} {LEX} " + FUSE.format(legs=_legs_sql("bm25", "lex", 1, 1), k=10),
    "rrf_weighted": f"WITH {TEXT} {LEX} " + FUSE.format(legs=_legs_sql("bm25", "lex", 2, 0.5), k=10),
    "rrf_nested": f"WITH {TEXT} {LEX}, inner_fused AS (" + FUSE.format(legs=_legs_sql("bm25", "lex", 1, 1), k=20) + ") " + FUSE.format(legs=_legs_sql("inner_fused", "lex", 1, 1), k=10),
    "hashing_embed": f"SELECT doc_id, ('0x' || right(md5(t), 2))::INT % 64 AS bucket, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS t FROM documents) GROUP BY ALL",
    "hashed_cosine": HASHED, "learned_sparse_topk": SPARSE,
    "rerank_overlap": f"""WITH {TEXT} q AS (SELECT query_id, list(DISTINCT term) AS asked FROM qterms GROUP BY ALL),
        o AS (SELECT b.*, round(len(list_intersect(q.asked, list_distinct(d.words))) / greatest(len(q.asked), 1), 9) AS ov FROM bm25 b JOIN docs d USING (id) JOIN q USING (query_id) WHERE rank <= 10)
        SELECT query_id, id, score, round(ov, 6) AS overlap, row_number() OVER (PARTITION BY query_id ORDER BY ov DESC, rank) AS rank FROM o""",
    "gap_warnings": """SELECT q.vec_id AS query_id, round(max(s), 6) AS best, coalesce(max(s) < 0.9999, true) AS gap_warning FROM embeddings q LEFT JOIN
        (SELECT q.vec_id, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS s FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND c.label <> 3) p USING (vec_id)
        WHERE q.vec_id % 50 = 0 GROUP BY 1""",
    "neighbour_expansion": NEIGHBOURS, "interleaved_evidence": INTERLEAVE, "history_queries": HISTORY,
    "sparse_arms_differ": f"""WITH {TEXT} {LEX}, a AS (SELECT query_id, list(id ORDER BY rank) AS x FROM bm25 WHERE rank <= 5 GROUP BY 1), b AS (SELECT query_id, list(id ORDER BY rank) AS y FROM lex WHERE rank <= 5 GROUP BY 1)
        SELECT query_id, CASE WHEN coalesce(x, []) = coalesce(y, []) THEN 'IDENTICAL' WHEN list_sort(coalesce(x, [])) = list_sort(coalesce(y, [])) THEN 'SET_IDENTICAL' ELSE 'DIFFERS' END AS verdict FROM a FULL JOIN b USING (query_id)""",
    "max_sim_pairs": MAXSIM,
}
