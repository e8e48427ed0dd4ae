"""Registered queries of the subpackage, one for each operator, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat_format, chat_repair, decontamination, exact_dedup, language, mixing, quality, ranked_search, secret_scan, simhash, substring_dedup, token_counts, toxicity
from tidemark.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, table(spark, sf_dir, "documents"), sf_dir)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source to the same share of characters, one epoch in all."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "repeats", "copy", "shuffle_key", "text")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spark, table(spark, sf_dir, "documents"), sf_dir)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")
    return found.withColumnRenamed("digest", "text_sha256")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), limit=4096)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat_format.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return found.withColumn("spans", spans)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.report(chat_repair.repair(chat_repair.damage(table(spark, sf_dir, "conversations"))))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.secrets(table(spark, sf_dir, "documents")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(ranked_search.ranked_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    named = (
        op1_toxicity, op2_mixing, op3_decontamination, op4_simhash, op5_quality,
        op6_exact_dedup, op7_substring_dedup, op8_token_counts, op9_language, op10_chat_format,
        op11_conversation_repair, op12_secret_scan, op13_ranked_search,
    )
    return {f.__name__: f for f in named} | {"pipeline": corpus_pipeline.run}


ORACLE_MIXING = """
WITH RECURSIVE mass AS (
  SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS mass FROM documents GROUP BY source
), rates AS (
  SELECT source, 1.0::DOUBLE * (SELECT sum(mass) FROM mass) * 1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM mass WHERE mass > 0) / mass AS rate
  FROM mass WHERE mass > 0
), cdf AS (
  SELECT source, rate AS m, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, m, k + 1, p * m / (k + 1), c + p * m / (k + 1) FROM cdf WHERE k + 1 <= ceil(m + 12 * sqrt(m) + 20)
), keyed AS (
  SELECT doc_id, source, text, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS key, row_number() OVER () AS nr FROM documents
), drawn AS (
  SELECT *, ('0x' || left(md5('mix-1|draw|0|' || key), 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM keyed
), counts AS (
  SELECT d.nr, count(c.k)::BIGINT AS repeats
  FROM drawn d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u GROUP BY d.nr
), counted AS (
  SELECT doc_id, source, text, key, repeats FROM keyed JOIN counts USING (nr)
)
SELECT doc_id, source, repeats, copy, md5('mix-1|order|' || copy || '|' || key) AS shuffle_key, text
FROM (SELECT *, unnest(range(repeats)) AS copy FROM counted)
"""

ORACLE_EXACT = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

ORACLE_CHAT = """
WITH turns AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'
), parts AS (
  SELECT conv_id, perspective, pos // 64 AS segment, pos, role = perspective AS own,
         CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
              ELSE '<|user:' || replace(role, '|', '\\|') || '|>' END AS head,
         regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g') || '<|end|>' AS body
  FROM turns JOIN speakers USING (conv_id)
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, segment ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM parts
)
SELECT conv_id, perspective, segment, count(*) AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY pos) AS rendered,
       coalesce(string_agg((start + length(head)) || '-' || (start + length(head) + length(body)), ',' ORDER BY pos) FILTER (own), '') AS spans,
       coalesce(sum(length(body)) FILTER (own), 0)::BIGINT AS n_loss_chars
FROM placed GROUP BY ALL
"""


#: A cost and an audit for each state; the audits' letters say which turns the repaired lines come from.
ORACLE_REPAIR = r"""
WITH RECURSIVE named AS (
  SELECT *, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)) AS bytes FROM conversations
), fated AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(bytes, lambda b: [b::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
             lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295::BIGINT) % 20 AS fate
  FROM named
), hurt AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated WHERE fate <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, substr(role, 1, 1) AS i
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM hurt)
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
         lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair
  FROM placed
), dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, {'c': 0, 'a': '', 'r': ''} AS b0, {'c': 1000000, 'a': '', 'r': ''} AS b1, {'c': 1000000, 'a': '', 'r': ''} AS b2, {'c': 1000000, 'a': '', 'r': ''} AS b3
  FROM conversations
  UNION ALL
  SELECT conv_id, pos,
         {'c': b0.c + 4, 'a': b0.a || 'D', 'r': b0.r},
         list_min([{'c': b1.c + 4, 'a': b1.a || 'D', 'r': b1.r}, {'c': b0.c + t + CASE i WHEN 's' THEN 0 ELSE n END, 'a': b0.a || 'K', 'r': b0.r || line}]),
         list_min([{'c': b2.c + 4, 'a': b2.a || 'D', 'r': b2.r}] || list_transform([b0, b1, x3], lambda x: {'c': x.c + t + CASE i WHEN 'u' THEN 0 ELSE 3 END, 'a': x.a || CASE i WHEN 'u' THEN 'K' ELSE 'R' END, 'r': x.r || CASE i WHEN 'u' THEN line ELSE as_user END})),
         list_min([{'c': b3.c + 4, 'a': b3.a || 'D', 'r': b3.r}, {'c': x2.c + t + CASE i WHEN 'a' THEN 0 ELSE 3 END, 'a': x2.a || CASE i WHEN 'a' THEN 'K' ELSE 'R' END, 'r': x2.r || CASE i WHEN 'a' THEN line ELSE as_assistant END}])
  FROM (
    SELECT f.conv_id, f.pos, b0, b1, b2, b3, i, CASE WHEN fault IN (1, 2) THEN 1000000 WHEN fault = 3 THEN 3 ELSE 0 END AS t, 1000000 AS n,
           role || ':' || text || chr(10) AS line, 'user:' || text || chr(10) AS as_user, 'assistant:' || text || chr(10) AS as_assistant,
           list_min([b2, {'c': b0.c + 3, 'a': b0.a || 'I', 'r': b0.r || u}, {'c': b1.c + 3, 'a': b1.a || 'I', 'r': b1.r || u}, {'c': b3.c + 3, 'a': b3.a || 'I', 'r': b3.r || u}]) AS x2,
           list_min([b3, {'c': b2.c + 3, 'a': b2.a || 'I', 'r': b2.r || a}, {'c': b0.c + 6, 'a': b0.a || 'II', 'r': b0.r || u || a}, {'c': b1.c + 6, 'a': b1.a || 'II', 'r': b1.r || u || a}]) AS x3
    FROM dp JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.pos = dp.pos + 1, (SELECT 'user:' || chr(10) AS u, 'assistant:' || chr(10) AS a)
  )
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), ends AS (
  SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
         list_min([b0, b3, {'c': b2.c + 3, 'a': b2.a || 'I', 'r': b2.r || 'assistant:' || chr(10)}, {'c': b1.c + 6, 'a': b1.a || 'II', 'r': b1.r || 'user:' || chr(10) || 'assistant:' || chr(10)}]) AS best
  FROM dp d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id WHERE d.pos = coalesce(c.n, 0)
)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, best.c::BIGINT AS cost, best.a AS audit,
       sha256(CASE best.r WHEN '' THEN '' ELSE left(best.r, length(best.r) - 1) END) AS repaired_sha256
FROM ends
"""


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_HITS = """
SELECT nr, {no} AS no, '{kind}' AS kind, unnest(regexp_extract_all(text, '{pattern}', 0)) AS hit, unnest(regexp_extract_all(text, '{pattern}', {group})) AS tested,
       unnest(string_split_regex(text, '{pattern}')[:-2]) AS gap, unnest(range(len(regexp_extract_all(text, '{pattern}', 0)))) AS nth, {least} AS least
FROM docs WHERE regexp_matches(text, '{pattern}')
"""
ORACLE_SECRETS = (
    "WITH docs AS (SELECT row_number() OVER () AS nr, doc_id, coalesce(text, '') AS text FROM documents), hits AS ("
    + " UNION ALL ".join(
        _HITS.format(no=no, kind=kind, pattern=pattern, group=group, least=least)
        for no, (kind, pattern, group, least) in enumerate([("assign", _ASSIGN, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)])
    )
    + """), spans AS (
  SELECT nr, no, kind, sum(length(gap) + length(hit)) OVER (PARTITION BY nr, no ORDER BY nth) AS stop, length(hit) AS size, length(tested) >= least AS long FROM hits
), texts AS (
  SELECT nr, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
         string_agg(kind || ':' || (stop - size) || ':' || stop, ',' ORDER BY stop - size, no) AS spans
  FROM spans WHERE long GROUP BY nr
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(spans, '') AS spans, sha256(coalesce(spans, '')) AS base_sha256
FROM docs LEFT JOIN texts USING (nr)
"""
)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_RANKED = f"""
WITH docs AS (SELECT row_number() OVER () AS nr, doc_id, {_WORDS} AS words FROM documents),
stats AS (SELECT count(*) FILTER (len(words) > 0) AS n, sum(len(words))::BIGINT AS l FROM docs),
asked AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
post AS (
  SELECT nr, doc_id, len(words) AS size, term, count(*) AS tf FROM (SELECT nr, doc_id, words, unnest(words) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
),
weights AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM post, stats GROUP BY term, n),
scored AS (
  SELECT item_id, nr, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * size * n) // l))))::BIGINT AS score
  FROM asked JOIN post USING (term) JOIN weights USING (term), stats GROUP BY item_id, nr, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": ORACLE_MIXING, "op6_exact_dedup": ORACLE_EXACT, "op10_chat_format": ORACLE_CHAT, "op11_conversation_repair": ORACLE_REPAIR, "op12_secret_scan": ORACLE_SECRETS, "op13_ranked_search": ORACLE_RANKED}
