"""Retrieval evaluation: ranking metrics, intervals, paired tests, correlations and vocabulary predictors.

Rankings are (query_id, id, rank), relevance is (query_id, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.stats import exact_two_sided, wilson
from tidemark.functions.text import answer_words, tokens
from tidemark.operators.calibration import running_totals
from tidemark.operators.retrieval import small


def _wanted(relevant: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """(query_id, n_rel): how many ids are relevant, from all pairs unless ``wanted`` says it."""
    return relevant.groupBy("query_id").agg(F.count_distinct("id").alias("n_rel")) if wanted is None else wanted.where("n_rel > 0").select("query_id", "n_rel")


def ranking_metrics(ranking: DataFrame, relevant: DataFrame, k: int, wanted: DataFrame | None = None) -> DataFrame:
    """(query_id, precision, recall, mrr, ndcg) of each query with a relevant id; 0 for queries without a hit.

    Here and below ``relevant`` (query_id, id) has all pairs, or with ``wanted`` (query_id, n_rel) at least those that
    are ranked: where ids are relevant by class, the others need not be listed.
    """
    marked = ranking.join(relevant.select("query_id", "id", F.lit(1).alias("rel")).distinct(), ["query_id", "id"], "left")
    top = F.col("rank") <= k
    found = marked.groupBy("query_id").agg(
        F.count_if(top & F.col("rel").isNotNull()).alias("hits"), F.min(F.when(F.col("rel").isNotNull(), F.col("rank"))).alias("first"),
        F.sum(F.when(top & F.col("rel").isNotNull(), 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
    )
    wanted = _wanted(relevant, wanted)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    joined = wanted.join(found, "query_id", "left")
    return joined.select(
        "query_id", (F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("precision"), (F.coalesce("hits", F.lit(0)) / F.col("n_rel")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )


def hits_at(ranking: DataFrame, relevant: DataFrame, depths: list[int], wanted: DataFrame | None = None) -> DataFrame:
    """(depth, n, hit_rate): share of queries with a relevant id at that depth or before."""
    first = ranking.join(relevant.distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    queries = _wanted(relevant, wanted).select("query_id").join(first, "query_id", "left")
    return queries.select("query_id", "first", F.explode(F.array(*map(F.lit, depths))).alias("depth")).groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col("first") <= F.col("depth"), F.lit(False)).cast("double")).alias("hit_rate"))


def rates(flags: DataFrame, by: list[str], flag: str) -> DataFrame:
    """(by, n, rate, low, high): share of true flags and its Wilson interval; null rates without data."""
    counted = flags.groupBy(*by).agg(F.count(flag).alias("n"), F.count_if(F.col(flag)).alias("yes"))
    low, high = wilson(F.col("yes"), F.col("n"))
    return counted.select(*by, "n", (F.col("yes") / F.nullif("n", F.lit(0))).alias("rate"), low.alias("low"), high.alias("high"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks from 1, ties at their mean; from running counts over distinct values, in ranges where they are many."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_t"))
    ranks = running_totals(counts, [], value, {"_lower": "_t"}).select(value, (F.col("_lower") + (F.col("_t") + 1) / 2).alias(name))
    return df.join(ranks, value)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    ranked = average_ranks(average_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y), x, "_rx"), y, "_ry")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))


def holm(tests: DataFrame) -> DataFrame:
    """Adds adjusted: Holm's p-values of (name, p), a running maximum that stays at most 1."""
    order = W.orderBy("p", "name")  # one row a test
    placed = tests.withColumn("_i", F.row_number().over(order).cast("long")).withColumn("_m", F.count(F.lit(1)).over(W.partitionBy()))
    step = F.least(F.lit(1.0), F.col("p") * (F.col("_m") - F.col("_i") + 1))
    return placed.withColumn("_s", step).withColumn("adjusted", F.max("_s").over(order.rowsBetween(W.unboundedPreceding, 0))).select("name", "p", "adjusted")


def mcnemar(paired: DataFrame, by: list[str]) -> DataFrame:
    """Paired booleans a and b: discordant counts and the exact two-sided p."""
    counted = paired.groupBy(*by).agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"))
    return counted.withColumn("p", exact_two_sided(F.col("only_a"), F.col("only_b")))


def token_f1(pairs: DataFrame) -> DataFrame:
    """Adds f1 of prediction and gold: multiset overlap of their words; two empty answers match."""
    p, g = answer_words(F.col("prediction")), answer_words(F.col("gold"))
    held = pairs.withColumn("_p", p).withColumn("_g", g)
    times = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    shared = F.aggregate(F.array_distinct(F.array_intersect("_p", "_g")), F.lit(0), lambda s, w: s + F.least(times(F.col("_p"), w), times(F.col("_g"), w)))
    f1 = F.when((F.size("_p") == 0) | (F.size("_g") == 0), (F.size("_p") == F.size("_g")).cast("double")).otherwise(2.0 * shared / (F.size("_p") + F.size("_g")))
    return held.withColumn("f1", f1).drop("_p", "_g")


def vocabulary_overlap(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n_terms, known): distinct words of a query and those that occur anywhere in the corpus. ``postings``
    is any table with the corpus's words (term); a dictionary is enough."""
    terms = query_words(queries)
    seen = postings.select("term").join(small(terms.select("term").distinct()), "term", "left_semi").distinct().withColumn("_in", F.lit(1))
    return terms.join(seen, "term", "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"), F.count("_in").alias("known"))


def rare_term_support(postings: DataFrame, n_docs: int, queries: DataFrame, most_share: float) -> DataFrame:
    """(query_id, id, n): rare query words (in at most that share of documents) that a document holds."""
    terms = query_words(queries)
    found = postings.select("id", "term").join(small(terms.select("term").distinct()), "term", "left_semi")
    rare = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= most_share * n_docs).select("term")
    return found.join(small(rare), "term").join(small(terms), "term").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"))


def query_words(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def arms_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, verdict) of two arms' rankings: DIFFERS, SET_IDENTICAL (other order) or IDENTICAL."""
    listed = lambda df, name: df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias(name))
    both = listed(a, "x").join(listed(b, "y"), "query_id", "full")
    x, y = F.coalesce("x", F.array().cast("array<bigint>")), F.coalesce("y", F.array().cast("array<bigint>"))
    return both.select("query_id", F.when(x == y, "IDENTICAL").when(F.array_sort(x) == F.array_sort(y), "SET_IDENTICAL").otherwise("DIFFERS").alias("verdict"))


def headroom(local: Column, best: Column) -> Column:
    """Share of the headroom over ``local`` that ``best`` takes; null at the ceiling."""
    return (best - local) / F.nullif(1 - local, F.lit(0.0))


def pool_ceiling(legs: list[DataFrame], relevant: DataFrame) -> DataFrame:
    """(n_relevant, found, ceiling): recall of the union of all legs' candidates."""
    pool = legs[0].select("query_id", "id")
    for leg in legs[1:]:
        pool = pool.union(leg.select("query_id", "id"))
    marked = relevant.select("query_id", "id").distinct().join(pool.distinct().withColumn("_in", F.lit(1)), ["query_id", "id"], "left")
    return marked.agg(F.count(F.lit(1)).alias("n_relevant"), F.count("_in").alias("found")).withColumn("ceiling", F.col("found") / F.nullif("n_relevant", F.lit(0)))


def evidence_coverage(ranking: DataFrame, evidence: DataFrame, depths: list[int], wanted: DataFrame | None = None) -> DataFrame:
    """For each depth: share of queries with any, with all, and the mean share of their evidence ids found."""
    placed = evidence.distinct().join(ranking.select("query_id", "id", "rank"), ["query_id", "id"]).groupBy("query_id").agg(*[F.count_if(F.col("rank") <= d).alias(f"_{d}") for d in depths])
    counts = _wanted(evidence, wanted).join(placed, "query_id", "left")
    each = counts.select("n_rel", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.coalesce(f"_{d}", F.lit(0)).alias("n")) for d in depths])).alias("d")).select("d.depth", (F.col("d.n") / F.col("n_rel")).alias("share"))
    return each.groupBy("depth").agg(F.avg((F.col("share") > 0).cast("double")).alias("any"), F.avg((F.col("share") == 1).cast("double")).alias("all"), F.avg("share").alias("fraction"))


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum by a hash of the key: the sample is the feature. Short strata raise an error."""
    short = df.groupBy(stratum).count().where(F.col("count") < n)
    if not short.isEmpty():
        raise ValueError(f"a stratum of {stratum} has fewer than {n} rows")
    order = W.partitionBy(stratum).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key)
    return df.withColumn("_n", F.row_number().over(order).cast("long")).where(F.col("_n") <= n).drop("_n")


#: Words, and characters of a word and of a piece that are looked at; a longer word is one unknown piece.
WORD, LONGEST_WORD, LONGEST_PIECE = r"[\p{L}\p{N}_]+", 100, 24


def subword_counts(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, pieces): pieces of each distinct ``words`` (word), cut greedily by the longest piece of ``vocabulary``
    (piece), in which ``##`` marks pieces inside a word. 0 where some place has no piece: the whole word is unknown.

    All parts of a word that are pieces are found by one join, whose vocabulary side is broadcast if it is small; the
    cutting then walks the longest ones of each place, which are as many as the word has characters.
    """
    some = words.where((F.col("word") != "") & (F.length("word") <= LONGEST_WORD)).select("word").distinct()
    places = some.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    parts = places.select("word", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_PIECE), F.length("word") - F.col("at") + 1))).alias("size"))
    named = parts.withColumn("piece", F.concat(F.when(F.col("at") > 1, "##").otherwise(""), F.col("word").substr(F.col("at"), F.col("size"))))
    longest = named.join(small(vocabulary.select("piece").distinct()), "piece").groupBy("word", "at").agg(F.max("size").alias("size"))
    sizes = longest.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("at", "size"))).alias("sizes"))
    start = F.struct(F.lit(1).alias("next"), F.lit(0).alias("n"))

    def step(s, at):
        size = F.try_element_at(F.col("sizes"), at)
        here = s["next"] == at
        return F.struct(F.when(here, at + F.coalesce(size, F.lit(LONGEST_WORD + 1))).otherwise(s["next"]).alias("next"), (s["n"] + here.cast("int")).alias("n"))

    cut = F.aggregate(F.sequence(F.lit(1), F.length("word")), start, step)
    known = sizes.withColumn("c", cut).select("word", F.when(F.col("c.next") == F.length("word") + 1, F.col("c.n")).otherwise(0).alias("pieces"))
    return words.select("word").distinct().join(known, "word", "left").select("word", F.coalesce("pieces", F.lit(0)).alias("pieces"))


def oov_rates(docs: DataFrame, by: str, vocabulary: DataFrame, least: int = 2, budget: float | None = None, seed: str = "oov-1") -> DataFrame:
    """(by, n_types, rate): the share of a group's distinct words that are cut into ``least`` pieces or more, of ``docs``
    (by, id, text). With ``budget`` only that many words of each group count, drawn by a hash of their places, as larger
    corpora have more rare words."""
    words = docs.select(by, "id", F.posexplode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))).alias("at", "word"))
    if budget is not None:
        share = words.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).select(F.col(by).alias("_by"), (F.lit(budget) / F.col("_n")).alias("_share"))
        drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "id", "at")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
        words = words.join(F.broadcast(share), F.col(by).eqNullSafe(F.col("_by"))).where(drawn < F.col("_share"))
    types = words.select(by, "word").distinct()
    counts = subword_counts(types, vocabulary)
    return types.join(counts, "word").groupBy(by).agg(F.count(F.lit(1)).alias("n_types"), F.avg((F.col("pieces") >= least).cast("double")).alias("rate"))
