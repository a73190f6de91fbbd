"""Benchmark decontamination with a distributed positional inverted index.

Training tokens are stored as postings (term, document, position).  A test phrase is
found by intersecting the lists of its rarest terms, each shifted by the term's
offset in the phrase: where all shifted lists agree, the phrase may begin.  The
posting of the rarest term carries the words around it, which settle the rest.
Test phrases come in blocks of bounded size, so what is broadcast has a bound and
the training side is never shuffled by word.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from watchfold.llm.common import written

WINDOW = 13
BLOCK = 40_000  # windows searched at once: the bound of what is broadcast
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _norm(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, joined by single spaces."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    return F.translate(F.trim(plain), _UPPER, _LOWER)


def _words(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def token_store(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, norm): the token streams, written once to the shared folder for all passes."""
    rows = docs.select(F.col(id_col).alias("id"), _norm(F.col(text_col)).alias("norm"))
    return written(rows.select("id", F.size(_words(F.col("norm"))).cast("bigint").alias("n_words"), "norm"), spark, "tokens")


def postings(tokens: DataFrame, terms: DataFrame, around: int = WINDOW - 1) -> DataFrame:
    """(term, id, pos, lo, near): every position of the given terms, with the words from ``lo`` to ``pos + around``.

    ``terms`` (term) must be bounded: it is broadcast, and only its terms leave the scan.
    """
    rows = tokens.where("n_words > 0").select("id", _words(F.col("norm")).alias("words"))
    at = rows.select("id", "words", F.posexplode("words").alias("pos", "word"))
    met = at.join(F.broadcast(terms), F.col("word") == F.col("term"))
    lo = F.greatest(F.col("pos") - around, F.lit(0))
    return met.select("term", "id", "pos", lo.alias("lo"), F.slice("words", lo + 1, F.col("pos") + around + 1 - lo).alias("near"))


def frequencies(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences of the given (bounded) terms in all training text; 0 if there are none."""
    words = tokens.where("n_words > 0").select(F.explode(_words(F.col("norm"))).alias("word"))
    met = words.join(F.broadcast(terms), F.col("word") == F.col("term")).groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(met, "term", "left").select("term", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def test_windows(tests: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(window, phrase, item): each ``width`` consecutive words of an item; a shorter item is one window, an empty one none."""
    words = tests.select(F.col(item_col).alias("item"), _words(_norm(F.col(text_col))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    phrases = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("phrase"))
    return phrases.distinct().select(F.sha2(F.array_join("phrase", " "), 256).alias("window"), "phrase", "item")


def phrase_matches(spark: SparkSession, tokens: DataFrame, windows: DataFrame, lists: int = 2) -> DataFrame:
    """(id, start, length, window): every occurrence of every phrase of ``windows`` (window, phrase), written as a table.

    ``lists`` is the number of rarest terms whose shifted lists are intersected.
    """
    phrases = written(windows.select("window", "phrase").distinct(), spark, "phrases")
    blocks = max(1, -(-phrases.count() // BLOCK))
    found = None
    for block in range(blocks):
        own = phrases.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        spots = own.select("window", F.size("phrase").alias("length"), F.posexplode("phrase").alias("offset", "term"))
        counted = written(frequencies(tokens, spots.select("term").distinct()), spark, "frequencies")
        ranked = spots.join(counted, "term").withColumn(
            "rank", F.row_number().over(Window.partitionBy("window").orderBy("n", "offset"))
        )
        # A phrase with a term that training text lacks occurs nowhere.
        rare = ranked.where(F.col("rank") <= lists)
        live = ranked.groupBy(F.col("window").alias("w")).agg(F.min("n").alias("least"), F.least(F.count("*"), F.lit(lists)).alias("needed"))
        rare = rare.join(live.where("least > 0"), F.col("window") == F.col("w")).join(own.select(F.col("window").alias("p"), "phrase"), F.col("window") == F.col("p"))
        rare = written(rare.select("term", "window", "length", "offset", "rank", "needed", F.when(F.col("rank") == 1, F.col("phrase")).alias("phrase")), spark, "rarest")
        lists_of = postings(tokens, rare.select("term").distinct())
        shifted = lists_of.join(F.broadcast(rare), "term").withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0")
        exact = F.slice("near", F.greatest(F.col("start") - F.col("lo"), F.lit(0)) + 1, F.col("length")) == F.col("phrase")
        shifted = shifted.where(F.col("phrase").isNull() | exact)
        met = shifted.groupBy("id", "window", "start", "length", "needed").agg(F.count_distinct("rank").alias("ranks"))  # rows may repeat an id
        part = met.where("ranks = needed").select("id", "start", "length", "window")
        found = part if found is None else found.union(part)
    return written(found, spark, "phrase-matches")


def proximity_matches(tokens: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """(id, query, pos): places of a query's rarest term that have all its other terms at most ``within`` words away.

    ``queries`` (query, term) must be bounded; it is broadcast.
    """
    counted = frequencies(tokens, queries.select("term").distinct())
    order = Window.partitionBy("query").orderBy("n", "term")
    ranked = queries.distinct().join(counted, "term").withColumn("rank", F.row_number().over(order)).withColumn(
        "terms", F.count("*").over(Window.partitionBy("query"))
    )
    hits = postings(tokens, queries.select("term").distinct(), 0).join(F.broadcast(ranked), "term").select("id", "query", "term", "pos", "rank", "terms")
    first = hits.where("rank = 1").select("id", "query", "pos", "terms")
    other = hits.select(F.col("id").alias("i"), F.col("query").alias("q"), F.col("pos").alias("p"), F.col("rank").alias("r"))
    near = first.join(other, (F.col("id") == F.col("i")) & (F.col("query") == F.col("q")) & (F.abs(F.col("pos") - F.col("p")) <= within))
    met = near.groupBy("id", "query", "pos", "terms").agg(F.count_distinct("r").alias("met"))
    return met.where("met = terms").select("id", "query", "pos")


def contamination(spark: SparkSession, docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", test_col: str = "text", share: int = 20) -> DataFrame:
    """Per document: (id, n_words, n_hit, n_items, items_sha256, contaminated).

    A word inside any occurrence of a test window is hit; a document is contaminated if it
    has hits and ``share * n_hit >= n_words``.  Null and empty texts have no words; an empty
    test table hits nothing; rows repeating an id are one document to the search (hits are
    joined by id) and each get its row; null ids get no hits.  Other columns are ignored.
    """
    tokens = token_store(spark, docs, id_col, text_col)
    windows = written(test_windows(tests, item_col, test_col), spark, "windows")
    found = phrase_matches(spark, tokens, windows)
    order = Window.partitionBy("id").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy("id", "start").agg(F.max("length").alias("length")).select(
        "id", "start", (F.col("start") + F.col("length")).alias("end"), F.max(F.col("start") + F.col("length")).over(order).alias("before")
    )
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("before", F.lit(0))))
    hit = spans.groupBy("id").agg(F.sum(fresh.cast("bigint")).alias("n_hit"))
    items = found.select("id", "window").distinct().join(windows.select("window", "item"), "window").select("id", F.col("item").cast("string").alias("item")).distinct()
    named = items.groupBy("id").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    rows = tokens.select("id", "n_words").join(hit, "id", "left").join(named, "id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return rows.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(spark: SparkSession, docs: DataFrame, tests: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated by ``tests`` (item_id, text)."""
    bad = contamination(spark, docs, tests).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
