"""Reading level of each document (problem 9).

Method: the words of the corpus are ranked by frequency; the coverage rank of a document is the size of the smallest
such vocabulary that covers a fixed share of its words. Coverage ranks and the complexity of the sentences are
calibrated against rated documents. All of it is SQL over the whole corpus; the driver sees only the size of the
vocabulary, the rated rows of the fit (bounded) and the sums of the regression.

Sentences count once however often they are repeated, and line ends, list marks and colons end a sentence like a
full stop does, so that neither layout nor a repeated caption moves the level; letters have no case.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheafline.session import cut, top_and_rest

#: Shares of a document's words that the vocabulary must cover.
SHARES = (0.5, 0.7, 0.9)
#: Words broadcast with their ranks; the rest of the vocabulary, if there is any, is joined by a shuffle.
HOT_WORDS = 50_000
#: About so many rated documents are used for the fit, those with the lowest hashes of their ids.
FIT_ROWS = 20_000
#: Borders between the bands, each above the band of its number; weight of the band itself in the target of a border, which keeps its score rising with the band on either side.
BORDERS, SLOPE = (1, 2, 3, 4), 0.15
#: What parts words: all but letters and apostrophes, and apostrophes that no letter stands on either side of.
BREAK = r"[^\p{L}'’]+|(?<!\p{L})['’]|['’](?!\p{L})"


def words_of(text: str) -> Column:
    """The words of a text in lower case, in order."""
    return F.array_remove(F.split(F.lower(text), BREAK), "")


def occurrences(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, words (how many the text has), word: a row for each word of each text."""
    return df.select(key, words_of(text).alias("_w")).select(key, F.size("_w").alias("words"), F.explode_outer("_w").alias("word")).where("word is not null")


def ranked(occurring: DataFrame) -> DataFrame:
    """word, total, rank: 1 + the number of words with a higher total (ties share a rank).

    The ranks come from the table of distinct totals, whose size grows only as the root of the corpus, so that no
    window runs over the whole vocabulary.
    """
    totals = cut(occurring.groupBy("word").agg(F.count("*").alias("total")))
    steps = totals.groupBy("total").agg(F.count("*").alias("words"))
    above = F.sum("words").over(Window.orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, -1))
    return totals.join(steps.select("total", (F.coalesce(above, F.lit(0)) + 1).alias("rank")), "total")


def with_ranks(rows: DataFrame, vocabulary: DataFrame, hot: int = HOT_WORDS) -> DataFrame:
    """``rows`` with the rank of each word. Frequent words meet a broadcast of bounded size, since they are the skewed keys; rare ones are shuffled."""
    top, rest = top_and_rest(vocabulary.select("word", "total", "rank"), "total", hot)
    frequent = rows.sparkSession.createDataFrame([(r["word"], r["rank"]) for r in top], "word string, rank long")
    joined = rows.join(F.broadcast(frequent), "word", "left")
    if rest is None:
        return joined
    rare = joined.where(F.col("rank").isNull()).drop("rank").join(rest.select("word", "rank"), "word")
    return joined.where(F.col("rank").isNotNull()).unionByName(rare)


def covers(rows: DataFrame, key: str) -> DataFrame:
    """key, words and for each share the smallest rank such that words of rank up to it make that share of the text's words: a running sum over the ranks of a document."""
    per = rows.groupBy(key, "words", "rank").agg(F.count("*").alias("n"))
    seen = per.withColumn("seen", F.sum("n").over(Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    return seen.groupBy(key).agg(F.max("words").cast("bigint").alias("words"), *(F.min(F.when(F.col("seen") >= F.ceil(F.lit(s) * F.col("words")), F.col("rank"))).alias(f"cover_{round(100 * s)}") for s in SHARES))


def features(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, words, cover_50, cover_70, cover_90 (ranks), letters (a word), sentence (words), letter_share; no row for texts without words."""
    occurring = occurrences(documents, key, text)
    cover = covers(with_ranks(occurring, ranked(occurring)), key)
    parts = F.array_distinct(F.transform(F.split(F.lower(text), r"[.!?;:\n\r•]+"), lambda s: F.trim(F.regexp_replace(s, r"[^\p{L}'’]+", " "))))
    shape = (
        documents.select(key, F.filter(parts, lambda s: s != "").alias("parts"), F.length(F.regexp_replace(text, r"[^\p{L}]", "")).alias("alpha"), F.length(F.regexp_replace(text, r"\s", "")).alias("seen"))
        .where(F.size("parts") > 0)
        .withColumn("joined", F.array_join("parts", " "))
        .select(
            key, (F.length(F.regexp_replace("joined", r"[^\p{L}]", "")) / F.size(F.split("joined", " "))).alias("letters"),
            (F.size(F.split("joined", " ")) / F.size("parts")).alias("sentence"), (F.col("alpha") / F.col("seen")).alias("letter_share"),
        )
    )
    return cover.join(shape, key)


def _inputs() -> list[Column]:
    return [F.lit(1.0), *(F.log1p(F.col(f"cover_{round(100 * s)}")) for s in SHARES), F.col("letters"), F.log1p("sentence")]


def fit(feats: DataFrame, labels: DataFrame, key: str = "doc_id", rows: int = FIT_ROWS) -> list[tuple[list[float], float]]:
    """For each of the four borders between the bands its coefficients and the least score above it.

    The label of a document is the median of its raters, repeated and null ratings left out. The coefficients of a border solve
    the normal equations, whose sums SQL makes in one pass, for whether a document is above it; the least score is the
    middle of the widest stretch of scores with the fewest wrongly placed documents.
    """
    rated = labels.where(F.col("band").isNotNull()).dropDuplicates().groupBy(key).agg(F.percentile("band", F.lit(0.5)).alias("band"))
    x = feats.join(rated, key)
    n_rated = x.count()
    if n_rated > rows:  # a threshold on the hash, not a sort
        x = x.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int((1 << 40) * rows / n_rated))
    cols = _inputs()
    x = cut(x.select("band", *(c.cast("double").alias(f"x{i}") for i, c in enumerate(cols))))
    n = len(cols)
    above = [(F.col("band") >= k + 0.5).cast("double") + SLOPE * F.col("band") for k in BORDERS]
    sums = x.agg(*(F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(n) for j in range(n)), *(F.sum(F.col(f"x{i}") * y) for y in above for i in range(n))).head()
    if sums[0] is None:
        return [([0.0] * n, 1.0)] * len(BORDERS)
    a = np.array(sums[: n * n], dtype=float).reshape(n, n)
    w = np.linalg.solve(a + 1e-6 * a[0, 0] * np.eye(n), np.array(sums[n * n :], dtype=float).reshape(len(BORDERS), n).T)
    rows_ = x.select("band", *(f"x{i}" for i in range(n))).toPandas().to_numpy(dtype=float)
    scores, band = rows_[:, 1:] @ w, rows_[:, 0]
    return [(w[:, i].tolist(), _threshold(scores[:, i], band >= k + 0.5)) for i, k in enumerate(BORDERS)]


def _threshold(score: np.ndarray, above: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    s, a = score[order], above[order].astype(int)
    wrong = np.concatenate([[0], np.cumsum(a)]) + np.concatenate([[0], np.cumsum((1 - a)[::-1])])[::-1]
    ends = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    best = np.flatnonzero(wrong == wrong.min())
    k = max(best, key=lambda i: ends[i + 1] - ends[i])
    return float((ends[k] + ends[k + 1]) / 2)


def reading_levels(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, words, cover_70, score, level (1 to 5) of every document; level and score are null for texts without words (null and empty ones too).

    A language other than that of the ratings gets a level as well, which means little. Repeated rows of a key make
    one row.
    """
    feats = cut(features(documents.select(key, text).where(F.col(text).isNotNull()).dropDuplicates([key]), key, text))
    borders = fit(feats, labels, key)
    margin = [sum((F.lit(a) * c for a, c in zip(w[1:], _inputs()[1:])), F.lit(w[0])) - F.lit(least) for w, least in borders]
    # the border between easy and hard is asked first, so that none of the others can move a document across it
    passed = {k: m >= 0 for k, m in zip(BORDERS, margin)}
    level = F.when(passed[3], F.when(passed[4], 5).otherwise(4)).when(passed[2], 3).when(passed[1], 2).otherwise(1)
    got = feats.withColumn("score", sum(margin[1:], margin[0])).withColumn("level", level)
    return documents.select(key).dropDuplicates().join(got.select(key, "words", "cover_70", "letter_share", "score", "level"), key, "left")


def hard_documents(documents: DataFrame, labels: DataFrame, least_letters: float = 0.6, least_words: int = 5) -> DataFrame:
    """doc_id of the English prose of level 4 or 5; prose has ``least_words`` words and letters for most of its visible characters."""
    english = documents.where(F.col("lang") == "en").select("doc_id").dropDuplicates()
    levels = reading_levels(documents, labels)
    return levels.where((F.col("level") >= 4) & (F.col("letter_share") >= least_letters) & (F.col("words") >= least_words)).join(english, "doc_id", "left_semi").select("doc_id")
