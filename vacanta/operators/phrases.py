"""Phrases that two texts share, and words of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacanta.tables import written

#: Fixed value: what a word is, after A-Z are lower-cased.
WORD = "[a-z0-9']+"


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def hashed(w: Column | str, i: Column, n: int) -> Column:
    """A hash of n words from i: no list and no text is made for it."""
    return F.xxhash64(*(F.get(w, i + j) for j in range(n)))


def marks(texts: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, at and mark (hash) of each run of n words."""
    w = texts.select(key, words(F.col(text)).alias("w")).filter(F.size("w") >= n)
    return w.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: hashed("w", i, n))).alias("at", "mark"))


def grams(texts: DataFrame, key: str, text: str, n: int, places: Column | None = None) -> DataFrame:
    """key, at, gram, and the words before and after it (null at an end), for each run of n words, or for those at some places."""
    if places is None:
        w = texts.select(key, words(F.col(text)).alias("w")).filter(F.size("w") >= n)
        every = F.sequence(F.lit(0), F.size("w") - n)
    else:  # no filter, as it would be pushed to before the join that gives the places
        w, every = texts.select(key, words(F.col(text)).alias("w"), places.alias("places")), F.col("places")
    # The grams are made before they are exploded, so that no row carries the whole text.
    each = F.transform(every, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("w", i + 1, n), " ").alias("gram"), F.when(i > 0, F.get("w", i - 1)).alias("before"), F.get("w", i + n).alias("after")))
    return w.select(key, F.explode(each).alias("g")).select(key, "g.*")


def shared_phrases(left: DataFrame, left_key: str, left_text: str, right: DataFrame, right_key: str, right_text: str, n: int = 6) -> DataFrame:
    """left_key, right_key, n_words and phrase: the longest run of n words or more that both texts hold.

    The longest is by characters, then the one that starts first in the left text. Pairs that share none have no row;
    null and empty texts share nothing. Keys are unique in each table. Runs meet by equality of grams, but only where a
    shared run begins or ends, which the words beside the grams tell in the join itself: a passage that many texts share
    gives two rows for each pair of them, however long it is, and a word that is repeated many times gives no row for each
    pair of its places. Grams of the left are made only where their hash is one of the right; that two are equal is told by the grams.
    """
    # Both are written, so that the joins are planned by their size and texts are not shuffled to meet a few places.
    known = written(marks(right, right_key, right_text, n).select("mark").distinct(), "marks")
    places = written(marks(left, left_key, left_text, n).join(known, "mark", "left_semi").groupBy(left_key).agg(F.array_sort(F.collect_list("at")).alias("_places")), "places")
    near = left.select(left_key, left_text).join(places, left_key)
    a, b = grams(near, left_key, left_text, n, F.col("_places")), grams(right, right_key, right_text, n).toDF(right_key, "b_at", "b_gram", "b_before", "b_after")
    # Two texts that both begin here begin a run: a null is no word that goes on.
    begins = ~F.coalesce(F.col("before") == F.col("b_before"), F.lit(False))
    ends = ~F.coalesce(F.col("after") == F.col("b_after"), F.lit(False))
    met = a.join(b, (F.col("gram") == F.col("b_gram")) & (begins | ends)).select(left_key, right_key, "at", (F.col("at") - F.col("b_at")).alias("diagonal"), begins.alias("begins"), ends.alias("ends"))
    line = Window.partitionBy(left_key, right_key, "diagonal").orderBy("at")
    last = F.min(F.when(F.col("ends"), F.col("at"))).over(line.rowsBetween(0, Window.unboundedFollowing))
    runs = met.withColumn("last", last).filter("begins").select(left_key, right_key, F.col("at").alias("first"), (F.col("last") - F.col("at") + n).alias("n_words")).distinct()
    # The words come back from the left text once the runs are known, so no text takes part in the shuffles before.
    text = near.select(left_key, F.col(left_text).alias("_text"))
    phrase = F.array_join(F.slice("w", F.col("first") + 1, F.col("n_words").cast("int")), " ")
    found = runs.join(text, left_key).withColumn("w", words(F.col("_text"))).select(left_key, right_key, "first", "n_words", phrase.alias("phrase"))
    order = F.struct(F.length("phrase").alias("length"), (-F.col("first")).alias("first"))
    return found.groupBy(left_key, right_key).agg(F.max_by(F.struct("n_words", "phrase"), order).alias("best")).select(left_key, right_key, "best.n_words", "best.phrase")
