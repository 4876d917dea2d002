"""Pages of one board's answer as one list of postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacanta.functions.text import blank, first_of
from vacanta.tables import first_wins

FULL_PAGE = 10


def items(pages: DataFrame, path: str) -> DataFrame:
    """source_key, term, page, place and item (JSON) of landed pages (source_key, term, page, payload); path is that of the list."""
    return pages.select("source_key", "term", "page", F.posexplode(F.from_json(F.get_json_object("payload", path), "array<string>")).alias("place", "item"))


def merge_searches(pages: DataFrame) -> DataFrame:
    """Search boards: each posting once, by path or else title, the first over terms and pages; and the greatest total told."""
    key = first_of(F.get_json_object("item", "$.externalPath"), F.get_json_object("item", "$.title"))
    once = first_wins(items(pages, "$.jobPostings").withColumn("key", key).filter("key <> ''"), ["source_key", "key"], ["term", "page", "place"])
    total = pages.groupBy("source_key").agg(F.max(F.get_json_object("payload", "$.total").try_cast("long")).alias("total"))
    return once.join(total, "source_key").select("source_key", "key", "item", "total")


def merge_widgets(pages: DataFrame, embedded: DataFrame) -> DataFrame:
    """Widget boards: each posting once by its number or link; boards for which no page gave any keep the rows in their page."""
    key = first_of(*(F.get_json_object("item", f"$.{k}") for k in ("jobSeqNo", "jobId", "applyUrl")))
    once = first_wins(items(pages, "$.refineSearch.data.jobs").withColumn("key", key).filter("key <> ''"), ["source_key", "key"], ["term", "page", "place"]).select("source_key", "key", "item")
    own = items(embedded, "$.data.jobs").withColumn("key", key).select("source_key", "key", "item")
    return once.unionByName(own.join(once.select("source_key").distinct(), "source_key", "left_anti"))


def concatenated(pages: DataFrame, marker: str = 'search-result-job-title"') -> DataFrame:
    """Result pages in order, up to the first that has none or fewer than ten results; that one is the last."""
    n = (F.length(blank(F.col("payload"))) - F.length(F.replace(blank(F.col("payload")), F.lit(marker), F.lit("")))) / len(marker)
    counted = pages.select("source_key", "page", n.cast("int").alias("n"), "payload")
    stop = counted.groupBy("source_key").agg(F.min(F.when(F.col("n") < FULL_PAGE, F.struct("page", "n"))).alias("stop"))
    kept = counted.join(stop, "source_key").filter(F.col("stop").isNull() | (F.col("page") < F.col("stop.page")) | ((F.col("page") == F.col("stop.page")) & (F.col("n") > 0)))
    return kept.select("source_key", "page", "n", "payload")
