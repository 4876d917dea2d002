"""Descriptions that arrive after the posting: which postings lack one, filling them in, screening them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacanta.functions import pay, place
from vacanta.functions.text import blank, detail_key, lines_of, posting_number, sections
from vacanta.operators.history import DESCRIPTION_CHARS, SETTLED
from vacanta.operators.screen import Rules, dealbreaker_hits, names

#: Fixed value: platforms whose lists come without descriptions.
EXPANDABLE = ["linkedin", "workday", "smartrecruiters"]
ENOUGH_CHARS = 200
HIDDEN_NOTE = "hidden after its full description was read"


def thin() -> Column:
    return F.length(F.trim(blank(F.col("description")))) < ENOUGH_CHARS


def candidates(rows: DataFrame) -> DataFrame:
    """Rows of board() that a detail page could fill: live, unsettled, of a platform that has such pages, without text."""
    return rows.filter(F.col("live") & ~F.col("status").isin(*SETTLED) & F.col("platform").isin(*EXPANDABLE) & thin())


def page_key(platform: Column, url: Column) -> Column:
    """What a posting's detail page is stored under: LinkedIn's by number, others by link."""
    return F.when(platform == "linkedin", posting_number(url)).otherwise(detail_key(url))


def page_text(platform: Column, payload: Column) -> Column:
    """The description in a landed detail page."""
    block = F.regexp_extract(blank(payload), r'(?s)class="[^"]*description__text[^"]*"[^>]*>(.*?)</section>', 1)
    return F.when(platform == "linkedin", lines_of(block)).when(platform == "smartrecruiters", sections(payload)).otherwise(lines_of(F.get_json_object(payload, "$.jobPostingInfo.jobDescription")))


def fill(roles: DataFrame, pages: DataFrame, currency: str | None = None) -> DataFrame:
    """Roles with the text of their landed page (page_key, platform, payload), of 200 characters or more, in place of a thin one.

    Pay is read from it where none was stated. Roles without a page, or with a poor one, stay as they are.
    """
    texts = pages.select(F.col("page_key").alias("_key"), page_text(F.col("platform"), F.col("payload")).alias("_text")).filter(F.length("_text") >= ENOUGH_CHARS)
    one = texts.groupBy("_key").agg(F.max("_text").alias("_text"))
    wanted = F.when(thin() & F.col("platform").isin(*EXPANDABLE), page_key(F.col("platform"), F.col("url")))
    joined = roles.withColumn("_wanted", wanted).join(one, F.col("_wanted") == F.col("_key"), "left")
    read = joined.withColumn("_pay", F.when(F.col("_text").isNotNull() & ~F.coalesce("salary.confirmed", F.lit(False)), pay.parse(F.col("_text"), F.lit(currency).cast("string"))))
    filled = {"description": F.coalesce(F.substring("_text", 1, DESCRIPTION_CHARS), F.col("description")), "salary": F.when(F.col("_pay.confirmed"), F.col("_pay")).otherwise(F.col("salary"))}
    return read.withColumns(filled).drop("_wanted", "_key", "_text", "_pay")


def rescreen(rows: DataFrame, r: Rules) -> DataFrame:
    """Rows of board() after their text is read again: those that are live, new and long enough and that a hard
    dealbreaker or the floor rules out are closed with a note; the flags of the others lose 'not screened' and gain what
    the text shows."""
    text = F.col("description")
    due = F.col("live") & (F.col("status") == "new") & ~thin()
    verdict = pay.clears_floor(F.col("salary"), r.floor, r.currency)
    fails = due & ((F.size(dealbreaker_hits(text, r, hard_only=True)) > 0) | ~verdict["keep"])
    soft = [F.when(place.has(blank(text), p), F.lit(f"soft flag: {n}")) for n, p, hard in r.dealbreakers if not hard]
    fresh = F.array_compact(F.array(*soft, F.nullif(verdict["why"], F.lit(""))).cast("array<string>"))
    old = F.filter(F.coalesce("flags", names([])), lambda f: ~f.contains("not screened"))
    return rows.withColumns({
        "status": F.when(fails, "closed").otherwise(F.col("status")), "note": F.when(fails, HIDDEN_NOTE).otherwise(F.col("note")),
        "flags": F.when(due & ~fails, F.concat(old, F.array_except(fresh, old))).otherwise(F.col("flags")),
    })


def repaired(roles: DataFrame) -> DataFrame:
    """Roles with links that open."""
    from vacanta.functions.text import repaired_url

    return roles.withColumn("url", repaired_url(F.col("url")))
