"""Score of a posting, 0 to 100, with its reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacanta.functions import pay, place, role

STRETCH = "a stretch: this sits well above the titles you asked for"


def title_reading(title: Column, wanted: list[str]) -> Column:
    """struct<wanted, level>: what a score reads of a title."""
    return F.struct(place.has(F.coalesce(title, F.lit("")), role.whole_words(wanted)).alias("wanted"), role.seniority(title).alias("level"))


def score(postings: DataFrame, wanted: list[str], band: tuple[int, int], home: list[str], relocate: list[str], floor: float, currency: str, today: Column) -> DataFrame:
    """postings (with salary, countries, scope, remote, flags and posted_at) with score, reasons and flags.

    band is the least and greatest level of the wanted titles, 0 where none has one. Nulls count as not said.
    title_read, where it is there, is title_reading() of the title.
    """
    found, scope = F.col("countries"), F.col("scope")
    at_home, moved = F.array_intersect(found, F.array(*map(F.lit, home))), F.array_intersect(found, F.array(*map(F.lit, relocate)).cast("array<string>"))
    scoped = F.arrays_overlap(scope, F.array(*map(F.lit, home)))
    remote = F.coalesce("remote", F.lit(False))
    read = F.col("title_read") if "title_read" in postings.columns else title_reading(F.col("title"), wanted)
    title = read["wanted"]

    def named(before: str, c: Column, after: str = "") -> Column:
        return F.concat(F.lit(before), F.array_join(F.array_sort(c), ", "), F.lit(after))

    nowhere = remote & (F.size(found) == 0)
    here = (
        F.when(F.size(at_home) > 0, F.struct(F.lit(20).alias("n"), F.when(remote, named("remote in ", at_home)).otherwise(named("in ", at_home)).alias("why")))
        .when(nowhere & scoped, F.struct(F.lit(20).alias("n"), named("remote, body says ", scope).alias("why")))
        .when(nowhere & (F.size(scope) > 0), F.struct(F.lit(0).alias("n"), named("remote but restricted to ", scope).alias("why")))
        .when(nowhere, F.struct(F.lit(20).alias("n"), F.lit("remote, no country named").alias("why")))
        .when(F.size(moved) > 0, F.struct(F.lit(8).alias("n"), named("in ", moved, ", relocation").alias("why")))
    )
    s = F.col("salary")
    stated = F.coalesce(s["confirmed"], F.lit(False))
    like = ~F.coalesce(s["currency"] != currency, F.lit(False)) if currency else F.lit(True)
    ample = stated & like & F.coalesce(pay.annualised(s) >= floor * 1.15, F.lit(False)) if floor else F.lit(False)
    age = F.date_diff(today, F.col("posted_at"))
    level = read["level"]
    above, below = level - band[1], band[0] - level
    judged = (level > 0) & F.lit(band[1] > 0)
    stretch = judged & (above >= 2)

    def points(when: Column, n: int) -> Column:
        return F.when(when, n).otherwise(0)

    clean = F.size(F.coalesce("flags", F.array().cast("array<string>"))) == 0
    total = (
        points(title, 35) + F.coalesce(F.col("_here.n"), F.lit(0)) + points(stated & like, 10) + points(stated & ~like, 4) + points(ample, 10)
        + F.when(age <= 7, 15).when(age <= 21, 8).otherwise(0) + points(clean, 10)
        - F.when(judged & (above >= 2), 25).when(judged & (above == 1), 8).when(judged & (below >= 2), 15).otherwise(0)
    )
    why = F.array_compact(
        F.array(
            F.when(title, "title matches your targets"),
            F.col("_here.why"),
            F.when(stated & like, F.concat(F.lit("pay stated ("), s["raw"], F.lit(")"))).when(stated, F.concat(F.lit("pay stated ("), s["raw"], F.lit("), not comparable to your floor"))),
            F.when(ample, "comfortably above your floor"),
            F.when(~stated, "unconfirmed salary"),
            F.when(age <= 7, F.lit("posted this week")).when(age <= 21, F.concat(F.lit("posted "), age.cast("string"), F.lit(" days ago"))),
            F.when(stretch, F.concat(F.lit("reads "), above.cast("string"), F.lit(" levels above your targets"))).when(judged & (above == 1), "a level above your targets").when(judged & (below >= 2), F.concat(F.lit("reads "), below.cast("string"), F.lit(" levels below your targets"))),
        )
    )
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    marked = F.when(stretch, F.concat(flags, F.array(F.lit(STRETCH)))).otherwise(flags)
    placed = postings.withColumn("_here", here)
    return placed.withColumns({"score": F.greatest(F.least(total, F.lit(100)), F.lit(0)).cast("double"), "reasons": why, "_flags": marked}).withColumn("flags", F.col("_flags")).drop("_here", "_flags")


def ordered(scored: DataFrame, ordinal: list[str]) -> DataFrame:
    """The best first, then by company, then in input order."""
    return scored.orderBy(F.desc("score"), F.lower("company"), *ordinal)
