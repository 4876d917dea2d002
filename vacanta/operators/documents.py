"""Checks of documents: keywords, countable signals, job titles, specifics without a source, gates.

All of it is made inside a row from the text alone, so a table of documents is read once and nothing is shuffled.
Null texts count as empty.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacanta.functions import words as W
from vacanta.functions.place import let
from vacanta.functions.text import blank
from vacanta.operators import phrases

TOP_KEYWORDS = 40
TOP_TITLES = 12
MOST_UNSOURCED = 12


def all_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def counted(items: Column) -> Column:
    """The distinct items as structs item, n and first (place): a sort and the borders between equals, inside the row."""
    placed = F.array_sort(F.transform(items, lambda t, i: F.struct(t.alias("item"), i.alias("first"))))

    def runs(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda _, i: i), lambda i: (i == 0) | (F.get(s, i)["item"] != F.get(s, i - 1)["item"]))
        return let(begins, lambda b: F.transform(b, lambda p, i: F.struct(F.get(s, p)["item"].alias("item"), (F.coalesce(F.get(b, i + 1), F.size(s)) - p).alias("n"), F.get(s, p)["first"].alias("first"))))

    return let(placed, runs)


def keywords(text: Column, top: int = TOP_KEYWORDS) -> Column:
    """The most frequent words as structs item and n, first found first among equals; words that say nothing are left out."""
    tokens = F.transform(all_of(F.lower(blank(text)), W.TOKEN), lambda t: F.btrim(t, F.lit(".-")))
    # A list of literals is a hash set in the plan, so a look-up costs the same however long the list; only what is left is sorted.
    dull = list(dict.fromkeys(W.STOP + W.FILLER))
    kept = counted(F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(dull)))
    order = F.array_sort(F.transform(kept, lambda x: F.struct((-x["n"]).alias("less"), x["first"].alias("first"), x["item"].alias("item"))))
    return F.transform(F.slice(order, 1, top), lambda x: F.struct(x["item"].alias("item"), (-x["less"]).alias("n")))


def keyword_match(text: Column, wanted: Column, top: int = TOP_KEYWORDS) -> Column:
    """struct<considered, matched, missing, pct>: the keywords of one text that stand in another."""

    def judged(keys: Column, low: Column) -> Column:
        found = F.filter(keys, lambda k: F.rlike(low, F.concat(F.lit(r"(?U)\b\Q"), k, F.lit(r"\E\b"))))
        pct = F.when(F.size(keys) == 0, F.lit(0.0)).otherwise(F.bround(100 * F.size(found) / F.size(keys), 0))
        return F.struct(F.size(keys).alias("considered"), found.alias("matched"), F.array_except(keys, found).alias("missing"), pct.cast("int").alias("pct"))

    return let(F.transform(keywords(wanted, top), lambda x: x["item"]), lambda keys: let(F.lower(blank(text)), lambda low: judged(keys, low)))


def percent(part: Column, of: Column) -> Column:
    return F.when(of == 0, F.lit(0.0)).otherwise(F.bround(100 * part / of, 0)).cast("int")


def any_of(low: Column, names: list[str]) -> Column:
    """Whether a text holds one of the names: searched as strings, which takes a small part of what a pattern of all of them takes."""
    return reduce(or_, (low.contains(n) for n in names if not any(m in n for m in names if m != n)))


def signals(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with words, pages, bullets, metric and verb shares, sections, contact, years, dashes and filler terms."""
    lines = F.filter(F.transform(F.split(blank(F.col(text)), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    # Pulled out as columns, so that each is made once for all the counts that follow.
    rows = documents.withColumn("_lines", lines).withColumn("_full", F.array_join("_lines", "\n")).withColumn("_low", F.lower("_full"))
    glyph = F.lit(W.BULLETS)
    marked = F.transform(F.filter("_lines", lambda x: (F.length(x) > 1) & (F.instr(glyph, F.substring(x, 1, 1)) > 0)), lambda x: F.trim(F.ltrim(x, glyph)))
    plain = F.filter("_lines", lambda x: F.length(x).between(40, 400) & ~((F.upper(x) == x) & (F.lower(x) != x)))
    rows = rows.withColumn("_bullets", let(marked, lambda m: F.when(F.size(m) > 0, m).otherwise(plain)))
    metric = F.size(F.filter("_bullets", lambda b: F.lower(b).rlike("(?U)" + W.METRIC)))
    led = F.size(F.filter("_bullets", lambda b: F.regexp_replace(F.lower(F.regexp_extract(b, r"\S+", 0)), "[^a-z]", "").isin(W.VERBS)))
    n, words = F.size("_bullets"), F.regexp_count("_full", F.lit(r"\S+"))
    # A heading of a section holds one of its names, so a text without any of them has no such heading either; names within names need no search.
    missing = F.array_compact(F.array(*(F.when(~any_of(F.col("_low"), names), F.lit(k)) for k, names in W.SECTIONS.items())))
    slop = F.array_sort(F.array_compact(F.array(*(F.when(F.col("_low").contains(w) & F.col("_low").rlike(r"\b" + re.escape(w) + r"\b"), F.lit(w)) for w in W.SLOP))))
    made = {
        "word_count": words, "est_pages": F.bround(words / 500.0, 1), "bullets": n, "with_metric": metric, "metric_pct": percent(metric, n), "verb_led": led, "verb_pct": percent(led, n), "missing_sections": missing,
        "has_email": F.col("_full").contains("@") & F.col("_full").rlike("(?U)" + W.EMAIL), "has_phone": F.col("_full").rlike(W.PHONE), "has_linkedin": F.col("_low").contains("linkedin.com"), "year_tokens": F.regexp_count("_full", F.lit(W.YEAR)),
        "date_ranges": F.regexp_count("_low", F.lit(W.YEARS)), "em_dashes": F.length("_full") - F.length(F.replace("_full", F.lit("—"), F.lit(""))), "slop_terms": slop,
    }
    return rows.withColumns(made).drop("_lines", "_full", "_low", "_bullets")


def titles(text: Column, top: int = TOP_TITLES) -> Column:
    """Job titles of a CV by frequency, then the shorter, then the first; levels before a title go."""
    pattern = "(?im)" + W.TITLE.replace("ROLE_WORD", W.ROLE_WORD)
    found = F.regexp_extract_all(blank(text), F.lit(pattern), F.lit(1))
    tidy = F.transform(found, lambda t: F.regexp_replace(F.btrim(F.lower(F.trim(F.regexp_replace(t, r"\s+", " "))), F.lit(" ,.-")), W.LEVEL_PREFIX, ""))
    fit = F.filter(tidy, lambda t: F.length(t).between(3, 45) & ~t.rlike("^(?:and|the|a) "))
    order = F.array_sort(F.transform(counted(fit), lambda x: F.struct((-x["n"]).alias("less"), F.length(x["item"]).alias("length"), x["first"].alias("first"), x["item"].alias("item"))))
    return F.transform(F.slice(order, 1, top), lambda x: x["item"])


def specifics(text: Column) -> Column:
    """Figures and words of scale, as written."""
    return F.concat(F.transform(all_of(text, "(?U)" + W.FIGURE), lambda t: F.trim(t)), all_of(text, "(?iuU)" + W.SCALE_WORD))


def plain(token: Column) -> Column:
    return F.rtrim(F.replace(F.lower(token), F.lit(","), F.lit("")), F.lit("."))


def unsourced(draft: Column, source: Column, most: int = MOST_UNSOURCED) -> Column:
    """The first specifics of a draft, each once, that its source has nowhere; years and single digits are no claims."""
    known = F.array_union(F.transform(all_of(blank(source), "(?U)" + W.FIGURE), lambda t: plain(F.trim(t))), F.transform(all_of(blank(source), "(?iuU)" + W.SCALE_WORD), lambda t: F.lower(t)))
    claims = F.array_distinct(F.filter(specifics(blank(draft)), lambda t: ~plain(t).rlike(r"^(?:19|20)\d\d$|^\d$")))

    def judged(all_: Column) -> Column:
        # What the source lacks is one difference of sets by hash; few are left, and only these are looked through.
        lacking = F.array_except(F.array_union(F.transform(all_, plain), F.transform(all_, lambda t: F.lower(t))), known)
        return let(lacking, lambda bad: F.filter(all_, lambda t: F.array_contains(bad, plain(t)) & F.array_contains(bad, F.lower(t))))

    return F.slice(let(claims, judged), 1, most)


def overlaps(a: Column, b: Column, n: int = 6) -> Column:
    """Whether two texts share a run of n words."""

    def runs(text: Column) -> Column:
        return let(phrases.words(text), lambda w: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))

    return F.arrays_overlap(runs(a), runs(b))


def gates(documents: DataFrame, body: str = "body", source: str = "source") -> DataFrame:
    """Artifacts (kind, body, source: the text they must agree with) with gates, unsourced and summary made anew.

    Only a cover letter is compared for shared phrases; without a source that gate fails, as it was not measured. A missing
    body fails the one gate that there is.
    """
    text, own = blank(F.col(body)), F.col(source)
    new = documents.withColumn("unsourced", F.when(own.isNotNull(), unsourced(text, own)).otherwise(F.array().cast("array<string>")))
    letter = F.col("kind") == "cover_letter"
    shares = F.when(own.isNull(), True).otherwise(overlaps(blank(own), text))
    entries = F.array_compact(F.array(
        F.struct(F.lit("written").alias("k"), F.lit(True).alias("v")), F.struct(F.lit("no_em_dash").alias("k"), (~text.contains("—")).alias("v")),
        F.when(own.isNotNull(), F.struct(F.lit("unsourced_specifics").alias("k"), (F.size("unsourced") == 0).alias("v"))), F.when(letter, F.struct(F.lit("no_overlap_with_cv").alias("k"), (~shares).alias("v"))),
    ))
    made = F.when(F.col(body).isNull(), F.create_map(F.lit("written"), F.lit(False))).otherwise(F.map_from_entries(entries))
    said = F.when(letter & own.isNull(), "overlap not checked: no CV alongside the letter").when(letter & shares, "shares a phrase with the CV").otherwise("")
    return new.withColumns({"gates": made, "summary": said})


def append(artifacts: DataFrame, new: DataFrame) -> DataFrame:
    """Artifacts with new ones after them; ids go on from the greatest there is."""
    last = artifacts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    return artifacts.unionByName(new.crossJoin(F.broadcast(last)).withColumn("id", F.col("id") + F.col("_last")).drop("_last"))
