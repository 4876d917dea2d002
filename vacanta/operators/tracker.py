"""A hand-kept tracker of applications beside the stored roles, and lookups of roles by what a person types.

Names and links are met by equality of keys, never all with all: the pieces of a short text that could be asked for are
listed, and the join is on those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacanta.functions.text import blank, first_of, spaced_name

SHARED_WORDS = 3


def load(texts: DataFrame, value: str = "value") -> DataFrame:
    """ordinal, org, role, status, date, note and url of a tracker file (a list, or an object with applications); status in lower case."""
    kind = "struct<org: string, role: string, status: string, date: string, note: string, url: string>"
    items = F.coalesce(F.from_json(value, "struct<applications: array<string>>")["applications"], F.from_json(value, "array<string>"))
    each = texts.select(F.posexplode(items).alias("ordinal", "item")).filter(F.col("item").startswith("{")).select("ordinal", F.from_json("item", kind).alias("a"))
    return each.select("ordinal", *(blank(F.col(f"a.{c}")).alias(c) for c in ("org", "role")), F.lower(first_of(F.col("a.status"), F.lit("interested"))).alias("status"), F.col("a.date").alias("date"), *(blank(F.col(f"a.{c}")).alias(c) for c in ("note", "url")))


def plain_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(blank(url)), "/+$", ""), r"[?#].*$", "")


def pieces(name: Column) -> Column:
    """All substrings of a short text, the text itself among them."""
    n = F.length(name)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(name, i, k)))))


def matches(tracker: DataFrame, postings: DataFrame) -> DataFrame:
    """uid and ordinal of every posting (uid, company, title, url) and application that mean one role.

    The links are equal, or the posting's company is part of the application's name and either no role is given, or one
    title holds the other, or they share three words. The pieces of the tracker's names are listed, so its few
    rows meet the postings by equality of names.
    """
    by_url = postings.withColumn("link", plain_url(F.col("url"))).filter("link <> ''").join(tracker.withColumn("link", plain_url(F.col("url"))).filter("link <> ''").select("link", "ordinal"), "link").select("uid", "ordinal")
    orgs = tracker.withColumn("org_name", spaced_name(F.col("org"))).filter("org_name <> ''").select("ordinal", F.col("role").alias("wanted"), F.explode(pieces(F.col("org_name"))).alias("company_name"))
    named = postings.withColumn("company_name", spaced_name(F.col("company"))).filter("company_name <> ''").join(orgs, "company_name")
    a, b = spaced_name(F.col("wanted")), spaced_name(F.col("title"))
    common = F.size(F.array_intersect(F.split(a, " "), F.split(b, " ")))
    alike = (a != "") & (b != "") & (b.contains(a) | a.contains(b) | (common >= SHARED_WORDS))
    return by_url.union(named.filter((F.col("wanted") == "") | alike).select("uid", "ordinal")).distinct()


def annotate(postings: DataFrame, tracker: DataFrame) -> DataFrame:
    """postings with app_status and a flag from the first application that matches."""
    first = matches(tracker, postings).groupBy("uid").agg(F.min("ordinal").alias("ordinal")).join(tracker.select("ordinal", "status", "date", "note"), "ordinal")
    label = F.concat(F.replace("status", F.lit("_"), F.lit(" ")), F.when(blank(F.col("date")) != "", F.concat(F.lit(" on "), "date")).otherwise(""), F.when(F.col("note") != "", F.concat(F.lit(" — "), "note")).otherwise(""))
    known = first.select("uid", F.col("status").alias("app_status"), label.alias("_label"))
    flags = F.coalesce("flags", F.array().cast("array<string>")) if "flags" in postings.columns else F.array().cast("array<string>")
    return postings.join(known, "uid", "left").withColumn("flags", F.when(F.col("_label").isNull(), flags).otherwise(F.concat(flags, F.array("_label")))).drop("_label")


def imported(tracker: DataFrame, roles: DataFrame, states: DataFrame, today: Column) -> DataFrame:
    """States after an import: every role that matches takes the application's status, where its own is new; a second run changes nothing."""
    found = matches(tracker, roles).join(tracker.select("ordinal", "status", "note"), "ordinal")
    last = found.groupBy("uid").agg(F.min_by(F.struct("status", "note"), "ordinal").alias("t"))
    joined = states.join(last, "uid", "full_outer")
    takes = F.col("t").isNotNull() & (F.coalesce("status", F.lit("new")) == "new") & (F.col("t.status") != "new")
    return joined.select("uid", F.when(takes, F.col("t.status")).otherwise(F.coalesce("status", F.lit("new"))).alias("status"), F.when(takes, F.col("t.note")).otherwise(blank(F.col("note"))).alias("note"), F.when(takes, today).otherwise(F.coalesce("updated_at", today)).alias("updated_at"))


def lookup(asked: DataFrame, roles: DataFrame) -> DataFrame:
    """target, how (uid, prefix, url, company or none), n (roles found that way) and uid (if there is just one).

    The first way that finds any role counts. Prefixes and parts have only the lengths that were asked for.
    """
    t = asked.select("target", F.trim("target").alias("t")).distinct()
    exact = t.join(roles.select("uid"), F.col("t") == F.col("uid")).select("target", F.lit(1).alias("way"), "uid")
    short = t.filter(F.col("t").rlike("^[0-9a-f]{6,15}$"))
    prefix = short.withColumn("head", F.substring("t", 1, 6)).join(roles.select("uid", F.substring("uid", 1, 6).alias("head")), "head").filter(F.col("uid").startswith(F.col("t"))).select("target", F.lit(2).alias("way"), "uid")
    links = t.filter(F.col("t").startswith("http")).withColumn("part", F.regexp_replace(F.regexp_replace("t", "/+$", ""), r"[?#].*$", ""))
    # An array of the distinct lengths that were asked for: as many numbers as a link can have characters.
    lengths = F.broadcast(links.agg(F.collect_set(F.length("part")).alias("lengths")))
    heads = roles.select("uid", "url").crossJoin(lengths).select("uid", "url", F.explode("lengths").alias("n")).filter(F.length("url") >= F.col("n")).select("uid", F.substring("url", F.lit(1), F.col("n")).alias("part"))
    by_url = links.join(heads, "part").select("target", F.lit(3).alias("way"), "uid").distinct()
    words = t.filter(~F.col("t").startswith("http")).withColumn("part", F.lower("t")).filter("part <> ''")
    sizes = F.broadcast(words.agg(F.collect_set(F.length("part")).alias("lengths")))
    low = F.lower(blank(F.col("company")))
    parts = roles.select("uid", low.alias("low")).crossJoin(sizes).select("uid", "low", F.explode("lengths").alias("n")).filter(F.length("low") >= F.col("n"))
    parts = parts.select("uid", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - F.col("n") + 1), lambda i: F.substring(F.col("low"), i, F.col("n"))))).alias("part"))
    by_company = words.join(parts, "part").select("target", F.lit(4).alias("way"), "uid")
    found = exact.union(prefix).union(by_url).union(by_company).withColumn("best", F.min("way").over(Window.partitionBy("target"))).filter("way = best")
    one = found.groupBy("target").agg(F.min("way").alias("way"), F.count(F.lit(1)).alias("n"), F.min("uid").alias("uid"))
    how = F.coalesce(F.when(F.col("way") == 1, "uid").when(F.col("way") == 2, "prefix").when(F.col("way") == 3, "url").when(F.col("way") == 4, "company"), F.lit("none"))
    return asked.select("target").distinct().join(one, "target", "left").select("target", how.alias("how"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n") == 1, F.col("uid")).alias("uid"))
