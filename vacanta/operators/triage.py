"""Judging roles in batches: which ones, their batches and texts, and the answers that come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacanta.functions.text import blank, first_of, squeezed
from vacanta.operators.history import SETTLED
from vacanta.tables import numbered

BATCH = 20
DIGEST_CHARS = 1200
ENOUGH_CHARS = 200
WHY_CHARS = 400
#: Fixed value: a line that could pass for the head of another role.
HEAD_LINE = r"(?im)^\s*-{2,}\s*(id|role)\s*[:#]"


def judged(fit: Column) -> Column:
    return F.coalesce(fit, F.lit(-1)) >= 0


def long_enough() -> Column:
    return F.length(F.trim(blank(F.col("description")))) >= ENOUGH_CHARS


def candidates(rows: DataFrame, refresh: bool = False) -> DataFrame:
    """Rows of board() that can be judged: live, unsettled, with a description; those judged already only on demand."""
    out = rows.filter(F.col("live") & ~F.col("status").isin(*SETTLED) & long_enough())
    return out if refresh else out.filter(~judged(F.col("fit")))


def unrankable(rows: DataFrame) -> DataFrame:
    """Rows of board() that can't be judged for want of text."""
    return rows.filter(F.col("live") & ~F.col("status").isin(*SETTLED) & ~judged(F.col("fit")) & ~long_enough())


def batches(rows: DataFrame, size: int = BATCH) -> DataFrame:
    """rows with batch (from 0) and pos (from 1), the best score first."""
    n = F.col("number") - 1
    placed = numbered(rows, [F.desc("score"), F.col("uid")])
    return placed.withColumns({"batch": F.floor(n / size).cast("long"), "pos": (n % size + 1).cast("long")}).drop("number")


def digest(company: Column, title: Column, location: Column, label: Column, description: Column, pos: Column) -> Column:
    """The text of one role, numbered by its place in the batch."""
    body = F.substring(squeezed(F.regexp_replace(blank(description), HEAD_LINE, " ")), 1, DIGEST_CHARS)
    head = F.concat_ws(" | ", company, title, first_of(location, F.lit("not stated")), first_of(label, F.lit("unconfirmed salary")))
    return F.concat(F.lit("--- role "), pos.cast("string"), F.lit("\n"), head, F.lit("\n"), body, F.lit("\n"))


def estimate(rows: DataFrame, size: int = BATCH) -> DataFrame:
    """One row: batches, and tokens that they take."""
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.least(F.length(blank(F.col("description"))), F.lit(DIGEST_CHARS)) + 120), F.lit(0)).alias("chars"))
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / size)).cast("long")
    return n.select(count.alias("batches"), F.floor((F.col("chars") + count * 7000) / 4).cast("long").alias("tokens"))


def answers(replies: DataFrame) -> DataFrame:
    """batch, place, pos and fit (null: unreadable) and why, of replies (batch, reply): the list between the first and last bracket."""
    text = blank(F.col("reply"))
    inner = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    items = replies.select("batch", F.posexplode(F.from_json(inner, "array<map<string, string>>")).alias("place", "a")).filter("a IS NOT NULL")
    given = F.when(F.map_contains_key("a", F.lit("role")), F.try_element_at("a", F.lit("role"))).otherwise(F.try_element_at("a", F.lit("id")))
    fit = F.when(F.map_contains_key("a", F.lit("fit")), F.try_element_at("a", F.lit("fit")).try_cast("double")).otherwise(F.lit(0.0))
    whole = F.when(fit < 0, F.ceil(fit)).otherwise(F.floor(fit))
    return items.select("batch", "place", given.try_cast("int").cast("long").alias("pos"), F.when(whole.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), whole))).cast("int").alias("fit"), F.substring(blank(F.try_element_at("a", F.lit("why"))), 1, WHY_CHARS).alias("why"))


def matched(batched: DataFrame, replies: DataFrame) -> DataFrame:
    """uid, fit and why: the first answer for each place counts; one that can't be read uses its place up."""
    order = Window.partitionBy("batch", "pos").orderBy("place")
    first = answers(replies).filter("pos IS NOT NULL").withColumn("turn", F.row_number().over(order)).filter("turn = 1")
    return batched.select("batch", "pos", "uid").join(first, ["batch", "pos"]).filter("fit IS NOT NULL").select("uid", "fit", "why")


def written_back(roles: DataFrame, fits: DataFrame) -> DataFrame:
    """Roles with the new fit and fit_why where there is one."""
    new = fits.select("uid", F.col("fit").alias("_fit"), F.col("why").alias("_why"))
    came = F.col("_fit").isNotNull()
    return roles.join(new, "uid", "left").withColumns({"fit": F.when(came, F.col("_fit")).otherwise(F.col("fit")), "fit_why": F.when(came, F.col("_why")).otherwise(F.col("fit_why"))}).drop("_fit", "_why")
