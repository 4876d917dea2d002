"""Role history: keyed upserts, statuses, liveness and the merge of duplicates.

Each operator takes the stored tables and gives the new ones; the caller writes them as a snapshot. Roles are keyed
by uid; statuses hold uid, status, note and updated_at. Null notes and descriptions count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacanta.functions import role

# Statuses, and how far along each is.
PROGRESS = {"new": 0, "skipped": 1, "interested": 2, "applied": 3, "submitted": 4, "closed": 5, "withdrawn": 6, "rejected": 7, "interviewing": 8, "offer": 9}
SETTLED = ["rejected", "withdrawn", "skipped", "closed"]
DESCRIPTION_CHARS = 20_000
LIVE_DAYS = 14


def blank(c: Column | str) -> Column:
    return F.coalesce(c, F.lit(""))


def latest(batch: DataFrame, ordinal: list[str], key: str = "uid") -> DataFrame:
    """The last row of each key by the ordinal, which has no equals."""
    return batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(*ordinal)).alias("_last")).select("_last.*")


def upsert(stored: DataFrame, batch: DataFrame, seen: Column, run: Column, key: str = "uid") -> DataFrame:
    """Roles after a run. batch has one row for each key and no first_seen, first_run or last_seen.

    first_seen and first_run stay; the longer description wins, the new one of equals; pay is replaced only by stated
    pay or where none was stated; all else is overwritten, by nulls too. Columns that only stored has stay as they are, and
    those that only batch has are new. One full outer join on the key.
    """
    s = stored.select(key, F.struct(*stored.columns).alias("s"))
    b = batch.select(key, F.struct(*batch.columns).alias("b"))
    came, was = F.col("b").isNotNull(), F.col("s").isNotNull()

    def value(name: str) -> Column:
        old, new = F.col(f"s.{name}"), F.col(f"b.{name}")
        if name == "description":
            new = F.substring(blank(new), 1, DESCRIPTION_CHARS)
            return F.when(came & (F.length(new) >= F.length(blank(old))), new).otherwise(old)
        if name == "salary":
            return F.when(came & (~was | blank_false(new["confirmed"]) | ~blank_false(old["confirmed"])), new).otherwise(old)
        return F.when(came, new).otherwise(old)

    dated = ("first_seen", "first_run", "last_seen")
    stored_only = [F.col(f"s.{c}").alias(c) for c in stored.columns if c not in batch.columns and c not in dated]
    columns = [(value(c) if c in stored.columns else F.col(f"b.{c}")).alias(c) for c in batch.columns if c != key] + stored_only
    dates = [F.coalesce("s.first_seen", seen).alias("first_seen"), F.coalesce("s.first_run", run).alias("first_run"), F.when(came, seen).otherwise(F.col("s.last_seen")).alias("last_seen")]
    return s.join(b, key, "full_outer").select(key, *columns, *dates)


def blank_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def default_states(states: DataFrame, roles: DataFrame, today: Column, key: str = "uid") -> DataFrame:
    """States with a new row for each role that has none; a second run adds nothing."""
    fresh = roles.select(key).distinct().join(states, key, "left_anti")
    return states.unionByName(fresh.select(key, F.lit("new").alias("status"), F.lit("").alias("note"), today.alias("updated_at")))


def fold_statuses(events: DataFrame, at: list[str], key: str = "uid") -> DataFrame:
    """The last status of each role, the last note that is not blank, and when. An unknown status is an error."""
    order, note = F.struct(*at), F.col("note")
    known = F.when(F.col("status").isin(*PROGRESS), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), blank("status"))))
    return events.groupBy(key).agg(F.max_by(known, order).alias("status"), blank(F.max_by(note, F.when(blank(note) != "", order))).alias("note"), F.max(at[0]).alias("updated_at"))


def with_state(roles: DataFrame, states: DataFrame, key: str = "uid") -> DataFrame:
    """Roles with status ('new' where none is kept) and note."""
    kept = states.select(key, "status", "note")
    return roles.join(kept, key, "left").withColumns({"status": F.coalesce("status", F.lit("new")), "note": blank("note")})


def live(roles: DataFrame, days: int = LIVE_DAYS) -> DataFrame:
    """Roles seen in the days up to the newest sighting of all, with is_new: first seen on that day. The join is with one row."""
    newest = roles.agg(F.max("last_seen").alias("_newest"))
    near = roles.join(F.broadcast(newest), F.col("last_seen") >= F.date_sub("_newest", days))
    return near.withColumn("is_new", F.col("first_seen") == F.col("_newest")).drop("_newest")


def hide_settled(postings: DataFrame, states: DataFrame, key: str = "uid") -> DataFrame:
    return postings.join(states.filter(F.col("status").isin(*SETTLED)).select(key), key, "left_anti")


def split_seen(postings: DataFrame, seen: DataFrame, first_run: bool, key: str = "uid") -> DataFrame:
    """postings with is_new: the key is not in seen. The first run of all reports nothing as new."""
    known = seen.select(key).distinct().withColumn("_seen", F.lit(True))
    return postings.join(known, key, "left").withColumn("is_new", F.col("_seen").isNull() & F.lit(not first_run)).drop("_seen")


def record_seen(seen: DataFrame, batch: DataFrame, today: Column, key: str = "uid") -> DataFrame:
    """key, first_seen and last_seen after a run."""
    now = batch.select(key, today.alias("first_seen"), today.alias("last_seen"))
    return seen.select(key, "first_seen", "last_seen").unionByName(now).groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def import_seen(seen: DataFrame, legacy: DataFrame, key: str = "uid") -> DataFrame:
    """The seen-set with rows of an older one (same columns) for keys that it lacks; a second import adds nothing."""
    fresh = legacy.select(*seen.columns).dropDuplicates([key]).join(seen.select(key), key, "left_anti")
    return seen.unionByName(fresh)


def prune_seen(seen: DataFrame, today: Column, days: int = 180) -> DataFrame:
    return seen.filter(F.col("last_seen") >= F.date_sub(today, days))


def order_of(key: str) -> Column:
    """The order of choice among equals, least first: the most direct, then stated pay, then the longest description, then the key."""
    return F.struct((-role.directness(F.col("platform"))).alias("direct"), (~blank_false(F.col("salary.confirmed"))).alias("unpaid"), (-F.length(blank("description"))).alias("long"), F.col(key).alias("key"))


def keepers(roles: DataFrame, key: str = "uid") -> DataFrame:
    """key, keep and chosen for each role: the role of its company and title that stays, and its place in the order of choice, a struct.

    The role that stays is an aggregate, partly taken before the shuffle, so a group of any size is never sorted or held.
    Roles without company or title stay themselves.
    """
    group = [F.lower(F.trim("company")).alias("k_company"), F.lower(F.trim("title")).alias("k_title")]
    placed = roles.select(key, *group, order_of(key).alias("chosen"))
    best = placed.filter("k_company IS NOT NULL AND k_title IS NOT NULL").groupBy("k_company", "k_title").agg(F.min("chosen").getField("key").alias("keep"))
    return placed.join(best, ["k_company", "k_title"], "left").select(key, F.coalesce("keep", F.col(key)).alias("keep"), "chosen")


def merge_states(chosen: DataFrame, states: DataFrame, key: str = "uid") -> DataFrame:
    """States of the roles that stay (chosen is of keepers()): the status furthest along of the group, the first of equals.

    A note moves with a status that goes beyond all before it in the order of choice, the last such note that is not
    blank; else the role's own note stays, else the first one of the group. Only roles that someone acted on move.
    Each status keeps its first role and its first note on the way, and there are only as many as statuses, so groups
    are aggregated in part before the shuffle and nothing of a group is sorted.
    """
    far = F.coalesce(*(F.when(F.col("status") == k, F.lit(v)) for k, v in PROGRESS.items()), F.lit(0))
    own, said = F.col("keep") == F.col(key), F.when(blank("note") != "", F.col("note"))
    known = chosen.join(states, key).withColumns({"far": far, "own": own, "said": said}).filter("status <> 'new' OR own")
    # Of the roles of one status only the first in the order of choice can go beyond all before it.
    first = known.groupBy("keep", "status", "far").agg(F.min_by(F.struct("chosen", "own", "said"), "chosen").alias("first"), F.min_by("said", F.when(F.col("said").isNotNull(), F.col("chosen"))).alias("spoken"), F.min(F.when(F.col("said").isNotNull(), F.col("chosen"))).alias("spoken_at"), F.max("updated_at").alias("updated_at"))
    steps = F.array_sort(F.collect_list(F.struct("first.chosen", "far", "first.own", "first.said")))
    # Statuses in the order of their first roles: a step goes further if its status is beyond all before.
    start = F.struct(F.lit(0).alias("far"), F.lit(None).cast("string").alias("note"))

    def step(done: Column, x: Column) -> Column:
        further = ~x["own"] & (x["far"] > done["far"])
        return F.struct(F.greatest(done["far"], x["far"]).alias("far"), F.when(further, F.coalesce(x["said"], done["note"])).otherwise(done["note"]).alias("note"))

    best = F.max_by("status", F.struct("far", F.struct((-F.col("first.chosen.direct")).alias("d"), (~F.col("first.chosen.unpaid")).alias("u"), (-F.col("first.chosen.long")).alias("n"))))
    moved = F.aggregate(steps, start, step)["note"]
    return first.groupBy(F.col("keep").alias(key)).agg(best.alias("status"), F.coalesce(moved, F.min_by("spoken", "spoken_at"), F.lit("")).alias("note"), F.max("updated_at").alias("updated_at"))


def merge_duplicates(roles: DataFrame, states: DataFrame, artifacts: DataFrame, key: str = "uid") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roles, states, artifacts) with one role for each company and title; artifacts move to the role that stays."""
    chosen = keepers(roles, key)
    left = roles.join(chosen.filter(F.col("keep") == F.col(key)).select(key), key, "left_semi")
    moved = artifacts.join(chosen.select(key, "keep"), key, "left").withColumn(key, F.coalesce("keep", key)).drop("keep")
    return left, merge_states(chosen, states, key), moved
