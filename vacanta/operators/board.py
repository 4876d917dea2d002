"""Views of the stored roles: what the board shows, in which order, with which counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacanta.functions import pay
from vacanta.functions.text import blank, first_of
from vacanta.operators.history import LIVE_DAYS, SETTLED, with_state

#: States of an application that runs, and of one that ended.
IN_FLIGHT = ["applied", "submitted", "interviewing", "offer"]
CLOSED_OUT = ["rejected", "withdrawn", "closed"]
GOOD_FIT = 70
THIN_CHARS = 200
#: Flags that are worth a word on the board.
CAVEATS = ["not screened", "listing only", "not compared", "sponsor"]


def board(roles: DataFrame, states: DataFrame, artifacts: DataFrame, days: int = LIVE_DAYS) -> DataFrame:
    """Roles with status and note, and live, is_new, has_artifact and shown: live, acted on, or with a document."""
    newest = roles.agg(F.max("last_seen").alias("_newest"))
    docs = artifacts.select("uid").distinct().withColumn("has_artifact", F.lit(True))
    rows = with_state(roles, states).join(docs, "uid", "left").crossJoin(F.broadcast(newest))
    live = F.col("last_seen") >= F.date_sub("_newest", days)
    out = rows.withColumns({"live": live, "is_new": F.col("first_seen") == F.col("_newest"), "has_artifact": F.coalesce("has_artifact", F.lit(False))})
    return out.withColumn("shown", F.col("live") | (F.col("status") != "new") | F.col("has_artifact")).drop("_newest")


def new_in_run(roles: DataFrame, runs: int) -> DataFrame:
    """Roles that the run after so many was the first to see; the first run of all has none."""
    return roles.filter((F.col("first_run") == runs + 1) & F.lit(runs > 0))


def listing(rows: DataFrame, status: str | None = None, new: bool = False, every: bool = False) -> DataFrame:
    """Rows of board() as the list shows them: of one status, or not settled; new ones, or those shown; all of them on demand."""
    if status:
        rows = rows.filter(F.col("status") == status)
    elif not every:
        rows = rows.filter(~F.col("status").isin(*SETTLED))
    return rows.filter("is_new") if new else rows if every else rows.filter("shown")


def first_rows(rows: DataFrame, k: int) -> DataFrame:
    """The first k rows of a list: a report."""
    return rows.orderBy(*by_score(), "uid").limit(k)


def view(rows: DataFrame, name: str, sectors: list[str] = (), modes: list[str] = (), country: str = "", city: str = "") -> DataFrame:
    """Rows of a tab (open, pay, new, live, closed, fit, all) in these facets."""
    tabs = {
        "all": F.lit(True), "open": ~F.col("status").isin(*SETTLED), "pay": F.col("salary_confirmed"), "new": F.col("is_new"), "live": F.col("status").isin(*IN_FLIGHT),
        "closed": F.col("status").isin(*CLOSED_OUT), "fit": F.coalesce("fit", F.lit(-1)) >= GOOD_FIT,
    }
    rows = rows.filter(tabs[name])
    for column, values in (("sector", sectors), ("work_mode", modes), ("country", [country] if country else []), ("city", [city] if city else [])):
        if values:
            rows = rows.filter(F.col(column).isin(*values))
    return rows


def tier() -> Column:
    """Running applications first, settled ones last."""
    return F.when(F.col("status").isin(*IN_FLIGHT), 0).when(F.col("status").isin(*SETTLED), 2).otherwise(1)


def by_score() -> list[Column]:
    return [F.desc("score"), F.lower("company")]


def by_rank() -> list[Column]:
    return [tier(), F.desc("score")]


def by_fit() -> list[Column]:
    return [tier(), F.desc(F.coalesce("fit", F.lit(-1))), F.desc("score")]


def top_fit(rows: DataFrame, k: int = 12) -> DataFrame:
    """The k best judged roles: a report of k rows."""
    return rows.filter(F.coalesce("fit", F.lit(-1)) >= 0).orderBy(F.desc("fit"), F.desc("score"), "uid").limit(k)


def header(rows: DataFrame) -> DataFrame:
    """One row of counts."""
    s = F.col("status")
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("salary_confirmed").alias("paid"), F.count_if(s.isin(*SETTLED)).alias("settled"), F.count_if("is_new").alias("fresh"),
        F.count_if(s.isin(*IN_FLIGHT)).alias("in_flight"), F.count_if(s.isin(*CLOSED_OUT)).alias("closed_out"), F.count_if(F.coalesce("fit", F.lit(-1)) >= GOOD_FIT).alias("good_fit"),
    )


def facets(rows: DataFrame) -> DataFrame:
    """facet (sector, mode, country, city), name and n; one pass with a grouping set for each."""
    names = {"sector": first_of(F.col("sector"), F.lit("other")), "mode": first_of(F.col("work_mode"), F.lit("unstated")), "country": first_of(F.col("country"), F.lit("unknown")), "city": blank(F.col("city"))}
    plain = rows.select(*(c.alias(n) for n, c in names.items()))
    sets = plain.groupingSets([[n] for n in names], *names).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 7, "sector").when(F.col("g") == 11, "mode").when(F.col("g") == 13, "country").otherwise("city")
    return sets.select(facet.alias("facet"), F.coalesce(*names).alias("name"), "n").filter("facet <> 'city' OR name <> ''")


def ordered_facets(rows: DataFrame) -> DataFrame:
    """facets() with place: the most frequent names of each facet first, then by name. As many rows as there are names meet for a facet."""
    return facets(rows).withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "name")))


def latest_artifacts(artifacts: DataFrame) -> DataFrame:
    """The last artifact of each role and kind by id."""
    return artifacts.groupBy("uid", "kind").agg(F.max_by(F.struct(*artifacts.columns), "id").alias("_last")).select("_last.*")


def failed_gates(gates: Column) -> Column:
    """Names of the gates that failed; one that never ran (null) did not fail."""
    return F.array_sort(F.map_keys(F.map_filter(gates, lambda _, ok: ~F.coalesce(ok, F.lit(True)))))


def caveats(flags: Column) -> Column:
    return F.filter(flags, lambda f: F.exists(F.array(*map(F.lit, CAVEATS)), lambda c: f.contains(c)))


def composition(kept: DataFrame, keyword_platforms: list[str], k: int = 4) -> tuple[DataFrame, DataFrame]:
    """Counts of employer boards and keyword leads, and the k sectors with most roles."""
    lead = F.col("platform").isin(*keyword_platforms)
    totals = kept.agg(F.count_if(~lead).alias("boards"), F.count_if(lead).alias("leads"))
    return totals, kept.groupBy(first_of(F.col("sector"), F.lit("untagged")).alias("sector")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sector").limit(k)


def summary(results: DataFrame, postings: DataFrame) -> DataFrame:
    """One row for a scan: sources that answered, sources with nothing, postings, kept and new ones."""
    a = results.agg(F.count(F.lit(1)).alias("sources"), F.count_if("ok").alias("ok"), F.count_if(F.col("ok") & (F.coalesce("n", F.lit(0)) == 0)).alias("empty"), F.array_sort(F.collect_set(F.when(F.col("throttled"), F.col("company")))).alias("throttled"))
    b = postings.agg(F.count(F.lit(1)).alias("postings"), F.count_if("kept").alias("matching"), F.count_if(F.col("kept") & F.col("is_new")).alias("new"))
    return a.crossJoin(b)


def exported(rows: DataFrame, artifacts: DataFrame) -> DataFrame:
    """uid and json of each role, its artifacts nested in order of id, reasons and flags as lists."""
    docs = artifacts.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "kind", "path", "rating", "gates")), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)), lambda a: F.struct(a["kind"].alias("kind"), a["path"].alias("path"), a["rating"].alias("rating"), a["gates"].alias("gates"))).alias("artifacts"))
    joined = rows.join(docs, "uid", "left").withColumn("artifacts", F.coalesce("artifacts", F.array()))
    return joined.select("uid", F.to_json(F.struct(*joined.columns)).alias("json"))


def results(kept: DataFrame) -> DataFrame:
    """is_new and json of each kept posting, with its uid and pay label."""
    labelled = kept.withColumn("salary_label", pay.label(F.col("salary")))
    return labelled.select("is_new", "uid", F.to_json(F.struct(*(c for c in labelled.columns if c != "is_new"))).alias("json"))


def write_results(kept: DataFrame, path: str) -> None:
    """A folder of JSON lines for new and for known postings each."""
    results(kept).select("is_new", F.col("json").alias("value")).write.mode("overwrite").partitionBy("is_new").text(path)


def digest_lines(kept: DataFrame) -> DataFrame:
    """uid and the lines of a text digest."""
    line = F.format_string("- **[%s](%s)** · %s · %s · %s · score %.0f", "title", "url", "company", first_of(F.col("location"), F.lit("location not stated")), pay.label(F.col("salary")), "score")
    flags = F.when(F.size("flags") > 0, F.concat(F.lit("\n  - flags: "), F.array_join("flags", "; "))).otherwise("")
    return kept.select("uid", F.concat(line, flags).alias("text"))


def write_digest(kept: DataFrame, path: str) -> None:
    kept_lines = digest_lines(kept).join(kept.select("uid", "score", "company"), "uid").orderBy(F.desc("score"), F.lower("company"), "uid")
    kept_lines.select(F.col("text").alias("value")).write.mode("overwrite").text(path)


def verdicts(screens: DataFrame, roles: DataFrame) -> DataFrame:
    """Screening verdicts (uid, verdict): that of a role with a thin description becomes NEEDS_THE_ADVERT, unless it says so."""
    thin = F.length(F.trim(blank(F.col("description")))) < THIN_CHARS
    joined = screens.join(roles.select("uid", "description"), "uid", "left")
    return joined.withColumn("verdict", F.when(thin & ~F.upper(blank(F.col("verdict"))).startswith("NEEDS"), "NEEDS_THE_ADVERT").otherwise(F.col("verdict"))).drop("description")


def orphans(states: DataFrame, artifacts: DataFrame, roles: DataFrame) -> DataFrame:
    """Keys of states and artifacts that have no role."""
    keys = states.select(F.lit("state").alias("kind"), "uid").unionByName(artifacts.select(F.lit("artifact").alias("kind"), "uid"))
    return keys.join(roles.select("uid"), "uid", "left_anti").groupBy("kind", "uid").agg(F.count(F.lit(1)).alias("n"))
