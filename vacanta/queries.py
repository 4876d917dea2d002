"""Queries over postings generated from the star schema, and over the other tables, with DuckDB SQL for each."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta import board_queries, board_view_queries, history_queries, ingest_queries, source_queries
from vacanta.functions import pay, place, role
from vacanta.operators import history
from vacanta.operators import score as scoring
from vacanta.operators import screen as screening
from vacanta.plans import postings as P
from vacanta.tables import written

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
RULES = screening.Rules(P.WANTED, P.EXCLUDED, ["UK", "IE"], ["DE"], True, [], 55000.0, "GBP", [("take home", r"take.home", True), ("weekends", r"\bweekends\b", False)])
#: The rules of screen_gates and drop_report, whose SQL has the limits that the first 3,000 characters of a body state.
NOT_GLASGOW = replace(RULES, places_excluded=["glasgow"], scope_chars=3000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = P.view()
    for name in ("lineitem", "orders", "supplier"):
        sql = sql.replace(f"FROM {name} ", f"FROM {{{name}}} ").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "supplier")})


def paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.with_pay(postings(spark, sf_dir), repeated=True)


def stored(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """What the screen reads of postings, and more columns by name, as a written table, for queries that read them more than once."""
    return written(postings(spark, sf_dir).select(*KEY, "company", "title", "platform", "location", "remote", "description", "pay", *more), "postings")


def read(spark: SparkSession, sf_dir: str, rules: screening.Rules, *more: str) -> DataFrame:
    """The same with the pay, and what the rules read of title and description, each text once."""
    return screening.read(screening.with_pay(stored(spark, sf_dir, *more), repeated=True).drop("pay"), rules)


def posting_keys(spark, sf_dir):
    p = postings(spark, sf_dir)
    return p.select(*KEY, role.uid(F.col("url"), F.col("company"), F.col("title"), F.col("location")).alias("uid"), role.source_key(F.col("url")).alias("source_key"), role.directness(F.col("platform")).alias("directness"), role.safe_url(F.col("link")).alias("safe_url"))


def posting_places(spark, sf_dir):
    p = screening.with_places(postings(spark, sf_dir))
    return p.select(*KEY, F.array_join("countries", ",").alias("countries"), "city", place.posting_country(F.col("tag"), F.col("countries")).alias("country"))


def posting_scope(spark, sf_dir):
    """Countries that a body limits a remote role to."""
    p = postings(spark, sf_dir).select(*KEY, "description")
    return screening.by_distinct(p, {"description": {"scope": place.remote_scope}}).select(*KEY, F.array_join("scope", ",").alias("scope"))


def posting_pay(spark, sf_dir):
    s = F.col("salary")
    return paid(spark, sf_dir).select(*KEY, s["min"].alias("pay_min"), s["max"].alias("pay_max"), s["currency"].alias("currency"), s["period"].alias("period"), s["confirmed"].alias("confirmed"), pay.annualised(s).alias("per_year"), pay.label(s).alias("label"), pay.clears_floor(s, 55000.0, "GBP")["keep"].alias("clears"))


def posting_roles(spark, sf_dir):
    p = postings(spark, sf_dir).select(*KEY, "title", "description")
    mode = lambda d: role.work_mode(F.lit(""), F.lit(""), d, F.lit(None).cast("boolean"))
    return screening.by_distinct(p, {"title": {"level": role.seniority}, "description": {"mode": mode, "rights": role.work_rights}}).select(*KEY, "level", "mode", "rights")


def posting_dedupe(spark, sf_dir):
    p = screening.with_pay(stored(spark, sf_dir), repeated=True)
    return screening.dedupe(p, KEY, RULES.allowed, [*KEY, "company", "title", "platform", "location"]).select(*KEY, "company", "title", "platform", "location", F.array_join("flags", "; ").alias("flags"))


def screen_gates(spark, sf_dir):
    """The gate that drops each posting, and the flags of those kept, with places in Glasgow excluded."""
    s = screening.screen(screening.derive(read(spark, sf_dir, NOT_GLASGOW)), NOT_GLASGOW)
    return s.select(*KEY, F.coalesce("drop_reason", F.lit("")).alias("reason"), F.array_join("flags", "; ").alias("flags"))


def today_of(rows: DataFrame):
    """The greatest posted_at, as a scalar subquery."""
    return rows.agg(F.max("posted_at")).scalar()


def screen_reasons(spark, sf_dir):
    """Counts by drop reason of the whole screen: dedupe, derived columns, gates."""
    p = stored(spark, sf_dir)
    texts, pays = screening.readings(p, RULES), screening.distinct_values(p, "pay", "pay_id", {"salary": pay.parse})
    # Texts and pay go through the dedupe by number; what they say is joined to what it leaves.
    numbered = screening.in_place_of(p, "description", texts, "text_id", "n_chars")
    numbered = screening.in_place_of(numbered, "pay", pays, "pay_id", F.col("salary.confirmed").alias("paid"))
    d = written(screening.dedupe(numbered, KEY, RULES.allowed, ["title", "location", "remote", "pay_id", "text_id"]).drop("flags"), "deduped")
    d = d.join(texts.select("text_id", "read"), "text_id").join(pays.select("pay_id", "salary"), "pay_id")
    d = screening.by_distinct(d, {"title": {"gate": lambda t: screening.title_gate(t, RULES)}})
    return screening.reasons(screening.screen(screening.derive(d), RULES))


def drop_report(spark, sf_dir):
    """The five reasons that most postings are dropped for."""
    return screening.top_reasons(screening.screen(screening.derive(read(spark, sf_dir, NOT_GLASGOW)), NOT_GLASGOW))


def posting_scores(spark, sf_dir):
    """Score of each posting that the screen keeps."""
    p = read(spark, sf_dir, RULES, "posted_at")
    kept = screening.screen(screening.derive(p), RULES).filter("drop_reason IS NULL").withColumn("scope", F.col("read.scope"))
    kept = screening.by_distinct(kept.drop("description"), {"title": {"title_read": lambda t: scoring.title_reading(t, role.title_variants(RULES.wanted))}})
    band = screening.target_band(RULES.wanted, spark)
    done = scoring.score(kept, role.title_variants(RULES.wanted), band, RULES.countries, RULES.relocate_to, RULES.floor, RULES.currency, today_of(p))
    return done.select(*KEY, "score", F.size("reasons").cast("long").alias("n_reasons"), F.size("flags").cast("long").alias("n_flags"))


def coverage(spark, sf_dir):
    """Postings by platform and by mode, which its SQL takes from the first 2,500 characters of a body."""
    p = postings(spark, sf_dir)
    mode = role.work_mode(F.lit(""), F.lit(""), F.substring("description", 1, 2500), F.lit(None).cast("boolean"))
    cube = p.select("platform", mode.alias("mode")).groupingSets([["platform"], ["mode"], []], "platform", "mode").agg(F.count(F.lit(1)).alias("n"))
    return cube.select(F.coalesce("platform", F.lit("*")).alias("platform"), F.coalesce("mode", F.lit("*")).alias("mode"), "n")


def live_board(spark, sf_dir):
    """Roles seen in the 14 days up to the newest sighting of all, and whether they were first seen on that day."""
    return history.live(postings(spark, sf_dir)).select(*KEY, F.col("last_seen").cast("string").alias("last_seen"), "is_new")


def role_history(spark, sf_dir):
    """Users of the event log as roles: first and last seen, runs (days), and the status of the latest event."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.min("ts").cast("date").cast("string").alias("first_seen"), F.max("ts").cast("date").cast("string").alias("last_seen"), F.countDistinct(F.to_date("ts")).alias("runs"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


def throttled_sources(spark, sf_dir):
    """Sources that had at least three rows on the day of their last run before and none now."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"))
    days = e.select("day").distinct()
    count = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    before = count.select(F.col("user_id"), F.date_add("day", 1).alias("day"), F.col("n").alias("was"))
    now = before.join(F.broadcast(days), "day").join(count, ["user_id", "day"], "left")
    return now.filter((F.col("was") >= 3) & F.col("n").isNull()).select("user_id", F.col("day").cast("string").alias("day"), "was")


def sector_totals(spark, sf_dir):
    """Sources (suppliers) by country tag, untagged ones apart; boards without postings count 0."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    per = postings(spark, sf_dir).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    tag = F.coalesce("n_name", F.lit("untagged"))
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left").join(per, s.s_suppkey == per.l_suppkey, "left").groupBy(tag.alias("country")).agg(F.count(F.lit(1)).alias("sources"), F.sum(F.coalesce("n", F.lit(0))).alias("postings"))


READ = f"p AS ({P.view(**P.readings())})"
READ_WHOLE = f"p AS ({P.view(**P.readings(whole=True))})"
K = ", ".join(KEY)
GBP = "CASE WHEN r_min IS NULL OR coalesce(r_currency, '') <> 'GBP' THEN true ELSE CAST(r_max AS DOUBLE) * CASE r_period WHEN 'day' THEN 220 WHEN 'hour' THEN 1760 ELSE 1 END >= 55000 END"
HIT = "'dealbreaker: ' || r_hard || CASE WHEN r_soft <> '' THEN ', ' || r_soft ELSE '' END"
FLAGS = (
    "concat_ws('; ', CASE WHEN r_rights <> '' THEN r_rights END, CASE WHEN r_min IS NULL THEN 'unconfirmed salary' WHEN r_currency <> 'GBP' THEN 'salary in ' || r_currency || ', floor in GBP, not compared' WHEN r_currency IS NULL THEN 'salary has no currency, floor in GBP, not compared' END, "
    "CASE WHEN r_thin THEN 'not screened: no description from this source' END, CASE WHEN r_soft <> '' THEN 'soft flag: ' || r_soft END)"
)
DEDUPED = f"""p AS MATERIALIZED ({P.view(**P.readings())}),
  b AS (SELECT *, count(*) OVER (PARTITION BY company, title) AS members, row_number() OVER (PARTITION BY company, title ORDER BY CASE platform WHEN 'linkedin' THEN 0 WHEN 'nhs' THEN 1 ELSE 2 END DESC, r_min IS NOT NULL DESC, length(description) DESC, {K}) AS rn FROM p),
  f AS (SELECT company, title, location, r_countries, row_number() OVER (PARTITION BY company, title, location ORDER BY {K}) AS one, {K} FROM p),
  l AS (SELECT company, title, location, r_countries, row_number() OVER (PARTITION BY company, title ORDER BY CASE WHEN regexp_matches(r_countries, 'UK|IE|DE') THEN 0 ELSE 1 END, {K}) AS i FROM f WHERE one = 1 AND location <> ''),
  j AS (SELECT company, title, string_agg(CASE WHEN i <= 6 THEN location END, ' / ' ORDER BY i) || CASE WHEN count(*) > 6 THEN ' +' || CAST(count(*) - 6 AS VARCHAR) || ' more' ELSE '' END AS locations, count(*) AS spots,
    bool_or(i <= 6 AND r_countries <> '') AS known, bool_or(i <= 6 AND regexp_matches(r_countries, 'UK|IE|DE')) AS allowed FROM l GROUP BY company, title),
  g0 AS (SELECT company, title, count(DISTINCT location) AS kinds, list_sort(list(DISTINCT platform)) AS platforms FROM p GROUP BY company, title),
  dd AS (SELECT b.* EXCLUDE (location, rn), CASE WHEN members = 1 THEN b.location ELSE coalesce(locations, '') END AS location, coalesce(known, false) AS known, coalesce(allowed, false) AS allowed,
    concat_ws('; ', CASE WHEN len(platforms) > 1 THEN 'also listed on ' || array_to_string(list_filter(platforms, lambda x: x <> b.platform), ', ') END, CASE WHEN kinds > 1 THEN 'posted in ' || CAST(coalesce(spots, 0) AS VARCHAR) || ' locations' END) AS flags
    FROM b LEFT JOIN j USING (company, title) JOIN g0 USING (company, title) WHERE rn = 1)"""
WHOLE_DEDUPED = DEDUPED.replace(P.view(**P.readings()), P.view(**P.readings(whole=True)))
ORACLES = {
    "posting_keys": f"WITH {READ} SELECT {K}, substr(sha1(regexp_replace(url, '[?#].*$', '')), 1, 16) AS uid, split_part(url, '#', 1) AS source_key, CASE platform WHEN 'linkedin' THEN 0 WHEN 'nhs' THEN 1 ELSE 2 END AS directness, CASE WHEN l_linenumber = 5 THEN '' ELSE link END AS safe_url FROM p",
    "posting_places": f"WITH {READ} SELECT {K}, r_countries AS countries, r_city AS city, CASE WHEN tag IS NOT NULL THEN tag WHEN r_countries = '' THEN NULL WHEN r_countries LIKE '%,%' THEN 'multiple' ELSE r_countries END AS country FROM p",
    "posting_scope": f"WITH {READ_WHOLE} SELECT {K}, r_scope AS scope FROM p",
    "posting_pay": f"WITH {READ} SELECT {K}, CAST(r_min AS DOUBLE) AS pay_min, CAST(r_max AS DOUBLE) AS pay_max, r_currency AS currency, r_period AS period, r_min IS NOT NULL AS confirmed, CAST(r_max AS DOUBLE) * CASE r_period WHEN 'day' THEN 220 WHEN 'hour' THEN 1760 ELSE 1 END AS per_year, r_label AS label, {GBP} AS clears FROM p",
    "posting_roles": f"WITH {READ_WHOLE} SELECT {K}, r_level AS level, r_mode AS mode, r_rights AS rights FROM p",
    "posting_dedupe": f"""WITH {DEDUPED} SELECT {K}, company, title, platform, location, flags FROM dd""",
    "screen_gates": f"""WITH {READ}, g AS (SELECT *, CASE WHEN r_gate <> '' THEN r_gate WHEN r_left IS NULL THEN 'location excluded (' || location || ')'
    WHEN r_left IN ('', 'Remote') AND r_scope = 'US' THEN 'remote but restricted to US' WHEN r_left NOT IN ('', 'Remote') AND r_left_countries = '' THEN 'location not recognised (' || r_left || ')'
    WHEN r_left NOT IN ('', 'Remote') AND NOT regexp_matches(r_left_countries, 'UK|IE|DE') THEN r_left || ' outside target countries'
    WHEN NOT {GBP} THEN 'stated pay below floor' WHEN r_hard <> '' THEN {HIT} ELSE '' END AS reason FROM p)
SELECT {K}, reason, CASE WHEN reason = '' THEN {FLAGS} ELSE r_rights END AS flags FROM g""",
    "drop_report": f"""WITH {READ}, g AS (SELECT *, CASE WHEN r_gate <> '' THEN r_gate WHEN r_left IS NULL THEN 'location excluded (' || location || ')'
    WHEN r_left IN ('', 'Remote') AND r_scope = 'US' THEN 'remote but restricted to US' WHEN r_left NOT IN ('', 'Remote') AND r_left_countries = '' THEN 'location not recognised (' || r_left || ')'
    WHEN r_left NOT IN ('', 'Remote') AND NOT regexp_matches(r_left_countries, 'UK|IE|DE') THEN r_left || ' outside target countries'
    WHEN NOT {GBP} THEN 'stated pay below floor' WHEN r_hard <> '' THEN {HIT} ELSE '' END AS reason FROM p)
SELECT trim(regexp_replace(reason, '\\(.*?\\)', '', 'g')) AS reason, count(*) AS n FROM g WHERE reason <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5""",
    "screen_reasons": f"""WITH {WHOLE_DEDUPED}, g AS (SELECT CASE WHEN r_gate <> '' THEN r_gate WHEN location IN ('', 'Remote') AND r_scope = 'US' THEN 'remote but restricted to US'
    WHEN location NOT IN ('', 'Remote') AND NOT known THEN 'location not recognised' WHEN location NOT IN ('', 'Remote') AND NOT allowed THEN location || ' outside target countries'
    WHEN NOT {GBP} THEN 'stated pay below floor' WHEN r_hard <> '' THEN {HIT} ELSE 'kept' END AS reason FROM dd)
SELECT reason, count(*) AS n FROM g GROUP BY reason""",
    "posting_scores": f"""WITH {READ_WHOLE}, m AS (SELECT max(posted_at) AS today FROM p), g AS (SELECT *, r_min IS NOT NULL AS stated, r_min IS NOT NULL AND coalesce(r_currency, 'GBP') = 'GBP' AS alike, CAST(r_max AS DOUBLE) * CASE r_period WHEN 'day' THEN 220 WHEN 'hour' THEN 1760 ELSE 1 END AS per_year,
    date_diff('day', posted_at, today) AS age, {FLAGS} AS flags, coalesce(remote, false) AND r_countries = '' AS nowhere FROM p, m
    WHERE r_gate = '' AND (location IN ('', 'Remote') AND r_scope <> 'US' OR regexp_matches(r_countries, 'UK|IE|DE')) AND {GBP} AND r_hard = ''),
  s AS (SELECT *, regexp_matches(r_countries, 'UK|IE') AS home, stated AND alike AND per_year >= 55000 * 1.15 AS ample, CASE WHEN flags = '' THEN 0 ELSE len(string_split(flags, '; ')) END AS n FROM g)
SELECT {K}, CAST(least(100, greatest(0, 35 + CASE WHEN home OR nowhere THEN 20 WHEN r_countries <> '' THEN 8 ELSE 0 END + CASE WHEN alike THEN 10 WHEN stated THEN 4 ELSE 0 END
    + CASE WHEN ample THEN 10 ELSE 0 END + CASE WHEN age <= 7 THEN 15 WHEN age <= 21 THEN 8 ELSE 0 END + CASE WHEN n = 0 THEN 10 ELSE 0 END - CASE WHEN r_level >= 6 THEN 25 WHEN r_level = 5 THEN 8 ELSE 0 END)) AS DOUBLE) AS score,
  CAST(1 + CASE WHEN home OR nowhere OR r_countries <> '' THEN 1 ELSE 0 END + 1 + CASE WHEN ample THEN 1 ELSE 0 END + CASE WHEN age <= 21 THEN 1 ELSE 0 END + CASE WHEN r_level >= 5 THEN 1 ELSE 0 END AS BIGINT) AS n_reasons,
  CAST(n + CASE WHEN r_level >= 6 THEN 1 ELSE 0 END AS BIGINT) AS n_flags FROM s""",
    "coverage": f"WITH {READ} SELECT coalesce(platform, '*') AS platform, coalesce(r_mode, '*') AS mode, count(*) AS n FROM p GROUP BY GROUPING SETS ((platform), (r_mode), ())",
    "live_board": f"WITH {READ}, m AS (SELECT max(last_seen) AS newest FROM p) SELECT {K}, CAST(last_seen AS VARCHAR) AS last_seen, first_seen = newest AS is_new FROM p, m WHERE last_seen >= newest - INTERVAL 14 DAY",
    "role_history": "SELECT user_id, CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS first_seen, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS last_seen, count(DISTINCT CAST(ts AS DATE)) AS runs, (array_agg(event_type ORDER BY ts DESC, event_id DESC))[1] AS status FROM events GROUP BY user_id",
    "throttled_sources": "WITH c AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2), days AS (SELECT DISTINCT d FROM c) SELECT a.user_id, CAST(days.d AS VARCHAR) AS day, a.n AS was FROM c a JOIN days ON days.d = CAST(a.d + INTERVAL 1 DAY AS DATE) LEFT JOIN c b ON b.user_id = a.user_id AND b.d = days.d WHERE a.n >= 3 AND b.n IS NULL",
    "sector_totals": "SELECT coalesce(n_name, 'untagged') AS country, count(*) AS sources, CAST(sum(coalesce(n, 0)) AS BIGINT) AS postings FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) ON s_suppkey = l_suppkey GROUP BY 1",
}


#: Modules with queries of their own.
OTHERS = (history_queries, board_queries, board_view_queries, source_queries, ingest_queries)


def queries() -> dict:
    out = {name: globals()[name] for name in ORACLES}
    for m in OTHERS:
        out |= m.queries()
    return out


def oracle_sql() -> dict[str, str]:
    out = dict(ORACLES)
    for m in OTHERS:
        out |= m.oracle_sql()
    return out
