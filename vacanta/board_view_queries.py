"""Queries over the board, triage, tracker and lookups, with DuckDB SQL for each.

Roles are the customers, statuses the last events of a user, artifacts the orders of a customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta import history_queries as H
from vacanta.functions import pay
from vacanta.functions.text import capped_location, fit_band
from vacanta.operators import board, documents, enrich, history, tracker, triage
from vacanta.operators.screen import Rules
from vacanta.tables import numbered, shared_path, written

#: SQL that Spark and DuckDB share.
ROLES = """SELECT c_custkey AS uid, 'Co ' || CAST(c_custkey % 50 AS STRING) AS company, 'Role ' || CAST(c_custkey % 30 AS STRING) AS title, 'https://x.example.com/' || CAST(c_custkey AS STRING) AS url,
  CASE c_custkey % 6 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'workday' WHEN 2 THEN 'nhs' WHEN 3 THEN 'smartrecruiters' ELSE 'lever' END AS platform, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'London' END AS location,
  repeat('word ', CAST(c_custkey % 80 AS INT)) AS description, CAST(c_custkey % 101 AS DOUBLE) AS score, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 97 AS INT) END AS fit,
  CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_mktsegment END AS sector, CASE c_custkey % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'office' END AS work_mode,
  CASE c_custkey % 7 WHEN 0 THEN 'UK' WHEN 1 THEN 'DE' END AS country, CASE c_custkey % 8 WHEN 0 THEN 'London' WHEN 1 THEN 'Berlin' ELSE '' END AS city, c_custkey % 3 = 0 AS salary_confirmed,
  DATE '2026-01-31' - CAST(c_custkey % 40 AS INT) AS last_seen, DATE '2026-01-31' - CAST(c_custkey % 40 + c_custkey % 3 AS INT) AS first_seen, CAST(c_custkey % 4 + 1 AS INT) AS first_run FROM customer"""
ARTIFACTS = """SELECT o_orderkey AS id, o_custkey AS uid, CASE o_orderkey % 3 WHEN 0 THEN 'cv' WHEN 1 THEN 'cover_letter' ELSE 'screen' END AS kind, 'docs/' || CAST(o_orderkey AS STRING) AS path,
  CAST(o_orderkey % 100 AS DOUBLE) AS rating, o_orderkey % 2 = 0 AS dash, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 = 1 END AS overlap FROM orders WHERE o_custkey % 3 = 0"""
RULES = Rules(["role"], floor=50000.0, currency="GBP", dealbreakers=[("words", "^(word ){60,}", True), ("fifty", "^(word ){50,}", False)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def roles(spark, sf_dir):
    rows = spark.sql(ROLES.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    amount = (F.col("uid") % 90 * 1000).cast("double")
    return rows.withColumns({"salary": pay.salary(amount, amount, F.lit("GBP"), F.lit("year"), F.lit(None).cast("string"), F.col("salary_confirmed")), "flags": F.array(F.lit("not screened: no text"), F.lit("other"))})


def artifacts(spark, sf_dir):
    rows = spark.sql(ARTIFACTS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    return rows.withColumn("gates", F.create_map(F.lit("written"), F.lit(True), F.lit("no_em_dash"), "dash", F.lit("no_overlap_with_cv"), "overlap")).drop("dash", "overlap")


def rows_of(spark, sf_dir):
    return board.board(roles(spark, sf_dir), H.statuses(spark, sf_dir), artifacts(spark, sf_dir))


def board_rows(spark, sf_dir):
    """What the board knows of each role."""
    return rows_of(spark, sf_dir).select("uid", "status", "note", "live", "is_new", "has_artifact", "shown", fit_band(F.col("fit")).alias("band"), capped_location(F.col("location")).alias("place"))


def board_list(spark, sf_dir):
    """The default list, and that of new roles, by score."""
    rows = rows_of(spark, sf_dir)
    both = board.listing(rows).select(F.lit("shown").alias("list"), "uid", "score", "company").union(board.listing(rows, new=True).select(F.lit("new"), "uid", "score", "company"))
    return both.orderBy("list", *board.by_score()).select("list", "uid")


def board_tabs(spark, sf_dir):
    """Roles of every tab in two sectors."""
    rows = rows_of(spark, sf_dir).filter("shown")
    out = None
    for name in ("open", "pay", "new", "live", "closed", "fit", "all"):
        part = board.view(rows, name, ["BUILDING", "HOUSEHOLD"], country="UK" if name == "all" else "").select(F.lit(name).alias("tab"), "uid")
        out = part if out is None else out.union(part)
    return out


def board_order(spark, sf_dir):
    """The place of each shown role by rank and by fit."""
    rows = rows_of(spark, sf_dir).filter("shown").select("uid", "status", "score", "fit")
    return numbered(numbered(rows, [*board.by_rank(), F.col("uid")], "rank_place"), [*board.by_fit(), F.col("uid")], "fit_place").select("uid", "rank_place", "fit_place")


def board_header(spark, sf_dir):
    return board.header(rows_of(spark, sf_dir).filter("shown"))


def board_facets(spark, sf_dir):
    return board.facets(rows_of(spark, sf_dir).filter("shown"))


def board_top_fit(spark, sf_dir):
    """The twelve best judged roles: a report."""
    return board.top_fit(rows_of(spark, sf_dir).filter("shown")).select("uid", "fit", "score")


def board_artifacts(spark, sf_dir):
    """The last artifact of each role and kind, with its failed gates."""
    return board.latest_artifacts(artifacts(spark, sf_dir)).select("uid", "kind", "id", F.array_join(board.failed_gates(F.col("gates")), ",").alias("failed"))


def board_export(spark, sf_dir):
    """The exported JSON of each listed role, read back."""
    out = board.exported(board.listing(rows_of(spark, sf_dir)), artifacts(spark, sf_dir))
    j = F.from_json("json", "struct<company: string, status: string, flags: array<string>, artifacts: array<struct<kind: string, path: string>>>")
    return out.select("uid", j.alias("j")).select("uid", "j.company", "j.status", F.size("j.flags").cast("long").alias("n_flags"), F.array_join("j.artifacts.path", ",").alias("paths"))


def board_results(spark, sf_dir):
    """Result lines and digest lines of the shown roles, new and known."""
    rows = rows_of(spark, sf_dir).filter("shown")
    lines = board.digest_lines(rows)
    label = F.get_json_object("json", "$.salary_label")
    return board.results(rows).join(lines, "uid").select("is_new", "uid", label.alias("label"), F.substring_index("text", "\n", 1).alias("line"))


def board_composition(spark, sf_dir):
    """Employer boards and keyword leads, and the four largest sectors, as names and counts."""
    totals, top = board.composition(rows_of(spark, sf_dir).filter("shown"), ["linkedin", "nhs"])
    return totals.selectExpr("stack(2, 'boards', boards, 'leads', leads) AS (name, n)").union(top)


def scan_summary(spark, sf_dir):
    """One row over sources (suppliers) and postings (roles)."""
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 7 > 0).alias("ok"), (F.col("s_suppkey") % 5).alias("n"), (F.col("s_suppkey") % 11 == 0).alias("throttled"), F.concat(F.lit("S"), (F.col("s_suppkey") % 20).cast("string")).alias("company"))
    p = rows_of(spark, sf_dir).select(F.col("shown").alias("kept"), "is_new")
    return board.summary(s, p).withColumn("throttled", F.array_join("throttled", ","))


def new_in_run(spark, sf_dir):
    return board.new_in_run(roles(spark, sf_dir), 2).select("uid")


def screen_verdicts(spark, sf_dir):
    """Verdicts of screenings; those of thin descriptions ask for the advert."""
    s = artifacts(spark, sf_dir).filter("kind = 'screen'").select("uid", F.when(F.col("id") % 2 == 0, "APPLY").otherwise("needs_more").alias("verdict"))
    return board.verdicts(s, roles(spark, sf_dir)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def orphan_keys(spark, sf_dir):
    """States and artifacts that have no role, where every fifth role is gone."""
    return board.orphans(H.statuses(spark, sf_dir), artifacts(spark, sf_dir), roles(spark, sf_dir).filter("uid % 5 > 0")).select("kind", "uid", "n")


def triage_batches(spark, sf_dir):
    """Batches of twenty roles to judge, with the text of each."""
    got = triage.batches(triage.candidates(rows_of(spark, sf_dir)))
    return got.select("batch", "pos", "uid", triage.digest(F.col("company"), F.col("title"), F.col("location"), F.lit(None).cast("string"), F.col("description"), F.col("pos")).alias("digest"))


def triage_counts(spark, sf_dir):
    """Roles that can't be judged, and what judging the others takes."""
    rows = rows_of(spark, sf_dir)
    return triage.estimate(triage.candidates(rows)).crossJoin(triage.unrankable(rows).agg(F.count(F.lit(1)).alias("unrankable")))


def triage_fits(spark, sf_dir):
    """Fits written back from replies: each batch's answers come twice, last place first, with figures to be mended."""
    batched = written(triage.batches(triage.candidates(rows_of(spark, sf_dir))).select("batch", "pos", "uid"), "batches")
    fit = F.when(F.col("uid") % 7 == 0, "bad").when(F.col("uid") % 7 == 1, "150").when(F.col("uid") % 7 == 2, "-3.5").otherwise(F.concat((F.col("uid") % 90).cast("string"), F.lit(".9")))
    answer = F.struct(F.col("pos").alias("role"), fit.alias("fit"), F.concat(F.lit("because [it] fits "), F.col("uid").cast("string")).alias("why"))
    again = F.struct(F.col("pos").alias("role"), F.lit("1").alias("fit"), F.lit("again").alias("why"))
    listed = batched.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct(F.col("pos"), answer.alias("a"), again.alias("b"))), False).alias("x"))
    replies = listed.select("batch", F.concat(F.lit("Here: "), F.to_json(F.concat(F.transform("x", lambda y: y["a"]), F.transform("x", lambda y: y["b"]))), F.lit(" done")).alias("reply"))
    fits = triage.matched(batched, replies)
    return triage.written_back(roles(spark, sf_dir).withColumn("fit_why", F.lit("")), fits).select("uid", F.coalesce("fit", F.lit(-1)).alias("fit"), "fit_why")


def enrich_candidates(spark, sf_dir):
    return enrich.candidates(rows_of(spark, sf_dir)).select("uid", "platform", enrich.page_key(F.col("platform"), F.col("url")).alias("page_key"))


def rescreened(spark, sf_dir):
    """Roles after their texts are read again."""
    got = enrich.rescreen(rows_of(spark, sf_dir), RULES)
    return got.select("uid", "status", "note", F.array_join("flags", "; ").alias("flags"))


def enriched(spark, sf_dir):
    """Roles whose landed detail page fills a thin description, and the pay that it states."""
    r = roles(spark, sf_dir).withColumn("url", F.concat(F.lit("https://a.wd1.myworkdayjobs.com/en-GB/site/job/X/"), F.lpad(F.col("uid").cast("string"), 6, "0")))
    body = F.concat(F.lit("<p>Salary &pound;"), (F.col("uid") % 50 + 40).cast("string"), F.lit("k</p>Line &lt;b&gt; two<br>"), F.repeat(F.lit("text "), F.when(F.col("uid") % 4 == 0, 3).otherwise(50)))
    payload = F.when(F.col("platform") == "linkedin", F.concat(F.lit('<section class="x description__text y">'), body, F.lit("</section>"))).when(F.col("platform") == "workday", F.to_json(F.struct(F.struct(body.alias("jobDescription")).alias("jobPostingInfo")))).otherwise(
        F.to_json(F.struct(F.struct(F.struct(F.struct(body.alias("text")).alias("qualifications"), F.struct(F.lit("First").alias("text")).alias("jobDescription")).alias("sections")).alias("jobAd")))
    )
    pages = r.filter("uid % 2 = 0 OR platform = 'linkedin'").select("platform", enrich.page_key(F.col("platform"), F.col("url")).alias("page_key"), payload.alias("payload"))
    got = enrich.fill(r, pages)
    return got.select("uid", F.length("description").cast("long").alias("n"), F.substring("description", 1, 30).alias("head"), F.col("salary.confirmed").alias("confirmed"), F.col("salary.min").alias("pay"))


def applications(spark):
    apps = [{"org": "Co 7 remote EMEA", "role": "", "status": "Applied"}, {"org": "co-3", "role": "Role 3", "status": "INTERVIEWING", "date": "2026-01-05", "note": "call"}, {"org": "Co 12", "role": "the role 12 at co", "status": "offer"}, {"org": "", "url": "HTTPS://x.example.com/44?a=b", "status": "rejected_by_them"}, "junk", {"org": "Co 7", "role": "Role 7"}]
    import json

    return tracker.load(spark.createDataFrame([(json.dumps({"applications": apps}),)], "value string"))


def tracker_matches(spark, sf_dir):
    """Roles that the tracker knows, by its first row that means them."""
    got = tracker.annotate(roles(spark, sf_dir).drop("flags"), applications(spark))
    return got.filter("app_status IS NOT NULL").select("uid", "app_status", F.array_join("flags", "; ").alias("flags"))


def tracker_import(spark, sf_dir):
    """States after an import of the tracker; twice is as once."""
    apps, r, s = applications(spark), roles(spark, sf_dir), H.statuses(spark, sf_dir).withColumn("updated_at", F.col("updated_at").cast("string"))
    once = tracker.imported(apps, r, s, F.lit("2026-02-01"))
    return tracker.imported(apps, r, once, F.lit("2026-02-02")).select("uid", "status", "note")


def role_lookup(spark, sf_dir):
    """What a person may type, for every twentieth role: its key, a prefix, its link, its company."""
    r = roles(spark, sf_dir).select(F.sha1(F.col("uid").cast("string")).alias("uid"), "url", "company", F.col("uid").alias("n"))
    some = r.filter("n % 20 = 0")
    asked = some.select("uid").union(some.select(F.substring("uid", 1, 9))).union(some.select(F.concat("url", F.lit("?x=1")))).union(some.select(F.upper("company"))).union(some.select(F.concat(F.lit("no "), "uid"))).toDF("target")
    return tracker.lookup(asked, r).select("target", "how", "n", "uid")


def role_duplicates(spark, sf_dir):
    """Roles, states and artifacts after duplicates are merged."""
    left, states, moved = history.merge_duplicates(roles(spark, sf_dir), H.statuses(spark, sf_dir), artifacts(spark, sf_dir))
    n = moved.groupBy("uid").agg(F.count(F.lit(1)).alias("artifacts"))
    return left.select("uid").join(states.select("uid", "status"), "uid", "left").join(n, "uid", "left").select("uid", F.coalesce("status", F.lit("new")).alias("status"), F.coalesce("artifacts", F.lit(0)).alias("artifacts"))


def facet_order(spark, sf_dir):
    """The names of each facet in the order that they are shown in."""
    return board.ordered_facets(rows_of(spark, sf_dir).filter("shown")).select("facet", "name", "n", "place")


def board_first(spark, sf_dir):
    """The first twenty-five roles of the list."""
    return board.first_rows(board.listing(rows_of(spark, sf_dir)), 25).select("uid", "score")


def board_caveats(spark, sf_dir):
    """The flags of each role that are worth a word."""
    kinds = ["not screened: no text", "salary in USD, floor in GBP, not compared", "sponsorship offered", "closes 1 May", "listing only"]
    some = F.filter(F.transform(F.array(*map(F.lit, kinds)), lambda f, i: F.when(F.col("uid") % (i + 2) == 0, f)), lambda f: f.isNotNull())
    return roles(spark, sf_dir).select("uid", F.array_join(board.caveats(some), "; ").alias("caveats"))


def repaired_links(spark, sf_dir):
    """Links of roles, those of one system in the form that opens."""
    url = F.concat(F.lit("https://jobs.smartrecruiters.com/Co"), F.when(F.col("uid") % 2 == 0, "/postings/").otherwise("/"), F.col("uid").cast("string"))
    made = roles(spark, sf_dir).withColumn("url", F.when(F.col("platform") == "smartrecruiters", url).otherwise(F.col("url")))
    return enrich.repaired(made).select("uid", "url")


def artifact_ids(spark, sf_dir):
    """Artifacts with new ones after them."""
    a = artifacts(spark, sf_dir).select("id", "uid", "kind")
    new = a.filter("kind = 'cv'").select("uid").distinct()
    return documents.append(a, numbered(new, [F.col("uid")], "id").select("id", "uid", F.lit("letter").alias("kind"))).select("id", "uid", "kind")


def results_written(spark, sf_dir):
    """Results and digest written as files and read back: postings by whether they are new, and lines by what they say of pay."""
    kept = rows_of(spark, sf_dir).filter("shown").select("uid", "title", "url", "company", "location", "salary", "score", "flags", "is_new")
    at = shared_path(spark, "results")
    board.write_results(kept, f"{at}/json")
    board.write_digest(kept, f"{at}/digest")
    back = spark.read.json(f"{at}/json").groupBy(F.concat(F.lit("new "), F.col("is_new").cast("string")).alias("name")).agg(F.count("uid").alias("n"))
    lines = spark.read.text(f"{at}/digest").filter(F.col("value").startswith("- **"))
    said = lines.groupBy(F.when(F.col("value").contains("unconfirmed salary"), "no pay").otherwise("pay").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return back.unionByName(said)


def imported_seen(spark, sf_dir):
    """A seen-set with an older one imported, twice."""
    r = roles(spark, sf_dir)
    seen = r.filter("uid % 3 = 0").select("uid", "first_seen", "last_seen", "company")
    legacy = r.filter("uid % 2 = 0").select("uid", F.date_sub("first_seen", 400).alias("first_seen"), F.date_sub("last_seen", 300).alias("last_seen"), F.lit("old").alias("company"))
    once = history.import_seen(seen, legacy)
    return history.import_seen(once, legacy).select("uid", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"), "company")


def seen_roles(spark, sf_dir):
    """The seen-set after a run, pruned, and which roles were new in it."""
    r = roles(spark, sf_dir)
    seen = r.filter("uid % 3 = 0").select("uid", F.date_sub("first_seen", 200).alias("first_seen"), F.date_sub("last_seen", F.when(F.col("uid") % 2 == 0, 200).otherwise(0)).alias("last_seen"))
    came = history.split_seen(r.filter("uid % 4 > 0"), seen, False)
    today = F.lit("2026-02-01").cast("date")
    after = history.prune_seen(history.record_seen(seen, came, today), today)
    return after.join(came.select("uid", "is_new"), "uid", "left").select("uid", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"), F.coalesce("is_new", F.lit(False)).alias("is_new"))


def default_states(spark, sf_dir):
    s = H.statuses(spark, sf_dir).withColumn("updated_at", F.col("updated_at").cast("string"))
    once = history.default_states(s, roles(spark, sf_dir), F.lit("2026-02-01"))
    return history.default_states(once, roles(spark, sf_dir), F.lit("2026-02-02")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


R, A = ROLES.replace("STRING", "VARCHAR"), ARTIFACTS.replace("STRING", "VARCHAR")
B = f"""r AS ({R}), s AS ({H.FOLD}), a AS ({A}), b AS (SELECT r.*, coalesce(status, 'new') AS status, coalesce(note, '') AS note, last_seen >= (SELECT max(last_seen) FROM r) - 14 AS live, first_seen = (SELECT max(last_seen) FROM r) AS is_new,
  r.uid IN (SELECT uid FROM a) AS has_artifact FROM r LEFT JOIN s ON s.uid = r.uid), v AS (SELECT *, live OR status <> 'new' OR has_artifact AS shown FROM b)"""
SETTLED, FLIGHT = "('rejected', 'withdrawn', 'skipped', 'closed')", "('applied', 'submitted', 'interviewing', 'offer')"
TIER = f"CASE WHEN status IN {FLIGHT} THEN 0 WHEN status IN {SETTLED} THEN 2 ELSE 1 END"
CAND = f"live AND status NOT IN {SETTLED} AND length(trim(description)) >= 200 AND fit IS NULL"
BATCHED = f"n AS (SELECT *, row_number() OVER (ORDER BY score DESC, uid) - 1 AS i FROM v WHERE {CAND})"
TABS = " UNION ALL ".join(
    f"SELECT '{name}' AS tab, uid FROM v WHERE shown AND sector IN ('BUILDING', 'HOUSEHOLD') AND {cond}"
    for name, cond in (("open", f"status NOT IN {SETTLED}"), ("pay", "salary_confirmed"), ("new", "is_new"), ("live", f"status IN {FLIGHT}"), ("closed", "status IN ('rejected', 'withdrawn', 'closed')"), ("fit", "coalesce(fit, -1) >= 70"), ("all", "country = 'UK'"))
)
MATCHES = """CASE WHEN uid % 50 = 7 THEN 0 WHEN uid % 50 = 3 AND title IN ('Role 3') THEN 1 WHEN uid % 50 IN (12, 1) AND title IN ('Role 12', 'Role 1') THEN 2 WHEN uid = 44 THEN 3 END"""
ORACLES = {
    "board_rows": f"WITH {B} SELECT uid, status, note, live, is_new, has_artifact, shown, CASE WHEN fit >= 70 THEN 'good' WHEN fit >= 50 THEN 'mid' WHEN fit >= 0 THEN 'low' END AS band, CASE WHEN location = '' THEN 'Location not stated' ELSE location END AS place FROM v",
    "board_list": f"WITH {B} SELECT 'shown' AS list, uid FROM v WHERE shown AND status NOT IN {SETTLED} UNION ALL SELECT 'new', uid FROM v WHERE is_new AND status NOT IN {SETTLED}",
    "board_tabs": f"WITH {B} {TABS}",
    "board_order": f"WITH {B} SELECT uid, row_number() OVER (ORDER BY {TIER}, score DESC, uid) AS rank_place, row_number() OVER (ORDER BY {TIER}, coalesce(fit, -1) DESC, score DESC, uid) AS fit_place FROM v WHERE shown",
    "board_header": f"WITH {B} SELECT count(*) AS total, count(*) FILTER (WHERE salary_confirmed) AS paid, count(*) FILTER (WHERE status IN {SETTLED}) AS settled, count(*) FILTER (WHERE is_new) AS fresh, count(*) FILTER (WHERE status IN {FLIGHT}) AS in_flight, count(*) FILTER (WHERE status IN ('rejected', 'withdrawn', 'closed')) AS closed_out, count(*) FILTER (WHERE fit >= 70) AS good_fit FROM v WHERE shown",
    "board_facets": f"WITH {B} SELECT 'sector' AS facet, CASE WHEN sector = '' THEN 'other' ELSE sector END AS name, count(*) AS n FROM v WHERE shown GROUP BY 2 UNION ALL SELECT 'mode', coalesce(work_mode, 'unstated'), count(*) FROM v WHERE shown GROUP BY 2 UNION ALL SELECT 'country', coalesce(country, 'unknown'), count(*) FROM v WHERE shown GROUP BY 2 UNION ALL SELECT 'city', city, count(*) FROM v WHERE shown AND city <> '' GROUP BY 2",
    "board_top_fit": f"WITH {B} SELECT uid, fit, score FROM v WHERE shown AND fit >= 0 ORDER BY fit DESC, score DESC, uid LIMIT 12",
    "board_artifacts": f"WITH a AS ({A}), l AS (SELECT *, row_number() OVER (PARTITION BY uid, kind ORDER BY id DESC) AS rn FROM a) SELECT uid, kind, id, concat_ws(',', CASE WHEN NOT dash THEN 'no_em_dash' END, CASE WHEN NOT overlap THEN 'no_overlap_with_cv' END) AS failed FROM l WHERE rn = 1",
    "board_export": f"WITH {B} SELECT v.uid, company, status, CAST(2 AS BIGINT) AS n_flags, coalesce((SELECT string_agg(path, ',' ORDER BY id) FROM a WHERE a.uid = v.uid), '') AS paths FROM v WHERE shown AND status NOT IN {SETTLED}",
    "board_results": f"""WITH {B}, l AS (SELECT *, CASE WHEN NOT salary_confirmed THEN 'unconfirmed salary' WHEN uid % 90 < 10 THEN '£' || format('{{:,}}', uid % 90 * 1000) ELSE '£' || CAST(uid % 90 AS VARCHAR) || 'k' END AS label FROM v WHERE shown)
SELECT is_new, uid, label, '- **[' || title || '](' || url || ')** · ' || company || ' · ' || CASE WHEN location = '' THEN 'location not stated' ELSE location END || ' · ' || label || ' · score ' || CAST(uid % 101 AS VARCHAR) AS line FROM l""",
    "facet_order": f"""WITH {B}, f AS (SELECT 'sector' AS facet, CASE WHEN sector = '' THEN 'other' ELSE sector END AS name, count(*) AS n FROM v WHERE shown GROUP BY 2 UNION ALL SELECT 'mode', coalesce(work_mode, 'unstated'), count(*) FROM v WHERE shown GROUP BY 2
  UNION ALL SELECT 'country', coalesce(country, 'unknown'), count(*) FROM v WHERE shown GROUP BY 2 UNION ALL SELECT 'city', city, count(*) FROM v WHERE shown AND city <> '' GROUP BY 2)
SELECT *, CAST(row_number() OVER (PARTITION BY facet ORDER BY n DESC, name) AS INTEGER) AS place FROM f""",
    "board_first": f"WITH {B} SELECT uid, score FROM v WHERE shown AND status NOT IN {SETTLED} ORDER BY score DESC, lower(company), uid LIMIT 25",
    "board_caveats": "SELECT c_custkey AS uid, concat_ws('; ', CASE WHEN c_custkey % 2 = 0 THEN 'not screened: no text' END, CASE WHEN c_custkey % 3 = 0 THEN 'salary in USD, floor in GBP, not compared' END, CASE WHEN c_custkey % 4 = 0 THEN 'sponsorship offered' END, CASE WHEN c_custkey % 6 = 0 THEN 'listing only' END) AS caveats FROM customer",
    "repaired_links": f"WITH r AS ({R}) SELECT uid, CASE WHEN platform = 'smartrecruiters' THEN 'https://jobs.smartrecruiters.com/Co/' || CAST(uid AS VARCHAR) ELSE url END AS url FROM r",
    "artifact_ids": f"WITH a AS ({A}) SELECT id, uid, kind FROM a UNION ALL SELECT (SELECT max(id) FROM a) + row_number() OVER (ORDER BY uid), uid, 'letter' FROM (SELECT DISTINCT uid FROM a WHERE kind = 'cv')",
    "results_written": f"WITH {B} SELECT 'new ' || CAST(is_new AS VARCHAR) AS name, count(*) AS n FROM v WHERE shown GROUP BY 1 UNION ALL SELECT CASE WHEN salary_confirmed THEN 'pay' ELSE 'no pay' END, count(*) FROM v WHERE shown GROUP BY 1",
    "imported_seen": f"""WITH r AS ({R}) SELECT uid, CAST(first_seen - CASE WHEN uid % 3 = 0 THEN 0 ELSE 400 END AS VARCHAR) AS first_seen, CAST(last_seen - CASE WHEN uid % 3 = 0 THEN 0 ELSE 300 END AS VARCHAR) AS last_seen, CASE WHEN uid % 3 = 0 THEN company ELSE 'old' END AS company
FROM r WHERE uid % 3 = 0 OR uid % 2 = 0""",
    "board_composition": f"WITH {B}, w AS (SELECT *, CASE WHEN sector = '' THEN 'untagged' ELSE sector END AS tag FROM v WHERE shown) SELECT 'boards' AS name, count(*) FILTER (WHERE platform NOT IN ('linkedin', 'nhs')) AS n FROM w UNION ALL SELECT 'leads', count(*) FILTER (WHERE platform IN ('linkedin', 'nhs')) FROM w UNION ALL (SELECT tag, count(*) FROM w GROUP BY tag ORDER BY 2 DESC, 1 LIMIT 4)",
    "scan_summary": f"WITH {B} SELECT (SELECT count(*) FROM supplier) AS sources, (SELECT count(*) FROM supplier WHERE s_suppkey % 7 > 0) AS ok, (SELECT count(*) FROM supplier WHERE s_suppkey % 7 > 0 AND s_suppkey % 5 = 0) AS empty, (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT 'S' || CAST(s_suppkey % 20 AS VARCHAR) AS c FROM supplier WHERE s_suppkey % 11 = 0)) AS throttled, count(*) AS postings, count(*) FILTER (WHERE shown) AS matching, count(*) FILTER (WHERE shown AND is_new) AS new FROM v",
    "new_in_run": f"WITH r AS ({R}) SELECT uid FROM r WHERE first_run = 3",
    "screen_verdicts": f"WITH r AS ({R}), a AS ({A}) SELECT CASE WHEN length(trim(coalesce(description, ''))) < 200 AND id % 2 = 0 THEN 'NEEDS_THE_ADVERT' WHEN id % 2 = 0 THEN 'APPLY' ELSE 'needs_more' END AS verdict, count(*) AS n FROM a LEFT JOIN r USING (uid) WHERE kind = 'screen' GROUP BY 1",
    "orphan_keys": f"WITH s AS ({H.FOLD}), a AS ({A}), r AS ({R}), k AS (SELECT 'state' AS kind, uid FROM s UNION ALL SELECT 'artifact', uid FROM a) SELECT kind, uid, count(*) AS n FROM k WHERE uid NOT IN (SELECT uid FROM r WHERE uid % 5 > 0) GROUP BY kind, uid",
    "triage_batches": f"WITH {B}, {BATCHED} SELECT CAST(i // 20 AS BIGINT) AS batch, i % 20 + 1 AS pos, uid, '--- role ' || CAST(i % 20 + 1 AS VARCHAR) || chr(10) || company || ' | ' || title || ' | ' || CASE WHEN location = '' THEN 'not stated' ELSE location END || ' | unconfirmed salary' || chr(10) || trim(description) || chr(10) AS digest FROM n",
    "triage_counts": f"WITH {B}, c AS (SELECT count(*) AS n, sum(least(length(description), 1200) + 120) AS chars FROM v WHERE {CAND}) SELECT CAST(greatest(1, ceil(n / 20)) AS BIGINT) AS batches, CAST(floor((chars + greatest(1, ceil(n / 20)) * 7000) / 4) AS BIGINT) AS tokens, (SELECT count(*) FROM v WHERE live AND status NOT IN {SETTLED} AND fit IS NULL AND length(trim(description)) < 200) AS unrankable FROM c",
    "triage_fits": f"WITH {B} SELECT uid, CASE WHEN {CAND} AND uid % 7 > 0 THEN CASE uid % 7 WHEN 1 THEN 100 WHEN 2 THEN 0 ELSE CAST(uid % 90 AS INT) END ELSE coalesce(fit, -1) END AS fit, CASE WHEN {CAND} AND uid % 7 > 0 THEN 'because [it] fits ' || CAST(uid AS VARCHAR) ELSE '' END AS fit_why FROM v",
    "enrich_candidates": f"WITH {B} SELECT uid, platform, CASE WHEN platform <> 'linkedin' THEN url WHEN uid >= 100000 THEN CAST(uid AS VARCHAR) ELSE '' END AS page_key FROM v WHERE live AND status NOT IN {SETTLED} AND platform IN ('linkedin', 'workday', 'smartrecruiters') AND length(trim(description)) < 200",
    "rescreened": f"""WITH {B}, d AS (SELECT *, live AND status = 'new' AND length(trim(description)) >= 200 AS due, uid % 80 >= 60 OR (salary_confirmed AND uid % 90 < 50) AS bad FROM v)
SELECT uid, CASE WHEN due AND bad THEN 'closed' ELSE status END AS status, CASE WHEN due AND bad THEN 'hidden after its full description was read' ELSE note END AS note,
  CASE WHEN due AND NOT bad THEN concat_ws('; ', 'other', CASE WHEN uid % 80 >= 50 THEN 'soft flag: fifty' END, CASE WHEN NOT salary_confirmed THEN 'unconfirmed salary' END) ELSE 'not screened: no text; other' END AS flags FROM d""",
    "enriched": f"""WITH r AS ({R}), d AS (SELECT *, CAST(uid % 50 + 40 AS VARCHAR) AS amt, uid % 4 > 0 AND platform IN ('linkedin', 'workday', 'smartrecruiters') AND length(trim(description)) < 200 AND (uid % 2 = 0 OR platform = 'linkedin') AS filled FROM r)
SELECT uid, CASE WHEN filled THEN 274 + CASE WHEN platform = 'smartrecruiters' THEN 7 ELSE 0 END ELSE length(description) END AS n,
  CASE WHEN filled THEN substr(CASE WHEN platform = 'smartrecruiters' THEN 'First' || chr(10) || chr(10) ELSE '' END || 'Salary £' || amt || 'k' || chr(10) || 'Line <b> two' || chr(10) || repeat('text ', 50), 1, 30) ELSE substr(description, 1, 30) END AS head,
  filled OR salary_confirmed AS confirmed, CASE WHEN filled AND NOT salary_confirmed THEN CAST(amt AS DOUBLE) * 1000 ELSE CAST(uid % 90 * 1000 AS DOUBLE) END AS pay FROM d""",
    "tracker_matches": f"WITH r AS ({R}), m AS (SELECT *, {MATCHES} AS o FROM r) SELECT uid, CASE o WHEN 0 THEN 'applied' WHEN 1 THEN 'interviewing' WHEN 2 THEN 'offer' ELSE 'rejected_by_them' END AS app_status, CASE o WHEN 0 THEN 'applied' WHEN 1 THEN 'interviewing on 2026-01-05 — call' WHEN 2 THEN 'offer' ELSE 'rejected by them' END AS flags FROM m WHERE o IS NOT NULL",
    "tracker_import": f"WITH r AS ({R}), m AS (SELECT *, {MATCHES} AS o FROM r), s AS ({H.FOLD}) SELECT coalesce(m.uid, s.uid) AS uid, CASE WHEN coalesce(status, 'new') = 'new' AND o IS NOT NULL THEN CASE o WHEN 0 THEN 'applied' WHEN 1 THEN 'interviewing' WHEN 2 THEN 'offer' ELSE 'rejected_by_them' END ELSE coalesce(status, 'new') END AS status, CASE WHEN coalesce(status, 'new') = 'new' AND o IS NOT NULL THEN CASE WHEN o = 1 THEN 'call' ELSE '' END ELSE coalesce(note, '') END AS note FROM (SELECT * FROM m WHERE o IS NOT NULL) m FULL JOIN s ON s.uid = m.uid",
    "role_lookup": f"""WITH r AS (SELECT sha1(CAST(uid AS VARCHAR)) AS uid, url, company, uid AS n FROM ({R})), q AS (SELECT * FROM r WHERE n % 20 = 0),
  t AS (SELECT uid AS target, 'uid' AS how FROM q UNION ALL SELECT substr(uid, 1, 9), 'prefix' FROM q UNION ALL SELECT url || '?x=1', 'url' FROM q UNION ALL SELECT DISTINCT upper(company), 'company' FROM q UNION ALL SELECT 'no ' || uid, 'none' FROM q),
  f AS (SELECT target, how, r.uid FROM t LEFT JOIN r ON CASE how WHEN 'uid' THEN r.uid = target WHEN 'prefix' THEN starts_with(r.uid, target) WHEN 'url' THEN starts_with(r.url, regexp_replace(target, '/?[?].*$', '')) WHEN 'company' THEN contains(lower(company), lower(target)) ELSE false END)
SELECT target, how, count(uid) AS n, CASE WHEN count(uid) = 1 THEN min(uid) END AS uid FROM f GROUP BY target, how""",
    "role_duplicates": f"""WITH r AS ({R}), s AS ({H.FOLD}), a AS ({A}), k AS (SELECT uid, first_value(uid) OVER g AS keep, row_number() OVER g AS place FROM r WINDOW g AS (PARTITION BY company, title ORDER BY CASE platform WHEN 'linkedin' THEN 0 WHEN 'nhs' THEN 1 ELSE 2 END DESC, salary_confirmed DESC, length(description) DESC, uid)),
  f AS (SELECT keep, place, status, CASE status WHEN 'skipped' THEN 1 WHEN 'applied' THEN 3 WHEN 'closed' THEN 5 WHEN 'interviewing' THEN 8 ELSE 0 END AS far FROM k JOIN s USING (uid) WHERE status <> 'new' OR place = 1),
  best AS (SELECT keep AS uid, arg_max(status, far * 1000000 - place) AS status FROM f GROUP BY keep), n AS (SELECT coalesce(keep, a.uid) AS uid, count(*) AS artifacts FROM a LEFT JOIN k ON k.uid = a.uid GROUP BY 1)
SELECT k.uid, coalesce(status, 'new') AS status, coalesce(artifacts, 0) AS artifacts FROM k LEFT JOIN best ON best.uid = k.uid LEFT JOIN n ON n.uid = k.uid WHERE place = 1""",
    "seen_roles": f"""WITH r AS ({R}), s AS (SELECT uid, first_seen - 200 AS first_seen, last_seen - CASE WHEN uid % 2 = 0 THEN 200 ELSE 0 END AS last_seen FROM r WHERE uid % 3 = 0), c AS (SELECT uid FROM r WHERE uid % 4 > 0)
SELECT coalesce(s.uid, c.uid) AS uid, CAST(coalesce(first_seen, DATE '2026-02-01') AS VARCHAR) AS first_seen, CAST(CASE WHEN c.uid IS NOT NULL THEN DATE '2026-02-01' ELSE last_seen END AS VARCHAR) AS last_seen, s.uid IS NULL AS is_new
FROM s FULL JOIN c ON s.uid = c.uid WHERE c.uid IS NOT NULL OR last_seen >= DATE '2026-02-01' - 180""",
    "default_states": f"WITH s AS ({H.FOLD}), r AS ({R}) SELECT status, count(*) AS n FROM (SELECT status FROM s UNION ALL SELECT 'new' FROM r WHERE uid NOT IN (SELECT uid FROM s)) GROUP BY status",
}


def queries() -> dict:
    return {name: globals()[name] for name in ORACLES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
