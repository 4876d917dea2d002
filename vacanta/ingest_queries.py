"""The run loop from landed payloads to stored roles, over three runs, with DuckDB SQL for what should be stored.

Parts are postings on their brand's board. Each run lands files of payloads; a part is in two of three runs, some are listed
twice on a page, some under a second title with the same link. Runs differ in text and pay, so that the rules of the merge
show. After the last run the stream is started again without new files, and the last batch is merged again: neither changes a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.functions import role
from vacanta.operators import score as scoring
from vacanta.operators import screen as screening
from vacanta.sources import boards
from vacanta.streaming import jobs
from vacanta.streaming.store import Store
from vacanta.tables import shared_path

RULES = screening.Rules(["data engineer"], [], ["UK"], ["DE"], True, [], 55000.0, "GBP", [("night shifts", r"night shifts", True)])
RUNS = (1, 2, 3)
SCHEMA = "source_key string, company string, platform string, url string, payload string"
#: Columns of a role as it is stored.
STORED = ["company", "title", "url", "location", "city", "country", "work_mode", "platform", "department", "salary", "posted_at", "description", "score", "reasons", "flags"]
BAND = (2, 2)
#: The boards that land here; others would be walked.
FORMATS = {"lever": boards.lever}
PAGE = 5000
#: SQL that Spark and DuckDB share: the parts that are listed in a run, and what is said of them.
LISTED = """SELECT p_partkey AS k, p_brand AS brand, CASE WHEN p_partkey % 7 = 6 THEN 'Barista ' ELSE 'Data Engineer ' END || CAST(p_partkey AS STRING) AS title, 'https://jobs.example.com/' || CAST(p_partkey AS STRING) AS link,
  CASE p_partkey % 4 WHEN 0 THEN 'London' WHEN 1 THEN 'Remote, UK' WHEN 2 THEN 'Berlin' ELSE 'New York, NY' END AS loc, 40 + (p_partkey + {run}) % 50 AS amt, {run} <> 2 AS paid,
  repeat('Build things for people. ', CASE {run} WHEN 2 THEN 4 ELSE 10 + {run} END) || CASE WHEN p_partkey % 17 = 0 THEN 'Some night shifts.' ELSE 'No more.' END AS body
FROM part WHERE (p_partkey + {run}) % 3 <> 0 AND NOT ({run} = 3 AND p_brand = 'Brand#7')"""


def land(spark: SparkSession, sf_dir: str, run: int, folder: str) -> None:
    """The pages of a run as JSON lines. A brand without postings still answers, with an empty list."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = spark.sql(LISTED.format(run=run).replace("FROM part", "FROM {part}"), part=part)
    item = "named_struct('text', {title}, 'hostedUrl', link, 'categories', named_struct('location', loc), 'descriptionPlain', body, 'lists', IF(paid, array(named_struct('content', 'base £' || CAST(amt AS STRING) || 'k')), NULL))"
    # Every fifth part is listed twice, every fifth again under another title.
    again = f"CASE k % 5 WHEN 0 THEN array({item}, {item}) WHEN 1 THEN array({item}, {item.replace('{title}', "title || ' (new)'")}) ELSE array({item}) END".replace("{title}", "title")
    pages = rows.selectExpr("brand", "k", f"{again} AS items").groupBy("brand", F.floor(F.col("k") / PAGE).alias("page")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "items"))), lambda x: x["items"])).alias("items"))
    made = pages.selectExpr("'lever/' || brand || '/' || page AS source_key", "brand AS company", "to_json(items) AS payload")
    silent = part.select("p_brand").distinct().filter("p_brand = 'Brand#7'").selectExpr("'lever/' || p_brand || '/0' AS source_key", "p_brand AS company", "'[]' AS payload")
    every = made.unionByName(silent) if run == 3 else made
    every.selectExpr("source_key", "company", "'lever' AS platform", "'https://boards.example.com/' || company AS url", "payload").repartition(8).write.mode("append").json(folder)


def today(run: int):
    return F.lit(f"2026-01-0{run}")


def screened(postings: DataFrame) -> DataFrame:
    """The roles of a batch: the full screen, and uids."""
    ordinal = ["source_key", "place", "title", "url"]
    done = screening.full_screen(postings, RULES, BAND, F.lit("2026-01-09").cast("date"), ordinal)
    uid = role.uid(F.col("url"), F.col("company"), F.col("title"), F.col("location")).alias("uid")
    return done.filter("drop_reason IS NULL").select(uid, "source_key", "place", *STORED)


def after_runs(spark: SparkSession, sf_dir: str) -> Store:
    folder, root = shared_path(spark, "landing"), shared_path(spark, "roles")
    for run in RUNS:
        land(spark, sf_dir, run, folder)
        store = jobs.ingest(jobs.landed(spark, folder, SCHEMA), root, screened, today(run), 16, FORMATS)
    # Again without new files, and the last run again.
    store = jobs.ingest(jobs.landed(spark, folder, SCHEMA), root, screened, today(9), 16, FORMATS)
    last = store.roles().drop("first_seen", "first_run", "last_seen")
    if store.merge(last, store.source_counts().filter("run = 3").drop("run"), 3, today(9)):
        raise ValueError("a run was merged twice")
    return store


def ingest_roles(spark, sf_dir):
    """The stored roles after three runs, the best first."""
    rows = scoring.ordered(after_runs(spark, sf_dir).roles(), ["uid"])
    return rows.select("uid", "company", "title", "location", "work_mode", F.col("salary.max").alias("pay"), F.length("description").cast("long").alias("n_chars"), "score", F.array_join("flags", "; ").alias("flags"), "first_seen", F.col("first_run").cast("int").alias("first_run"), "last_seen")


def ingest_runs(spark, sf_dir):
    """Each run with its sizes, whether boards went silent in it, and how many roles the last one brought."""
    store = after_runs(spark, sf_dir)
    n = [F.lit(store.throttled(run).count()).cast("long") if run > 1 else F.lit(0).cast("long") for run in RUNS]
    quiet = F.when(F.col("run") == 2, n[1]).when(F.col("run") == 3, n[2]).otherwise(n[0])
    fresh = F.when(F.col("run") == 3, F.lit(store.new_roles().count()).cast("long")).otherwise(F.lit(0).cast("long"))
    return store.runs().select(F.col("run").cast("int").alias("run"), "today", "sources", "postings", "kept", "new", "roles", quiet.alias("throttled"), fresh.alias("new_in_last"))


EACH = " UNION ALL ".join(f"SELECT {run} AS run, * FROM ({LISTED.format(run=run).replace('AS STRING', 'AS VARCHAR')})" for run in RUNS)
KEPT = f"""l AS ({EACH}), p AS (SELECT *, CASE WHEN k % 5 < 2 THEN 2 ELSE 1 END AS copies FROM l),
  j AS (SELECT *, CASE WHEN k % 5 = 1 THEN title || ' (new)' ELSE title END AS shown FROM p WHERE k % 7 <> 6 AND k % 4 < 3 AND (NOT paid OR amt >= 55) AND k % 17 <> 0)"""
INGEST = {
    "ingest_roles": f"""WITH {KEPT}, r AS (SELECT k, min(run) AS first, max(run) AS last, coalesce(max(CASE WHEN run = 3 THEN 3 END), min(CASE WHEN run = 1 THEN 1 END), 2) AS said, max(CASE WHEN paid THEN run END) AS paying FROM j GROUP BY k)
SELECT substr(sha1(n.link), 1, 16) AS uid, n.brand AS company, n.shown AS title, n.loc AS location, CASE WHEN n.loc = 'Remote, UK' THEN 'remote' ELSE 'unstated' END AS work_mode, CAST(m.amt * 1000 AS DOUBLE) AS pay, CAST(length(s.body || CASE WHEN s.paid THEN ' base £' || CAST(s.amt AS VARCHAR) || 'k' ELSE '' END) AS BIGINT) AS n_chars,
  CAST(least(100, 35 + CASE WHEN n.loc = 'Berlin' THEN 8 ELSE 20 END + CASE WHEN n.paid THEN 10 + CASE WHEN n.amt * 1000 >= 55000 * 1.15 THEN 10 ELSE 0 END + 10 ELSE 0 END) AS DOUBLE) AS score,
  CASE WHEN n.paid THEN '' ELSE 'unconfirmed salary; not screened: no description from this source' END AS flags,
  '2026-01-0' || CAST(first AS VARCHAR) AS first_seen, CAST(first AS INTEGER) AS first_run, '2026-01-0' || CAST(last AS VARCHAR) AS last_seen
FROM r JOIN j n ON n.k = r.k AND n.run = r.last JOIN j s ON s.k = r.k AND s.run = r.said LEFT JOIN j m ON m.k = r.k AND m.run = r.paying""",
    "ingest_runs": f"""WITH {KEPT}, f AS (SELECT k, min(run) AS first FROM j GROUP BY k),
  c AS (SELECT run, brand, k // {PAGE} AS page, sum(copies) AS n FROM p GROUP BY ALL), g AS (SELECT run, count(*) AS sources, sum(n) AS postings FROM c GROUP BY run)
SELECT CAST(g.run AS INTEGER) AS run, '2026-01-0' || CAST(g.run AS VARCHAR) AS today, CAST(sources + CASE WHEN g.run = 3 AND EXISTS (SELECT 1 FROM part WHERE p_brand = 'Brand#7') THEN 1 ELSE 0 END AS BIGINT) AS sources, CAST(postings AS BIGINT) AS postings,
  (SELECT count(*) FROM j WHERE j.run = g.run) AS kept, (SELECT count(*) FROM f WHERE first = g.run) AS new, (SELECT count(*) FROM f WHERE first <= g.run) AS roles,
  CAST(CASE WHEN g.run = 3 AND (SELECT n FROM c WHERE run = 2 AND brand = 'Brand#7' AND page = 0) >= 3 THEN 1 ELSE 0 END AS BIGINT) AS throttled, CASE WHEN g.run = 3 THEN (SELECT count(*) FROM f WHERE first = 3) ELSE 0 END AS new_in_last FROM g""",
}


def queries() -> dict:
    return {name: globals()[name] for name in INGEST}


def oracle_sql() -> dict[str, str]:
    return dict(INGEST)
