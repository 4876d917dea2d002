"""Queries over role history and shared phrases, with DuckDB SQL for each.

Roles are the parts of lineitem: a part is first stored from the rows shipped before CUT, and the rows since then are
the next run. Statuses are the events of a user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.functions import pay
from vacanta.operators import history, phrases

CUT = "1995-06-17"
#: Event types of the tables as statuses; others are new.
STATUS = {"purchase": "applied", "signup": "interviewing", "click": "skipped", "error": "closed"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def roles_of(rows: DataFrame) -> DataFrame:
    """The last row of each part as a role; pay is stated where the row has a discount."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"]
    price = F.col("l_extendedprice").cast("double")
    stated = F.col("l_discount") > 0.05
    role = rows.select(
        F.col("l_partkey").alias("uid"), *order, F.col("l_returnflag").alias("company"), F.when(F.col("l_linenumber") < 7, F.expr("repeat(l_linestatus, l_linenumber)")).alias("description"),
        pay.salary(price, price, F.lit("GBP"), F.lit("year"), F.lit(None).cast("string"), stated).alias("salary"),
    )
    return history.latest(role, order).select("uid", "company", "description", "salary")


def history_upsert(spark, sf_dir):
    """Roles after a second run over those that the first one stored."""
    rows = table(spark, sf_dir, "lineitem")
    before, since = (roles_of(rows.filter(f"l_shipdate {op} DATE'{CUT}'")) for op in ("<", ">="))
    stored = before.withColumns({"first_seen": F.lit("2026-01-01"), "first_run": F.lit(1), "last_seen": F.lit("2026-01-01")})
    after = history.upsert(stored, since, F.lit("2026-01-02"), F.lit(2))
    return after.select("uid", "company", "description", F.col("salary.min").alias("pay"), F.col("salary.confirmed").alias("confirmed"), "first_seen", "first_run", "last_seen")


def statuses(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in STATUS.items()), F.lit("new"))
    note = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("note "), F.col("event_id").cast("string"))).otherwise("")
    return history.fold_statuses(e.select(F.col("user_id").alias("uid"), status.alias("status"), note.alias("note"), "ts", "event_id"), ["ts", "event_id"])


def status_fold(spark, sf_dir):
    return statuses(spark, sf_dir).select("uid", "status", "note", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def history_hidden(spark, sf_dir):
    """Customers as roles with their status, without the settled ones."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_mktsegment").alias("company"))
    states = statuses(spark, sf_dir)
    return history.with_state(history.hide_settled(c, states), states).select("uid", "company", "status", "note")


def shared_phrases(spark, sf_dir):
    """The longest phrase of six words or more that a document shares with a benchmark item."""
    return phrases.shared_phrases(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text").select("doc_id", "item_id", F.col("n_words").cast("long").alias("n_words"), "phrase")


ROLE = "l_partkey AS uid, l_returnflag AS company, CASE WHEN l_linenumber < 7 THEN repeat(l_linestatus, l_linenumber) END AS description, CAST(l_extendedprice AS DOUBLE) AS pay, l_discount > 0.05 AS confirmed"
LAST = "SELECT * EXCLUDE rn FROM (SELECT " + ROLE + ", row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS rn FROM lineitem WHERE l_shipdate {op} DATE '" + CUT + "') WHERE rn = 1"
FOLD = (
    "SELECT user_id AS uid, (array_agg(status ORDER BY ts DESC, event_id DESC))[1] AS status, coalesce((array_agg(note ORDER BY ts DESC, event_id DESC) FILTER (WHERE note <> ''))[1], '') AS note, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM "
    "(SELECT *, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " ELSE 'new' END AS status, CASE WHEN event_id % 3 = 0 THEN 'note ' || CAST(event_id AS VARCHAR) ELSE '' END AS note FROM events) GROUP BY user_id"
)
WORDS = "SELECT {key}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9'']+') AS w FROM {table}"
GRAM = "SELECT {key}, unnest(list_transform(generate_series(1, len(w) - 5), lambda i: array_to_string(w[i:i + 5], ' '))) AS gram, unnest(generate_series(1, len(w) - 5)) AS i FROM (" + WORDS + ") WHERE len(w) >= 6"
ORACLES = {
    "history_upsert": f"""WITH s AS ({LAST.format(op="<")}), b AS ({LAST.format(op=">=")})
SELECT uid, CASE WHEN b.company IS NOT NULL THEN b.company ELSE s.company END AS company,
  CASE WHEN b.company IS NOT NULL AND length(coalesce(b.description, '')) >= length(coalesce(s.description, '')) THEN coalesce(b.description, '') ELSE s.description END AS description,
  CASE WHEN b.company IS NOT NULL AND (s.company IS NULL OR b.confirmed OR NOT s.confirmed) THEN b.pay ELSE s.pay END AS pay,
  CASE WHEN b.company IS NOT NULL AND (s.company IS NULL OR b.confirmed OR NOT s.confirmed) THEN b.confirmed ELSE s.confirmed END AS confirmed,
  CASE WHEN s.company IS NULL THEN '2026-01-02' ELSE '2026-01-01' END AS first_seen, CASE WHEN s.company IS NULL THEN 2 ELSE 1 END AS first_run,
  CASE WHEN b.company IS NULL THEN '2026-01-01' ELSE '2026-01-02' END AS last_seen
FROM s FULL OUTER JOIN b USING (uid)""",
    "status_fold": FOLD,
    "history_hidden": f"WITH f AS ({FOLD}) SELECT c_custkey AS uid, c_mktsegment AS company, coalesce(status, 'new') AS status, coalesce(note, '') AS note FROM customer LEFT JOIN f ON uid = c_custkey WHERE coalesce(status, 'new') NOT IN ('rejected', 'withdrawn', 'skipped', 'closed')",
    "shared_phrases": f"""WITH a AS ({GRAM.format(key="doc_id", table="documents")}), b AS ({GRAM.format(key="item_id", table="benchmark")}),
  m AS (SELECT a.doc_id, b.item_id, a.i, a.i - b.i AS d, a.i - row_number() OVER (PARTITION BY doc_id, item_id, a.i - b.i ORDER BY a.i) AS island FROM a JOIN b USING (gram)),
  r AS (SELECT doc_id, item_id, min(i) AS i, count(*) + 5 AS n_words FROM m GROUP BY doc_id, item_id, d, island),
  t AS ({WORDS.format(key="doc_id", table="documents")}),
  p AS (SELECT doc_id, item_id, i, n_words, array_to_string(w[i:i + n_words - 1], ' ') AS phrase FROM r JOIN t USING (doc_id))
SELECT doc_id, item_id, n_words, phrase FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY length(phrase) DESC, i) AS rn FROM p) WHERE rn = 1""",
}


def queries() -> dict:
    return {name: globals()[name] for name in ORACLES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
