"""Postings generated from the star schema: one for each row of lineitem, in SQL that Spark and DuckDB share.

Each pool holds a text and what an independent reading makes of it; the queries read the text, the oracle SQL
takes the reading.
"""

TITLES = [  # title, level, whether the wanted titles gate it: '' kept, else the reason
    ("Data Engineer", 2, ""), ("Senior Data Engineer", 3, ""), ("Junior Data Engineer", 1, ""), ("Data Engineer Intern", 2, "title excluded"), ("FP&A Manager", 4, ""),
    ("Financial Planning and Analysis Manager", 4, ""), ("Principal Data Engineer", 5, ""), ("Director of Data Engineering", 6, "title does not match"), ("Barista", 0, "title does not match"),
    ("Data Engineer I", 1, ""), ("Healthcare Assistant (Bank)", 1, "title excluded"), ("Head of financial planning & analysis", 5, "title does not match"), ("VP, Data Engineer", 6, ""),
]
WANTED = ["data engineer", "fp&a manager"]
EXCLUDED = ["intern", "healthcare assistant (bank)"]
PLACES = [  # location, countries, town, what is left without Glasgow and its countries
    ("London", "UK", "London"), ("San Francisco, CA", "US", "San Francisco"), ("Birmingham, Alabama", "US", "Birmingham"), ("Germany", "DE", ""), ("London | Paris", "FR,UK", "London"),
    ("Berlin / Munich", "DE", "Berlin"), ("Remote", "", ""), ("Remote - US", "US", ""), ("Leeds LS1 4AP", "UK", "Leeds"), ("Perth, WA", "US", "Perth"), ("New York", "US", "New York"),
    ("Malmö", "SE", "Malmö"), ("", "", ""), ("Springfield", "", "Springfield"), ("US-CA-Menlo Park", "US", "Menlo Park"), ("Portland, OR", "US", "Portland"), ("Dublin, Ireland", "IE", "Dublin"),
    ("Glasgow", "UK", "Glasgow"), ("Glasgow / Toronto", "CA,UK", "Glasgow"), ("London or Dublin", "IE,UK", "London or Dublin"), ("Hybrid - Leeds", "UK", "Leeds"), ("London, Ontario", "", "London"),
    ("Zürich Area", "CH", "Zürich"),
]
LEFT = {"Glasgow": (None, ""), "Glasgow / Toronto": ("Toronto", "CA")}
PAY = [  # text, min, max, currency, period, label
    ("£50,000 - £60,000", 50000, 60000, "GBP", "year", "£50k - £60k"), ("$120k-150k", 120000, 150000, "USD", "year", "$120k - $150k"), ("€75,000", 75000, 75000, "EUR", "year", "€75k"),
    ("£500 per day", 500, 500, "GBP", "day", "£500/day"), ("£15.50 - £18 per hour", 15.5, 18, "GBP", "hour", "£16 - £18/hr"), ("Salary 40,000 to 50,000", 40000, 50000, None, "year", "40k - 50k"),
    ("grew from 25,000 to 90,000 members", None, None, None, "year", "unconfirmed salary"), ("competitive", None, None, None, "year", "unconfirmed salary"),
    ("what the team does all year", None, None, None, "year", "unconfirmed salary"), ("", None, None, None, "year", "unconfirmed salary"), ("£60,000 - £50,000", 60000, 60000, "GBP", "year", "£60k"),
    ("£120,000 with daily meetings", 120, 120, "GBP", "day", "£120/day"), ("negotiable, about £80k", 80000, 80000, "GBP", "year", "£80k"), ("$22 hourly", 22, 22, "USD", "hour", "$22/hr"),
    ("x " * 220 + "Base salary: £61,000 - £72,000", 61000, 72000, "GBP", "year", "£61k - £72k"), ("x " * 220 + "raised £61,000 in funds", None, None, None, "year", "unconfirmed salary"),
    ("pay 61,000–72,000 €", 61000, 72000, None, "year", "61k - 72k"),
]
FILL = "The team meets on Mondays and writes its plans down. " * 5
BODIES = [  # description, mode by text alone, rights, hard dealbreaker, soft dealbreaker, countries that it limits a remote role to
    ("A plain role with a team. " + FILL, "unstated", "", "", "", ""), ("Hybrid, three days a week in the office. " + FILL, "hybrid", "", "", "", ""), ("This is an on-site role.", "office", "", "", "", ""),
    ("We are fully remote. Remote work from the UK only. " + FILL, "remote", "", "", "", "UK"), ("We are unable to provide visa sponsorship. " + FILL, "unstated", "no sponsorship", "", "", ""),
    ("We can sponsor visas for this role.", "unstated", "sponsorship offered", "", "", ""), ("Security clearance is needed. " + FILL, "unstated", "export control or clearance", "", "", ""),
    ("There is a take home exercise.", "unstated", "", "take home", "", ""), ("Some weekends are on the rota. " + FILL, "unstated", "", "", "weekends", ""),
    ("A take-home task, and some weekends. " + FILL, "unstated", "", "take home", "weekends", ""), ("Applicants must be located in the United States. " + FILL, "unstated", "", "", "", "US"),
    (FILL * 12 + "It is hybrid, and you are located in the United States.", "unstated", "", "", "", ""), ("", "unstated", "", "", "", ""),
]
#: What a body says beyond its beginning, as queries that read whole bodies find it: description, mode by text alone, countries that it limits a remote role to.
FURTHER = {BODIES[11][0]: ("hybrid", "US")}
PLATFORMS = ["linkedin", "nhs", "greenhouse", "ashby", "lever", "workday"]


def literal(x) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def pick(index: str, pool: list) -> str:
    return f"CASE CAST(({index}) % {len(pool)} AS INT) " + " ".join(f"WHEN {i} THEN {literal(x)}" for i, x in enumerate(pool)) + " END"


TITLE_AT, PLACE_AT, PAY_AT, BODY_AT = "l_partkey", "l_orderkey", "l_partkey + l_linenumber", "l_orderkey + l_linenumber"


def view(**extra: str) -> str:
    """SQL of the view; extra columns by name."""
    more = "".join(f", {sql} AS {name}" for name, sql in extra.items())
    return f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_name || '-' || CAST(l_orderkey % 40 AS STRING) AS company,
  {pick(TITLE_AT, [t[0] for t in TITLES])} AS title,
  'https://boards.example.com/' || CAST(l_orderkey AS STRING) || '/' || CAST(l_linenumber AS STRING) || '/' || CAST(l_partkey AS STRING) || '/' || CAST(l_suppkey AS STRING)
    || CASE WHEN l_linenumber % 2 = 0 THEN '?utm=feed' WHEN l_linenumber = 3 THEN '#apply' ELSE '' END AS url,
  CASE WHEN l_linenumber = 5 THEN 'ftp://files.example.com/a' WHEN l_linenumber = 1 THEN 'mailto:jobs@example.com' ELSE 'https://boards.example.com/' || CAST(l_orderkey AS STRING) END AS link,
  CASE WHEN l_suppkey % 5 = 0 THEN 'NL' END AS tag,
  {pick("l_suppkey", PLATFORMS)} AS platform, {pick(PLACE_AT, [p[0] for p in PLACES])} AS location,
  CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN true WHEN 1 THEN false END AS remote,
  {pick(BODY_AT, [b[0] for b in BODIES])} AS description, {pick(PAY_AT, [p[0] for p in PAY])} AS pay,
  CAST(l_shipdate AS DATE) AS posted_at, CAST(least(l_shipdate, o_orderdate) AS DATE) AS first_seen, CAST(greatest(l_shipdate, o_orderdate) AS DATE) AS last_seen{more}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""".replace("AS STRING", "AS VARCHAR(99)")


def readings(whole: bool = False) -> dict[str, str]:
    """Readings by name. whole: of whole bodies; else the mode is that of their first 2,500 characters, the scope of their first 3,000."""
    modes, scopes = zip(*(FURTHER.get(b[0], (b[1], b[5])) if whole else (b[1], b[5]) for b in BODIES))
    return {
        "r_level": pick(TITLE_AT, [t[1] for t in TITLES]), "r_gate": pick(TITLE_AT, [t[2] for t in TITLES]), "r_countries": pick(PLACE_AT, [p[1] for p in PLACES]),
        "r_city": pick(PLACE_AT, [p[2] for p in PLACES]), "r_min": pick(PAY_AT, [p[1] for p in PAY]), "r_max": pick(PAY_AT, [p[2] for p in PAY]), "r_currency": pick(PAY_AT, [p[3] for p in PAY]),
        "r_period": pick(PAY_AT, [p[4] for p in PAY]), "r_label": pick(PAY_AT, [p[5] for p in PAY]), "r_mode": pick(BODY_AT, modes),
        "r_rights": pick(BODY_AT, [b[2] for b in BODIES]), "r_hard": pick(BODY_AT, [b[3] for b in BODIES]), "r_soft": pick(BODY_AT, [b[4] for b in BODIES]), "r_scope": pick(BODY_AT, scopes),
        "r_thin": pick(BODY_AT, [len(b[0].strip()) < 200 for b in BODIES]), "r_left": pick(PLACE_AT, [LEFT.get(p[0], p)[0] for p in PLACES]), "r_left_countries": pick(PLACE_AT, [LEFT.get(p[0], p)[1] for p in PLACES]),
    }
