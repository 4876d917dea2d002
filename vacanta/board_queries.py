"""Queries over landed board payloads, with DuckDB SQL for each.

The given tables hold no payloads, so each query first writes the parts of a brand as that brand's board would list
them, in the format of one platform, and then reads the payload back with the normaliser. The SQL says what each
posting should be from the part itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.sources import boards

#: SQL that Spark and DuckDB share.
BASE = """SELECT p_partkey AS k, p_brand AS brand, p_name || ' ' || CAST(p_partkey AS STRING) AS title, CAST(p_partkey AS STRING) AS id,
  CASE p_partkey % 5 WHEN 0 THEN 'London' WHEN 1 THEN 'Remote, UK' WHEN 2 THEN 'Berlin' WHEN 3 THEN 'New York, NY' ELSE 'Hybrid only, remote desk' END AS loc,
  CASE p_partkey % 5 WHEN 1 THEN true WHEN 4 THEN false END AS away, CAST(DATE '2026-01-01' + CAST(p_partkey % 300 AS INT) AS STRING) AS day, CAST(40 + p_partkey % 50 AS STRING) AS amt,
  'https://jobs.example.com/' || CAST(p_partkey AS STRING) AS link FROM part"""
EXPECTED = {"company": "brand", "title": "title", "url": "link", "location": "loc", "remote": "away", "department": "NULL", "posted_at": "day", "pay_min": "NULL", "pay_max": "NULL", "description": "''", "flags": "''"}
PAID = {"pay_min": "CAST(amt AS DOUBLE) * 1000", "pay_max": "CAST(amt AS DOUBLE) * 1000"}
BOARD_URL = "'https://boards.example.com/' || brand"
SEARCH = f"'{boards.NOT_SCREENED}'"

# name: the item in Spark SQL, the payload of a list of items, the board's url, what is expected beside EXPECTED, rows left out
FORMATS = {
    "greenhouse": (
        """named_struct('title', title, 'absolute_url', link, 'company_name', IF(k % 2 = 0, brand || ' Ltd', ''), 'location', named_struct('name', IF(k % 11 = 0, NULL, loc)), 'offices', array(named_struct('name', 'Main'), named_struct('name', 'Side')), 'departments', array(named_struct('name', 'Eng'), named_struct('name', 'Ops')),
        'content', '&lt;p&gt;Fish &amp;amp; chips&lt;/p&gt;\n base &#163;' || amt || 'k', 'first_published', IF(k % 2 = 0, day || 'T00:30:00+01:00', NULL), 'updated_at', day,
        'pay_input_ranges', IF(k % 3 = 0, array(named_struct('min_cents', 4000000, 'max_cents', 5000000 + k * 100, 'currency_type', 'GBP', 'title', 'Band')), NULL))""",
        "to_json(named_struct('jobs', {items}))", BOARD_URL,
        {"company": "CASE WHEN k % 2 = 0 THEN brand || ' Ltd' ELSE brand END", "location": "CASE WHEN k % 11 = 0 THEN 'Main, Side' ELSE loc END", "remote": "CASE WHEN k % 11 <> 0 THEN away END", "department": "'Eng, Ops'", "description": "'Fish &amp; chips base £' || amt || 'k'",
         "pay_min": "CASE WHEN k % 3 = 0 THEN 40000 ELSE CAST(amt AS DOUBLE) * 1000 END", "pay_max": "CASE WHEN k % 3 = 0 THEN 50000 + k ELSE CAST(amt AS DOUBLE) * 1000 END"}, "true"),
    "ashby": (
        """named_struct('title', title, 'isListed', k % 7 <> 0, 'location', loc, 'secondaryLocations', IF(k % 2 = 0, array(named_struct('location', 'Leeds'), named_struct('location', 'York')), array()), 'isRemote', IF(k % 3 = 0, true, NULL), 'jobUrl', IF(k % 4 = 0, '', link), 'applyUrl', link,
        'team', 'Data', 'publishedAt', day || 'T23:30:00.123Z', 'descriptionPlain', 'Plain  text', 'compensation', named_struct('scrapeableCompensationSalarySummary', '£' || amt || 'k - £90K'))""",
        "to_json(named_struct('jobs', {items}))", BOARD_URL,
        {"location": "CASE WHEN k % 2 = 0 THEN loc || ', Leeds, York' ELSE loc END", "remote": "CASE WHEN k % 3 = 0 THEN true ELSE away END", "department": "'Data'", "description": "'Plain text'", "pay_min": "CAST(amt AS DOUBLE) * 1000", "pay_max": "90000"}, "k % 7 <> 0"),
    "lever": (
        """named_struct('text', title, 'hostedUrl', link, 'categories', named_struct('location', loc, 'commitment', 'Full time', 'team', '', 'department', 'Ops'), 'createdAt', (k % 300 + 20454) * 86400000 + 82800000,
        'description', '<div>Build things</div>', 'lists', array(named_struct('content', '<li>One</li>'), named_struct('content', 'base £' || amt || 'k')))""",
        "CASE WHEN length(brand) % 2 = 0 THEN to_json({items}) ELSE to_json(named_struct('data', {items})) END", BOARD_URL, {"department": "'Ops'", "description": "'Build things One base £' || amt || 'k'", **PAID}, "true"),
    "workable": (
        """named_struct('title', title, 'location', named_struct('city', 'Leeds', 'region', IF(k % 2 = 0, 'Yorks', NULL), 'country', 'UK', 'workplace', IF(k % 3 = 0, 'remote', 'office'), 'telecommuting', k % 5 = 0), 'application_url', link, 'department', 'Eng', 'published_on', day, 'description', 'pay £' || amt || ',000')""",
        "to_json(named_struct('jobs', {items}))", BOARD_URL, {"location": "CASE WHEN k % 2 = 0 THEN 'Leeds, Yorks, UK' ELSE 'Leeds, UK' END", "remote": "k % 3 = 0 OR k % 5 = 0", "department": "'Eng'", "description": "'pay £' || amt || ',000'", **PAID}, "true"),
    "smartrecruiters": (
        """named_struct('id', IF(k % 9 = 0, NULL, id), 'name', title, 'ref', link, 'company', named_struct('identifier', 'Acme', 'name', IF(k % 2 = 0, 'Acme Ltd', NULL)), 'location', named_struct('city', 'Bonn', 'country', 'de', 'remote', k % 2 = 0), 'department', named_struct('label', 'Ops'), 'releasedDate', day || 'T08:00:00.000Z', 'jobAd', named_struct('sections', named_struct('a', 'b')))""",
        "to_json(named_struct('content', {items}))", BOARD_URL, {"url": "CASE WHEN k % 9 = 0 THEN link ELSE 'https://jobs.smartrecruiters.com/Acme/' || id END", "company": "CASE WHEN k % 2 = 0 THEN 'Acme Ltd' ELSE brand END", "location": "'Bonn, de'", "remote": "k % 2 = 0", "department": "'Ops'"}, "true"),
    "workday": (
        """named_struct('title', title, 'externalPath', IF(k % 3 = 2, '', '/job/New-York/Title_R' || id), 'locationsText', IF(k % 2 = 0, '', loc), 'bulletFields', array('R' || id, 'Full time', 'x'), 'startDate', IF(k % 2 = 0, day, NULL), 'postedOn', 'Posted Today')""",
        "to_json(named_struct('jobPostings', {items}))", "'https://x.wd3.myworkdayjobs.com/wday/cxs/x/site/jobs'",
        {"url": "CASE WHEN k % 3 = 2 THEN 'https://x.wd3.myworkdayjobs.com' ELSE 'https://x.wd3.myworkdayjobs.com/en-US/site/job/New-York/Title_R' || id END", "location": "CASE WHEN k % 2 = 1 THEN loc WHEN k % 3 = 2 THEN 'R' || id || ' Full time' ELSE 'New York' END",
         "remote": "CASE WHEN k % 2 = 1 THEN away END", "posted_at": "CASE WHEN k % 2 = 0 THEN day END", "description": "'R' || id || ' Full time x'"}, "true"),
    "recruitee": (
        """named_struct('title', named_struct('rendered', title), 'city', IF(k % 2 = 0, 'Gent', NULL), 'country', IF(k % 2 = 0, 'Belgium', NULL), 'location', loc, 'description', '<p>A</p>', 'requirements', 'B £' || amt || 'k', 'careers_url', link, 'department', 'Eng', 'created_at', day || ' 10:00:00 UTC')""",
        "to_json(named_struct('offers', {items}))", BOARD_URL, {"location": "CASE WHEN k % 2 = 0 THEN 'Gent, Belgium' ELSE loc END", "remote": "CASE WHEN k % 2 = 1 THEN away END", "department": "'Eng'", "description": "'A B £' || amt || 'k'", **PAID}, "true"),
    "oracle": (
        """named_struct('Id', IF(k % 13 = 0, NULL, id), 'Title', title, 'PrimaryLocation', loc, 'secondaryLocations', IF(k % 2 = 0, array(named_struct('Name', 'Hull')), NULL), 'ShortDescriptionStr', 'Short text', 'WorkplaceTypeCode', 'ORA_ON_SITE', 'JobFamily', 'Retail', 'PostedDate', day)""",
        "to_json(named_struct('items', array(named_struct('requisitionList', {items}))))", "'https://fa-x.oraclecloud.com/hcmRestApi/r?finder=findReqs;siteNumber=CX_1001,limit=200'",
        {"url": "'https://fa-x.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1001/job/' || id", "location": "CASE WHEN k % 2 = 0 THEN loc || ', Hull' ELSE loc END", "department": "'Retail'", "description": "'Short text'"}, "k % 13 <> 0"),
    "phenom": (
        """named_struct('title', title, 'applyUrl', link, 'cityStateCountry', loc, 'descriptionTeaser', 'Salary £' || amt || ',500', 'jobType', 'Full time', 'category', 'Eng', 'postedDate', day || 'T00:00:00.000+0000')""",
        """CASE WHEN length(brand) % 2 = 0 THEN to_json(named_struct('refineSearch', named_struct('data', named_struct('jobs', {items})))) ELSE '<html><script>var x; phApp.ddo = ' || to_json(named_struct('eagerLoadRefineSearch', named_struct('data', named_struct('jobs', {items})))) || '; phApp.y = 1;</script></html>' END""",
        BOARD_URL, {"department": "'Eng'", "description": "'Salary £' || amt || ',500'", "pay_min": "CAST(amt AS DOUBLE) * 1000 + 500", "pay_max": "CAST(amt AS DOUBLE) * 1000 + 500"}, "true"),
    "linkedin": (
        """'<li><a href="https://uk.linkedin.com/jobs/view/' || id || '?ref=1">x</a><h3 class="base-search-card__title"> ' || title || ' &amp; co </h3><h4 class="base-search-card__subtitle"> <a href="#">' || IF(k % 2 = 0, 'Big Co', '') || '</a></h4><span class="job-search-card__location"> ' || loc || ' </span><time datetime="' || day || '">new</time></li>'""",
        "array_join({items}, '\\n')", BOARD_URL, {"title": "title || ' & co'", "url": "'https://uk.linkedin.com/jobs/view/' || id", "company": "CASE WHEN k % 2 = 0 THEN 'Big Co' ELSE brand END", "flags": f"'{boards.LISTING_ONLY}'"}, "true"),
    "personio": (
        """'<position><id>' || id || '</id><name><![CDATA[' || title || ']]></name><office>' || loc || '</office><department>Eng</department>' || IF(k % 2 = 0, '<url>' || link || '</url>', '') || '<createdAt>' || day || 'T10:00:00+00:00</createdAt><text>£' || amt || 'k</text></position>'""",
        "'<?xml version=\"1.0\"?><jobs>' || array_join({items}, '') || '</jobs>'", BOARD_URL,
        {"url": "CASE WHEN k % 2 = 0 THEN link ELSE 'https://' || brand || '.jobs.personio.de/job/' || id END", "department": "'Eng'", "description": "id || ' ' || loc || ' Eng ' || CASE WHEN k % 2 = 0 THEN link || ' ' ELSE '' END || day || 'T10:00:00+00:00 £' || amt || 'k'", **PAID}, "true"),
    "rss": (
        """IF(k % 2 = 0, '<item><title>' || title || '</title><link>' || link || '</link><description><![CDATA[<b>Pay</b> £' || amt || 'k, ' || loc || ']]></description><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate></item>',
        '<entry><title type="text">' || title || '</title><link rel="alternate" href="' || link || '"/><summary>Pay £' || amt || 'k, ' || loc || '</summary><updated>' || day || 'T01:02:03Z</updated></entry>')""",
        "'<feed>' || array_join({items}, '') || '</feed>'", BOARD_URL, {"location": "''", "posted_at": "CASE WHEN k % 2 = 1 THEN day END", "description": "CASE WHEN k % 2 = 0 THEN ']]>' ELSE '' END", **PAID}, "true"),
    "nhs": (
        """'<li class="nhsuk-list-panel search-result"><a href="/candidate/jobadvert/' || id || '?x=1" data-test="search-result-job-title"> ' || title || ' </a><div data-test="search-result-location"><h3 class="a"> Trust ' || brand || ' <div class="location-font-size"> Leeds </div></h3></div><li data-test="search-result-salary">Pay: <strong>£' || amt || ',000 a year</strong></li><li data-test="search-result-publicationDate">Date: <strong>' || date_format(CAST(day AS DATE), 'd MMMM yyyy') || '</strong></li>' || IF(k % 2 = 0, '<li data-test="search-result-closingDate">Closes: <strong>1 May</strong></li>', '') || '<li data-test="search-result-jobType">Type: <strong>Permanent</strong></li><li data-test="search-result-workingPattern">Pattern: <strong>Home or remote</strong></li></li>'""",
        "'<ul>' || array_join({items}, '') || '</ul>'", BOARD_URL,
        {"url": "'https://www.jobs.nhs.uk/candidate/jobadvert/' || id", "company": "'Trust ' || brand", "location": "'Leeds'", "remote": "true", "description": "'Permanent Home or remote £' || amt || ',000 a year'", "flags": f"CASE WHEN k % 2 = 0 THEN 'closes 1 May; ' ELSE '' END || {SEARCH}", **PAID}, "true"),
    "rmk": (
        """'<span><a class="jobTitle-link x" href="/tfl/job/Palestra-House,-SE1-' || replace(title, ' ', '-') || '/' || id || '/">' || title || '</a></span>' || IF(k % 3 = 0, '<a class="jobTitle-link" href="/tfl/job/Palestra-House,-SE1-' || replace(title, ' ', '-') || '/' || id || '/">Again</a>', '')""",
        "array_join({items}, '')", "'https://jobs.tfl.example.com/search/?q='", {"url": "'https://jobs.tfl.example.com/tfl/job/Palestra-House,-SE1-' || replace(title, ' ', '-') || '/' || id || '/'", "location": "'Palestra House, SE1'", "remote": "NULL", "posted_at": "NULL", "flags": SEARCH}, "true"),
    "avature": (
        """'<a href="https://x.avature.net/careers/JobDetail/Remote-desk-' || id || '/1"> <b>' || title || '</b> </a>' || IF(k % 3 = 0, '<a href="https://x.avature.net/careers/JobDetail/Remote-desk-' || id || '/1">Again</a>', '')""",
        "array_join({items}, '')", BOARD_URL, {"url": "'https://x.avature.net/careers/JobDetail/Remote-desk-' || id || '/1'", "location": "''", "remote": "true", "posted_at": "NULL", "description": "'Remote desk ' || id || '/1'", "flags": SEARCH}, "true"),
    "icims": (
        """'<div class="row"><span class="sr-only field-label">Job Locations</span> <span> ' || IF(k % 2 = 0, 'UK-Kent-Chatham | UK-London', 'Leeds') || ' </span><a rel="x" href="https://x.icims.com/jobs/' || id || '/job-name/job?in_iframe=1" class="iCIMS_Anchor"><span class="sr-only y">Title</span> <h3>' || title || '</h3></a></div>'""",
        "'<html><body>' || array_join({items}, '') || '</body></html>'", BOARD_URL, {"url": "'https://x.icims.com/jobs/' || id || '/job-name/job?in_iframe=1'", "location": "CASE WHEN k % 2 = 0 THEN 'Kent, Chatham, UK / London, UK' ELSE 'Leeds' END", "remote": "NULL", "posted_at": "NULL", "flags": SEARCH}, "true"),
    "custom": (
        """named_struct('positionTitle', title, 'applyLink', IF(k % 17 = 0, 'mailto:x', link), 'locations', array(loc, 'UK'), 'content', 'Text £' || amt || 'k', 'posted_at', day)""",
        "to_json(named_struct('meta', named_struct('x', array(1, 2)), 'result', named_struct('page', named_struct('hits', {items}, 'other', {items}))))", BOARD_URL, {"location": "loc || ', UK'", "description": "'Text £' || amt || 'k'", **PAID}, "k % 17 <> 0"),
}
# A closing mark of CDATA that follows markup stays in the text.
FORMATS["rss"][3]["description"] = "'Pay £' || amt || 'k, ' || loc"


#: Part keys that one page of a board spans: a board is landed as pages of bounded size, a payload each.
PAGE = 5000


def landed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The boards of a platform: pages for each brand, and one payload that can't be read."""
    item, payload, url, _, _ = FORMATS[name]
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    base = spark.sql(BASE.replace("FROM part", "FROM {part}"), part=part)
    rows = base.selectExpr("brand", "k", f"{item} AS item")
    by_brand = rows.groupBy("brand", F.floor(F.col("k") / PAGE).alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]).alias("items"))
    made = by_brand.selectExpr(f"'{name}/' || brand AS source_key", "brand AS company", f"'{name}' AS platform", f"{url} AS url", payload.replace("{items}", "items") + " AS payload")
    broken = made.limit(0).unionByName(spark.sql(f"SELECT '{name}/broken' AS source_key, 'Broken' AS company, '{name}' AS platform, 'https://x' AS url, '{{\"jobs\": [oops' AS payload"))
    return made.unionByName(broken)


def shown(jobs: DataFrame) -> DataFrame:
    return jobs.select("company", "title", "url", "location", "remote", "department", F.col("posted_at").cast("string").alias("posted_at"), F.col("salary.min").alias("pay_min"), F.col("salary.max").alias("pay_max"), "description", F.array_join("flags", "; ").alias("flags"))


def board(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(boards.parse(landed(spark, sf_dir, name), {name: boards.BOARDS[name]}))

    query.__doc__ = f"Postings of {name} payloads."
    return query


def all_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in FORMATS:
        rows = landed(spark, sf_dir, name)
        out = rows if out is None else out.unionByName(rows)
    return out


def board_counts(spark, sf_dir):
    """Postings by platform over all landed payloads together; payloads that gave none count 0."""
    # A landed row goes from the shuffle that makes it straight to the parser: read back from a table, a batch of pages would stand in memory at once.
    n = boards.parse(all_landed(spark, sf_dir), every=True).groupBy("platform", "source_key").agg(F.count("title").alias("n"))
    return n.groupBy("platform").agg(F.sum("n").alias("postings"), F.count_if(F.col("n") == 0).alias("unread"))


def expected(name: str) -> str:
    _, _, _, own, where = FORMATS[name]
    fields = EXPECTED | own
    kinds = {"remote": "BOOLEAN", "pay_min": "DOUBLE", "pay_max": "DOUBLE"}
    base = BASE.replace("STRING", "VARCHAR")
    return f"WITH b AS ({base}) SELECT " + ", ".join(f"CAST({x} AS {kinds.get(c, 'VARCHAR')}) AS {c}" for c, x in fields.items()) + f" FROM b WHERE {where}"


def queries() -> dict:
    return {f"board_{name}": board(name) for name in FORMATS} | {"board_counts": board_counts}


def oracle_sql() -> dict[str, str]:
    counts = " UNION ALL ".join(f"SELECT '{name}' AS platform, CAST(count(*) AS BIGINT) AS postings, CAST(1 AS BIGINT) AS unread FROM ({expected(name)})" for name in FORMATS)
    return {f"board_{name}": expected(name) for name in FORMATS} | {"board_counts": counts}
