"""Postings from landed payloads of boards, all formats in one pass over the landed rows.

A landed payload is a row (source_key, company, platform, url, payload and more); payload is the text that the board
gave. A format is a function of the columns payload, board (its company) and url that gives an array of items: what the
payload says of each posting, in one common shape (ITEM). parse() picks the format of each row, explodes the items and
does for all formats alike what is costly: dates, remote work, pay. It gives source_key, place (of the posting among those
of its payload), company, title, url, platform, location, remote, department, posted_at, description, salary, flags.

JSON is read by from_json with the fields that are wanted, HTML and XML by patterns; a payload that can't be read gives no
rows (bad_payloads lists it). Null and empty payloads give no rows. There is one scan, without shuffle and without Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacanta.functions import pay
from vacanta.functions.place import let
from vacanta.functions.text import blank, date_of, first_of, flat, node, remote_of

LISTING_ONLY = "listing-only: no description available from this source"
NOT_SCREENED = "not screened: search listing only, open the advert"

#: bits are searched for words of remote work where remote is null; amounts is pay given as numbers, pays are texts to look for
#: pay in, in this order, and raw is the text that found pay stands for, if it is another one.
ITEM = f"struct<title: string, url: string, company: string, location: string, remote: boolean, bits: array<string>, department: string, posted: string, description: string, amounts: {pay.KIND}, pays: array<string>, raw: string, flags: array<string>>"
#: Characters of a description that are searched for pay.
PAY_CHARS = 1500


def item(title: Column, url: Column, location: Column, bits: list[Column], remote: Column | None = None, company: Column | None = None, department: Column | None = None, posted: Column | None = None, description: Column | None = None, amounts: Column | None = None, pays: list[Column] = (), raw: Column | None = None, flags: list[Column] = ()) -> Column:
    none = F.lit(None)
    given = {"title": title, "url": url, "company": company, "location": location, "remote": remote, "bits": F.array(*bits), "department": department, "posted": posted, "description": description, "amounts": amounts, "pays": F.array(*pays), "raw": raw, "flags": F.array_compact(F.array(*flags).cast("array<string>"))}
    return F.struct(*((none if v is None else v).alias(k) for k, v in given.items())).cast(ITEM)


def start_of(text: Column) -> Column:
    return F.substring(text, 1, PAY_CHARS)


def joined(parts: Column, by: str = ", ") -> Column:
    return F.array_join(F.transform(parts, lambda x: blank(x)), by)


def some(*parts: Column, by: str = ", ") -> Column:
    return F.concat_ws(by, *(F.nullif(p, F.lit("")) for p in parts))


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1)


def greenhouse(payload: Column, board: Column, url: Column) -> Column:
    kind = (
        "struct<jobs: array<struct<title: string, absolute_url: string, company_name: string, location: string, offices: array<struct<name: string>>, departments: array<struct<name: string>>, content: string, first_published: string, updated_at: string,"
        " pay_input_ranges: array<struct<min_cents: double, max_cents: double, min_value: double, max_value: double, min: double, max: double, currency_type: string, currency: string, title: string>>>>>"
    )

    def one(j: Column) -> Column:
        place = F.when(j["location"].startswith("{"), F.get_json_object(j["location"], "$.name")).otherwise(node(j["location"]))
        offices, r = joined(j["offices"]["name"]), F.get(j["pay_input_ranges"], F.lit(0))
        amounts = pay.from_range(r["min_cents"], r["min_value"], r["min"], r["max_cents"], r["max_value"], r["max"], first_of(r["currency_type"], r["currency"]), r["title"])
        return let(flat(j["content"]), lambda t: item(node(j["title"]), j["absolute_url"], flat(first_of(place, offices)), [place, offices, j["title"]], company=j["company_name"], department=joined(j["departments"]["name"]), posted=first_of(j["first_published"], j["updated_at"]), description=t, amounts=amounts, pays=[r["title"], start_of(t)]))

    return F.transform(F.from_json(payload, kind)["jobs"], one)


def ashby(payload: Column, board: Column, url: Column) -> Column:
    kind = "struct<jobs: array<struct<title: string, isListed: boolean, location: string, secondaryLocations: array<string>, isRemote: boolean, jobUrl: string, applyUrl: string, department: string, team: string, publishedAt: string, descriptionPlain: string, descriptionHtml: string, compensation: struct<scrapeableCompensationSalarySummary: string, compensationTierSummary: string>>>>"

    def one(j: Column) -> Column:
        others = F.array_join(F.transform(j["secondaryLocations"], lambda x: F.when(x.startswith("{"), blank(F.get_json_object(x, "$.location"))).otherwise(x)), ", ")
        here, summary = node(j["location"]), first_of(j["compensation"]["scrapeableCompensationSalarySummary"], j["compensation"]["compensationTierSummary"])
        return item(node(j["title"]), first_of(j["jobUrl"], j["applyUrl"]), some(here, others), [here, others], j["isRemote"], department=node(first_of(j["department"], j["team"])), posted=j["publishedAt"], description=flat(first_of(j["descriptionPlain"], j["descriptionHtml"])), pays=[summary], raw=summary)

    return F.transform(F.filter(F.from_json(payload, kind)["jobs"], lambda j: F.coalesce(j["isListed"], F.lit(True))), one)


def lever(payload: Column, board: Column, url: Column) -> Column:
    kind = "struct<text: string, hostedUrl: string, applyUrl: string, categories: struct<location: string, commitment: string, team: string, department: string>, workplaceType: string, createdAt: string, descriptionPlain: string, description: string, lists: array<struct<content: string>>>"

    def one(j: Column) -> Column:
        here = node(j["categories"]["location"])
        both = F.struct(flat(first_of(j["descriptionPlain"], j["description"])).alias("text"), blank(F.array_join(F.transform(j["lists"], lambda x: flat(x["content"])), " ")).alias("extra"))
        return let(both, lambda b: item(node(j["text"]), first_of(j["hostedUrl"], j["applyUrl"]), here, [here, j["categories"]["commitment"], j["workplaceType"]], department=node(first_of(j["categories"]["team"], j["categories"]["department"])), posted=j["createdAt"], description=F.trim(F.concat(b["text"], F.lit(" "), b["extra"])), pays=[F.concat(start_of(b["text"]), F.lit(" "), F.substring(b["extra"], 1, 500))]))

    return F.transform(F.when(F.trim(payload).startswith("["), F.from_json(payload, f"array<{kind}>")).otherwise(F.from_json(payload, f"struct<data: array<{kind}>>")["data"]), one)


def divided(location: Column, kind: str, remote: Callable[[Column], Column]) -> Column:
    """Of a location that is an object of city, region and country, or a text: here, and whether it is remote (null for a text)."""
    at = F.from_json(location, kind)
    split = blank(location).startswith("{") | (blank(location) == "")
    return F.struct(F.when(split, blank(some(at["city"], at["region"], at["country"]))).otherwise(node(location)).alias("here"), F.when(split, remote(at)).alias("away"))


def told(flag: Column) -> Column:
    return ~F.coalesce(flag, F.lit("false")).isin("false", "", "0")


def workable(payload: Column, board: Column, url: Column) -> Column:
    kind = "struct<jobs: array<struct<title: string, location: string, url: string, application_url: string, shortlink: string, department: string, published_on: string, created_at: string, description: string>>>"

    def one(j: Column) -> Column:
        at = divided(j["location"], "struct<city: string, region: string, country: string, workplace: string, telecommuting: string>", lambda x: F.coalesce(x["workplace"] == "remote", F.lit(False)) | told(x["telecommuting"]))
        return let(F.struct(at.alias("at"), flat(j["description"]).alias("text")), lambda x: item(node(j["title"]), first_of(j["url"], j["application_url"], j["shortlink"]), x["at"]["here"], [x["at"]["here"]], x["at"]["away"], department=node(j["department"]), posted=first_of(j["published_on"], j["created_at"]), description=x["text"], pays=[start_of(x["text"])]))

    return F.transform(F.from_json(payload, kind)["jobs"], one)


def smartrecruiters(payload: Column, board: Column, url: Column) -> Column:
    kind = "struct<content: array<struct<id: string, name: string, ref: string, company: struct<identifier: string, name: string>, location: string, department: struct<label: string>, releasedDate: string, createdOn: string, jobAd: string>>>"

    def one(j: Column) -> Column:
        at = divided(j["location"], "struct<city: string, region: string, country: string, remote: string>", lambda x: told(x["remote"]))
        link = F.when(blank(j["id"]) != "", F.concat(F.lit("https://jobs.smartrecruiters.com/"), first_of(flat(j["company"]["identifier"]), board), F.lit("/"), j["id"])).otherwise(j["ref"])
        return let(at, lambda x: item(node(j["name"]), link, x["here"], [x["here"]], x["away"], company=flat(j["company"]["name"]), department=node(j["department"]["label"]), posted=first_of(j["releasedDate"], j["createdOn"]), description=node(j["jobAd"])))

    return F.transform(F.from_json(payload, kind)["content"], one)


def workday(payload: Column, board: Column, url: Column) -> Column:
    kind = "struct<jobPostings: array<struct<title: string, externalPath: string, locationsText: string, bulletFields: array<string>, startDate: string, postedOn: string>>>"
    base, site = F.regexp_replace(url, "/wday/cxs/.*$", ""), F.regexp_extract(url, "/wday/cxs/[^/]+/([^/]+)/jobs", 1)

    def one(j: Column) -> Column:
        path, bullets = blank(j["externalPath"]), blank(joined(j["bulletFields"], " "))
        link = F.when(path == "", base).otherwise(F.concat(base, F.lit("/en-US/"), site, F.lit("/"), F.regexp_replace(path, "^/+", "")))
        in_path = flat(F.replace(F.regexp_extract(path, "/job/([^/]+)/", 1), F.lit("-"), F.lit(" ")))
        here = first_of(flat(j["locationsText"]), in_path, joined(F.slice(j["bulletFields"], 1, 2), " "))
        return let(here, lambda at: item(node(j["title"]), link, at, [at, j["title"]], posted=first_of(j["startDate"], j["postedOn"]), description=bullets, pays=[bullets]))

    return F.transform(F.from_json(payload, kind)["jobPostings"], one)


def recruitee(payload: Column, board: Column, url: Column) -> Column:
    kind = "struct<offers: array<struct<title: string, city: string, country: string, location: string, description: string, requirements: string, careers_url: string, careers_apply_url: string, remote: string, department: string, published_at: string, created_at: string>>>"

    def one(j: Column) -> Column:
        here = first_of(some(j["city"], j["country"]), node(j["location"]))
        text = F.concat(flat(j["description"]), F.lit(" "), flat(j["requirements"]))
        # A flag that is set reads as its name in the text searched, which says nothing of working remotely.
        return let(F.struct(here.alias("here"), text.alias("text")), lambda x: item(node(j["title"]), first_of(j["careers_url"], j["careers_apply_url"]), x["here"], [x["here"], j["remote"]], department=node(j["department"]), posted=first_of(j["published_at"], j["created_at"]), description=F.trim(x["text"]), pays=[start_of(x["text"])]))

    return F.transform(F.from_json(payload, kind)["offers"], one)


def oracle(payload: Column, board: Column, url: Column) -> Column:
    kind = "struct<items: array<struct<requisitionList: array<struct<Id: string, Title: string, PrimaryLocation: string, secondaryLocations: array<struct<Name: string, PrimaryLocation: string>>, ShortDescriptionStr: string, ExternalResponsibilitiesStr: string, WorkplaceTypeCode: string, JobFamily: string, JobFunction: string, PostedDate: string>>>>>"
    site = first_of(F.regexp_extract(url, r"(?i)siteNumber=(CX_\d+)", 1), F.lit("CX_1"))

    def one(j: Column) -> Column:
        here = node(j["PrimaryLocation"])
        others = F.array_join(F.transform(j["secondaryLocations"], lambda x: flat(first_of(x["Name"], x["PrimaryLocation"]))), ", ")
        link = F.concat(F.lit("https://"), host_of(url), F.lit("/hcmUI/CandidateExperience/en/sites/"), site, F.lit("/job/"), j["Id"])
        return let(flat(first_of(j["ShortDescriptionStr"], j["ExternalResponsibilitiesStr"])), lambda t: item(node(j["Title"]), link, some(here, others), [here, j["WorkplaceTypeCode"], j["Title"]], department=node(first_of(j["JobFamily"], j["JobFunction"])), posted=j["PostedDate"], description=t, pays=[start_of(t)]))

    listed = F.flatten(F.transform(F.from_json(payload, kind)["items"], lambda x: F.coalesce(x["requisitionList"], F.array())))
    return F.transform(F.filter(listed, lambda j: blank(j["Id"]) != ""), one)


def phenom(payload: Column, board: Column, url: Column) -> Column:
    """The search answer, or the same embedded in a page."""
    jobs = "array<struct<title: string, applyUrl: string, imApplyUrl: string, cityStateCountry: string, location: string, country: string, descriptionTeaser: string, jobType: string, category: string, postedDate: string, dateCreated: string>>"
    block = f"struct<data: struct<jobs: {jobs}>, jobs: {jobs}>"
    page = r"(?s)phApp\.ddo\s*=\s*(\{.*?\});\s*(?:phApp|</script>|window\.)"
    body = F.when(F.ltrim(payload).startswith("{"), payload).otherwise(F.regexp_extract(payload, page, 1))
    read = F.from_json(body, f"struct<refineSearch: {block}, eagerLoadRefineSearch: {block}>")
    listed = let(read, lambda x: let(F.coalesce(x["refineSearch"], x["eagerLoadRefineSearch"]), lambda b: F.when(F.size(b["data"]["jobs"]) > 0, b["data"]["jobs"]).otherwise(b["jobs"])))

    def one(j: Column) -> Column:
        here, title = node(first_of(j["cityStateCountry"], j["location"], j["country"])), node(j["title"])
        return let(flat(j["descriptionTeaser"]), lambda t: item(title, first_of(j["applyUrl"], j["imApplyUrl"]), here, [here, title, j["jobType"]], department=node(j["category"]), posted=first_of(j["postedDate"], j["dateCreated"]), description=t, pays=[t]))

    return F.transform(listed, one)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """What the first match of a pattern holds, as text; empty without one."""
    return F.regexp_extract(text, "(?s)" + pattern, group)


def blocks(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)" + pattern), F.lit(group))


def first_each(rows: Column, key: Callable[[Column], Column]) -> Column:
    """Of the items of one payload the first with each key."""
    return let(rows, lambda every: let(F.transform(every, key), lambda keys: F.filter(every, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def linkedin(payload: Column, board: Column, url: Column) -> Column:
    def one(j: Column) -> Column:
        title, here = found(j, 'base-search-card__title"[^>]*>(.*?)<', 1), found(j, 'job-search-card__location"[^>]*>(.*?)<', 1)
        company = flat(found(j, r'base-search-card__subtitle"[^>]*>\s*(?:<a[^>]*>)?(.*?)<', 1))
        return item(flat(title), found(j, 'href="(https://[^"]*?/jobs/view/[^"?]+)', 1), flat(here), [here, title], company=company, posted=found(j, r'datetime="([\d-]+)"', 1), flags=[F.lit(LISTING_ONLY)])

    return F.transform(blocks(payload, "<li>(.*?)</li>"), one)


def tag(text: Column, name: str, attributes: bool = False) -> Column:
    open_ = f"<{name}[^>]*>" if attributes else f"<{name}>"
    return flat(found(text, rf"{open_}(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{name}>", 1))


def personio(payload: Column, board: Column, url: Column) -> Column:
    def one(j: Column) -> Column:
        link = first_of(tag(j, "url"), F.concat(F.lit("https://"), board, F.lit(".jobs.personio.de/job/"), tag(j, "id")))
        read = F.struct(flat(j).alias("text"), tag(j, "name").alias("title"), tag(j, "office").alias("office"))
        return let(read, lambda x: item(x["title"], link, first_of(x["office"], tag(j, "location")), [x["office"], x["title"]], department=tag(j, "department"), posted=tag(j, "createdAt"), description=x["text"], pays=[start_of(x["text"])]))

    return F.transform(blocks(payload, "<position>(.*?)</position>"), one)


def rss(payload: Column, board: Column, url: Column) -> Column:
    def one(j: Column) -> Column:
        t = lambda name: tag(j, name, True)
        link = first_of(t("link"), found(j, '<link[^>]*href="([^"]+)"', 1))
        read = F.struct(first_of(t("description"), t("summary"), t("content")).alias("text"), t("title").alias("title"))
        return let(read, lambda x: item(x["title"], link, t("location"), [F.substring(x["text"], 1, 300), x["title"]], posted=first_of(t("pubDate"), t("published"), t("updated")), description=x["text"], pays=[start_of(x["text"])]))

    return F.transform(blocks(payload, "<(?:item|entry)>(.*?)</(?:item|entry)>"), one)


def nhs(payload: Column, board: Column, url: Column) -> Column:
    employer = r'data-test="search-result-location">.*?<h3[^>]*>\s*(.*?)\s*<div class="location-font-size">\s*(.*?)\s*</div>'

    def one(j: Column) -> Column:
        def field(name: str) -> Column:
            return flat(found(j, rf'data-test="search-result-{name}"[^>]*>.*?<strong[^>]*>\s*(.*?)\s*</strong>', 1))

        title = flat(found(j, r'data-test="search-result-job-title"[^>]*>\s*(.*?)\s*</a>', 1))
        read = F.struct(field("salary").alias("pay"), field("workingPattern").alias("pattern"), field("closingDate").alias("closing"), flat(found(j, employer, 2)).alias("here"), title.alias("title"), found(j, 'href="(/candidate/jobadvert/[^"?]+)', 1).alias("href"))
        company = F.when(j.rlike("(?s)" + employer), flat(found(j, employer, 1))).otherwise("NHS")

        def made(x: Column) -> Column:
            closes = F.when(x["closing"] != "", F.concat(F.lit("closes "), x["closing"]))
            link = F.when(x["href"] != "", F.concat(F.lit("https://www.jobs.nhs.uk"), x["href"]))
            return item(x["title"], link, x["here"], [x["here"], x["title"], x["pattern"]], company=company, posted=field("publicationDate"), description=some(field("jobType"), x["pattern"], x["pay"], by=" "), pays=[x["pay"]], flags=[closes, F.lit(NOT_SCREENED)])

        return let(read, made)

    return F.transform(blocks(payload, '<li class="nhsuk-list-panel search-result.*?(?=<li class="nhsuk-list-panel|</ul>)', 0), one)


def rmk(payload: Column, board: Column, url: Column) -> Column:
    marked, any_ = r'<a[^>]*class="[^"]*jobTitle-link[^"]*"[^>]*href="([^"?]+)"[^>]*>\s*(.*?)\s*</a>', r'(?i)href="((?:/[a-z0-9_-]+)?/job/[^"?]+)"[^>]*>\s*(.*?)\s*</a>'

    def pairs(pattern: str) -> Column:
        return F.transform(blocks(payload, pattern, 0), lambda m: F.struct(found(m, pattern, 1).alias("path"), flat(found(m, pattern, 2)).alias("title")))

    def one(j: Column) -> Column:
        tail = F.regexp_replace(F.regexp_extract(j["path"], "^.*/job/(.*)$", 1), r"/\d+/?$", "")
        slug = flat(F.replace(F.url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))), F.lit("-"), F.lit(" ")))
        link = F.when(j["path"].startswith("http"), j["path"]).otherwise(F.concat(F.lit("https://"), host_of(url), j["path"]))

        def placed(x: Column) -> Column:
            low, head = F.lower(x), F.lower(j["title"])
            # Where the title begins for the last time in the slug: what stands before it is the place.
            upto = F.length(x) - F.length(head) - F.instr(F.reverse(low), F.reverse(head)) + 1
            return F.when(low.contains(head), F.btrim(F.substring(x, F.lit(1), upto), F.lit(" ,-"))).otherwise(x)

        return let(let(slug, placed), lambda here: item(j["title"], link, here, [here, j["title"]], flags=[F.lit(NOT_SCREENED)]))

    both = let(pairs(marked), lambda x: F.when(F.size(x) > 0, x).otherwise(pairs(any_)))
    return F.transform(first_each(F.filter(both, lambda x: x["title"] != ""), lambda x: x["path"]), one)


def avature(payload: Column, board: Column, url: Column) -> Column:
    link = r'href="(https?://[^"]*?/JobDetail/[^"?]+)"[^>]*>\s*(.*?)\s*</a>'
    pairs = F.transform(blocks(payload, link, 0), lambda m: F.struct(found(m, link, 1).alias("url"), flat(found(m, link, 2)).alias("title")))

    def one(j: Column) -> Column:
        slug = F.replace(F.regexp_extract(j["url"], "^.*/JobDetail/(.*)$", 1), F.lit("-"), F.lit(" "))
        return item(j["title"], j["url"], F.lit(""), [slug, j["title"]], description=flat(slug), flags=[F.lit(NOT_SCREENED)])

    return F.transform(first_each(F.filter(pairs, lambda x: x["title"] != ""), lambda x: x["url"]), one)


def icims(payload: Column, board: Column, url: Column) -> Column:
    link = r'<a[^>]+href="(https?://[^"]*?/jobs/\d+/[^"?]+[^"]*)"[^>]*class="iCIMS_Anchor"[^>]*>(.*?)</a>'
    place_ = r'field-label">Job Locations?</span>\s*<span[^>]*>\s*(.*?)\s*</span>'
    hidden = r'(?s)<span[^>]*class="[^"]*sr-only[^"]*"[^>]*>.*?</span>'
    read = lambda m: F.struct(found(m, link, 1).alias("url"), flat(F.regexp_replace(found(m, link, 2), hidden, " ")).alias("title"), flat(found(m, place_, 1)).alias("at"))
    rows = F.filter(F.transform(blocks(payload, '<div class="row">(.*?)(?=<div class="row">|</body>)'), read), lambda x: (x["title"] != "") & (x["url"] != ""))

    def tidy(part: Column) -> Column:
        bits = F.filter(F.split(part, "-"), lambda b: b != "")
        return F.when(F.size(bits) > 1, F.concat(F.array_join(F.slice(bits, 2, F.size(bits)), ", "), F.lit(", "), F.get(bits, F.lit(0)))).otherwise(part)

    def one(j: Column) -> Column:
        here = F.array_join(F.transform(F.filter(F.transform(F.split(j["at"], r"\|"), lambda x: F.trim(x)), lambda x: x != ""), tidy), " / ")
        return item(j["title"], j["url"], here, [here, j["title"]], flags=[F.lit(NOT_SCREENED)])

    return F.transform(first_each(rows, lambda x: x["url"]), one)


# Keys that may hold a title, a link or a date, in the order of choice, and how far below the root they are looked for.
TITLE_KEYS = ["title", "name", "jobTitle", "positionTitle", "text"]
URL_KEYS = ["url", "absolute_url", "jobUrl", "applyUrl", "hostedUrl", "link", "applyLink"]
DATE_KEYS = ["postedDate", "posted_at", "updated_at", "publishedAt"]
DEEPEST = 6
#: Items of a list that are looked into.
LOOKED_INTO = 50


def first_list(node_: Column, depth: int = 0) -> Column:
    """The objects, as JSON, of the first list whose first item is an object with a title's key, at most DEEPEST levels down.

    What stands first is looked into first, to its end. Each level is one lambda within another, and once a list is found
    nothing more is read. A string that begins with a bracket is taken for what it looks like.
    """
    is_list = node_.startswith("[")

    def judged(values: Column) -> Column:
        head = F.get(values, F.lit(0))
        keys = F.map_keys(F.from_json(head, "map<string, string>"))
        titled = F.coalesce(head.startswith("{") & F.arrays_overlap(keys, F.array(*map(F.lit, TITLE_KEYS))), F.lit(False))
        here = F.when(is_list & titled, F.filter(values, lambda x: x.startswith("{")))
        if depth == DEEPEST:
            return here
        kids = F.filter(F.when(is_list, F.slice(values, 1, LOOKED_INTO)).otherwise(values), lambda x: x.startswith("{") | x.startswith("["))
        return F.coalesce(here, F.aggregate(kids, F.lit(None).cast("array<string>"), lambda found_, kid: F.coalesce(found_, first_list(kid, depth + 1))))

    values = F.when(is_list, F.from_json(node_, "array<string>")).when(node_.startswith("{"), F.map_values(F.from_json(node_, "map<string, string>")))
    return let(values, judged)


def custom(payload: Column, board: Column, url: Column) -> Column:
    """Boards of no known format."""

    def one(j: Column) -> Column:
        get = lambda k: F.get_json_object(j, f"$.{k}")
        where = first_of(get("location"), get("locations"), get("city"))
        here = F.when(where.startswith("{"), flat(F.array_join(F.map_values(F.from_json(where, "map<string, string>")), ", "))).otherwise(node(where))
        link = first_of(*(get(k) for k in URL_KEYS))
        read = F.struct(first_of(*(node(get(k)) for k in TITLE_KEYS)).alias("title"), here.alias("here"), node(first_of(get("description"), get("content"))).alias("text"))
        return let(read, lambda x: item(x["title"], F.when(link.startswith("http"), link), x["here"], [x["here"], x["title"]], posted=first_of(*(get(k) for k in DATE_KEYS)), description=x["text"], pays=[start_of(x["text"])]))

    return F.transform(first_list(F.ltrim(payload, F.lit(" \t\r\n"))), one)


Format = Callable[[Column, Column, Column], Column]
#: A new board is a function of payload, board and url that gives an array of item(), and an entry here or in a dict for parse().
BOARDS: dict[str, Format] = {f.__name__: f for f in (greenhouse, ashby, lever, workable, smartrecruiters, workday, linkedin, recruitee, personio, oracle, rss, nhs, phenom, rmk, avature, icims, custom)}


def pay_of(j: Column) -> Column:
    """Pay given as numbers, else the first that a text states, else what the last text gives."""
    tried = F.transform(j["pays"], lambda t: pay.parse(t))
    read = let(tried, lambda all_: F.coalesce(F.get(F.filter(all_, lambda s: s["confirmed"]), F.lit(0)), F.try_element_at(all_, F.lit(-1)), pay.salary()))
    named = let(read, lambda s: F.when(s["confirmed"] & j["raw"].isNotNull(), s.withField("raw", F.substring(F.trim(j["raw"]), 1, 120))).otherwise(s))
    return F.coalesce(j["amounts"], named)


def parse(raw: DataFrame, boards: dict[str, Format] | None = None, every: bool = False) -> DataFrame:
    """Postings of all landed rows by their platform; those of platforms that boards lacks are walked like custom ones.

    With every, landed rows and items that give no posting stay as rows without title. raw may be a stream.
    """
    boards = BOARDS if boards is None else boards
    others = boards.get("custom", custom)
    columns = F.col("payload"), F.col("company"), F.col("url")
    named = {name: f(*columns) for name, f in boards.items() if name != "custom"}
    listed = F
    for name, items in named.items():
        listed = listed.when(F.col("platform") == name, items)
    listed = listed.otherwise(others(*columns)) if named else others(*columns)
    known = F.col("platform").isin(*named)
    rows = raw.select("source_key", F.col("company").alias("board"), F.when(known, F.col("platform")).otherwise("custom").alias("platform"), (F.posexplode_outer if every else F.posexplode)(listed).alias("place", "j"))
    j, good = F.col("j"), F.expr("j.title <> '' AND j.url <> ''")
    out = (rows if every else rows.filter(good)).select(
        "source_key", "place", first_of(j["company"], F.col("board")).alias("company"), F.when(good, j["title"]).alias("title"), j["url"].alias("url"), "platform", blank(j["location"]).alias("location"),
        F.coalesce(j["remote"], remote_of(F.concat_ws(" ", j["bits"]))).alias("remote"), F.nullif(j["department"], F.lit("")).alias("department"), date_of(j["posted"]).alias("posted_at"), blank(j["description"]).alias("description"),
        pay_of(j).alias("salary"), j["flags"].alias("flags"),
    )
    return out


def bad_payloads(raw: DataFrame, parsed: DataFrame) -> DataFrame:
    """Landed rows that have a payload but gave no posting."""
    return raw.filter(blank(F.col("payload")) != "").join(parsed.select("source_key").distinct(), "source_key", "left_anti")


def inherit(parsed: DataFrame, registry: DataFrame) -> DataFrame:
    """Postings with the sector and country tag of their board where they have none themselves."""
    tags = registry.select("source_key", F.col("sector").alias("_sector"), F.col("country").alias("_country")).dropDuplicates(["source_key"])
    own = {c: F.nullif(F.col(c), F.lit("")) if c in parsed.columns else F.lit(None).cast("string") for c in ("sector", "country")}
    return parsed.join(tags, "source_key", "left").withColumns({c: F.coalesce(own[c], F.col(f"_{c}")) for c in own}).drop("_sector", "_country")
