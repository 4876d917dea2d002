"""The list of boards: loading, filters, search templates, platforms, coverage, saving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.functions.role import source_key
from vacanta.functions.text import blank, first_of
from vacanta.tables import first_wins

#: What a board's url tells of its platform; the first that is found counts.
PLATFORMS = [
    ("greenhouse", r"boards-api\.greenhouse\.io|job-boards(?:\.eu)?\.greenhouse\.io"), ("ashby", r"api\.ashbyhq\.com/posting-api"), ("lever", r"api\.lever\.co/v0/postings"),
    ("workday", r"myworkdayjobs\.com/wday/cxs"), ("workable", r"apply\.workable\.com/api"), ("smartrecruiters", r"api\.smartrecruiters\.com/v1/companies"),
    ("linkedin", r"linkedin\.com/jobs-guest"), ("nhs", r"jobs\.nhs\.uk/candidate/search"), ("recruitee", r"\.recruitee\.com/api/offers"), ("personio", r"jobs\.personio\.(?:de|com)/xml"),
    ("oracle", r"oraclecloud\.com/hcmRestApi/.*recruitingCEJobRequisitions"), ("phenom", r"/search-results|phenompeople"), ("rmk", r"jobs2web\.com/.*/search|/search/\?q="),
    ("avature", r"avature\.net/.*SearchJobs"), ("icims", r"icims\.com/jobs/search"), ("rss", r"\.(?:rss|xml)(?:$|\?)|/rss/|successfactors|avature"),
]
FIELDS = "struct<company: string, url: string, platform: string, sector: string, country: string, domain: string, method: string, keyword_template: boolean>"
SEARCHES = 6


def detect(url: Column) -> Column:
    """The platform of a board by its url, else 'custom'."""
    return F.coalesce(*(F.when(url.rlike("(?i)" + p), F.lit(name)) for name, p in PLATFORMS), F.lit("custom"))


def read(spark: SparkSession, *folders: str) -> DataFrame:
    """The entries of registry folders of JSON lines, one each: file (number of the folder), place and entry.

    place is where a line stands: name of the part, where its block begins, and the count of lines read by then. Nothing is
    gathered: a folder of any size is read in parts.
    """
    rows = None
    for i, folder in enumerate(folders):
        place = F.struct(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        part = spark.read.text(folder).select(F.lit(i).alias("file"), place.alias("place"), F.col("value").alias("entry"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def entries_of(texts: DataFrame, value: str = "value") -> DataFrame:
    """The entries of whole registry documents, each a row with its number, file: an object with sources, or a list."""
    entries = F.coalesce(F.from_json(value, "struct<sources: array<string>>")["sources"], F.from_json(value, "array<string>"))
    return texts.select("file", F.posexplode(entries).alias("place", "entry"))


def parsed(entries: DataFrame) -> DataFrame:
    """file, place, entry, the fields of each, and corrupt: the entry itself where it can't be read."""
    board = F.from_json(F.coalesce(F.get_json_object("entry", "$.json"), F.col("entry")), FIELDS.replace(">", ", corrupt: string>"), {"columnNameOfCorruptRecord": "corrupt"})
    return entries.select("file", "place", "entry", board.alias("b")).select("file", "place", "entry", "b.*")


def load(entries: DataFrame) -> DataFrame:
    """Boards of registry entries: file, place and the fields. An entry may be wrapped in an object json. Those without url go, as do those that can't be read (rejected() has them)."""
    out = parsed(entries).filter((blank(F.col("url")) != "") & F.col("corrupt").isNull()).drop("entry", "corrupt")
    return out.withColumn("platform", first_of(F.col("platform"), detect(F.col("url")))).withColumn("method", F.when(F.col("platform") == "workday", "POST").otherwise(first_of(F.col("method"), F.lit("GET"))))


def rejected(entries: DataFrame) -> DataFrame:
    """file, place and entry of what can't be read, or has no url. Empty lines are nothing."""
    bad = F.col("corrupt").isNotNull() | (blank(F.col("url")) == "")
    return parsed(entries).filter(bad & (F.trim(blank(F.col("entry"))) != "")).select("file", "place", "entry")


def wanted(boards: DataFrame, sectors: list[str] = (), countries: list[str] = ()) -> DataFrame:
    """Boards of these sectors and countries; those without a tag stay."""
    for column, values in (("sector", sectors), ("country", countries)):
        if values:
            boards = boards.filter((blank(F.col(column)) == "") | F.lower(column).isin(*(v.lower() for v in values)))
    return boards


def form_encoded(text: Column) -> Column:
    """As a form encodes it: ~ stays and * does not."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def expand(boards: DataFrame, titles: list[str]) -> DataFrame:
    """A search template gives a row for each of the first six titles, none without titles; other boards stay as they are."""
    searches = F.when(F.coalesce("keyword_template", F.lit(False)), F.array(*map(F.lit, titles[:SEARCHES])).cast("array<string>")).otherwise(F.array(F.lit(None).cast("string")))
    each = boards.select("*", F.posexplode(searches).alias("search", "title"))
    return each.withColumns({
        "url": F.when(F.col("title").isNull(), F.col("url")).otherwise(F.replace("url", F.lit("{keyword}"), form_encoded(F.col("title")))),
        "company": F.when(F.col("title").isNull(), F.col("company")).otherwise(F.concat("company", F.lit(": "), "title")),
        "keyword_template": F.lit(False),
    }).drop("title")


def unique(boards: DataFrame) -> DataFrame:
    """The first board of each key (url without fragment) in load order."""
    return first_wins(boards.withColumn("source_key", source_key(F.col("url"))), ["source_key"], ["file", "place", "search"])


def coverage(boards: DataFrame) -> DataFrame:
    """kind (sector, country, platform, total), name and n; what has no tag counts as untagged or unknown."""
    tags = boards.select(first_of(F.col("sector"), F.lit("untagged")).alias("sector"), first_of(F.col("country"), F.lit("untagged")).alias("country"), first_of(F.col("platform"), F.lit("unknown")).alias("platform"))
    sets = tags.groupingSets([["sector"], ["country"], ["platform"], []], "sector", "country", "platform").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "sector").when(F.col("g") == 5, "country").when(F.col("g") == 6, "platform").otherwise("total")
    return sets.select(kind.alias("kind"), F.coalesce("sector", "country", "platform", F.lit("all")).alias("name"), "n")


def saved(boards: DataFrame) -> DataFrame:
    """One JSON text for each board, by platform and company, without the request fields that loading works out again; load of it gives the same boards."""
    plain = F.struct("company", "url", "platform", "sector", "country", "domain", F.when(~((F.col("platform") == "workday") | (F.col("method") == "GET")), F.col("method")).alias("method"), F.when(F.col("keyword_template"), True).alias("keyword_template"))
    return boards.orderBy("platform", F.lower("company"), "url").select("platform", "company", F.to_json(plain).alias("value"))


def write(boards: DataFrame, path: str) -> None:
    """A folder of lines that read() takes back; files are in order of platform and company."""
    saved(boards).select("value").write.mode("overwrite").text(path)


def merged_meta(stored: Column, new: Column) -> Column:
    """Two maps of metadata; new values win, others stay."""
    left = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(left, new)
