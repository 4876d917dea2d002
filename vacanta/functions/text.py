"""Text, dates and flags as boards write them."""

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacanta.functions import rules
from vacanta.functions.place import has, let

#: Words that say remote, and that deny it.
REMOTE_WORDS = r"\bremote\b|\bwork from home\b|\bwfh\b|\bdistributed\b"
NOT_REMOTE_WORDS = r"\bnon.?remote\b|\bno remote\b|\bhybrid only\b"
#: Fixed value: the keys of an object that hold its text, in the order of choice.
TEXT_KEYS = ["rendered", "name", "label", "text", "value"]
#: Date forms beside those that begin with year, month and day.
DATE_FORMS = ["d/M/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy"]


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_of(*values: Column) -> Column:
    """The first that is not null or empty, else empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def named_references() -> tuple[str, str]:
    """The named references of HTML 5 by their first letter, as JSON, and a pattern of the names that need no semicolon, longest first."""
    by_first: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        by_first.setdefault(name[0], {})[name] = text
    loose = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return json.dumps(by_first).replace("'", "\\u0027"), f"^(?:{'|'.join(loose)})"


NAMED, LOOSE = named_references()
#: What the numbers 128 to 159 stand for in old pages, where they stand for anything.
OLD_PAGE = "".join(bytes([n]).decode("cp1252", errors="ignore") or chr(n) for n in range(0x80, 0xA0))


def letting(name: str, value: str, use: str) -> str:
    """SQL of use, in which name stands for value, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def applied(c: Column, body: str) -> Column:
    """SQL in x with c for x, evaluated once. Text is read and built much faster than Column calls where a function is used often."""
    return F.get(F.call_function("transform", F.array(c), F.expr(f"x -> {body}")), F.lit(0))


#: The character of a numeric reference, code; null is a number too large. Some numbers stand for none.
NUMBERED = f"""CASE WHEN code IS NULL OR code > 1114111 OR code BETWEEN 55296 AND 57343 OR code = 0 THEN '\\ufffd'
  WHEN code BETWEEN 128 AND 159 THEN substring({"'" + "".join(f"\\u{ord(x):04x}" for x in OLD_PAGE) + "'"}, CAST(code - 127 AS INT), 1)
  WHEN code BETWEEN 1 AND 8 OR code = 11 OR code BETWEEN 14 AND 31 OR code = 127 OR code BETWEEN 64976 AND 65007 OR (code & 65535) >= 65534 THEN ''
  ELSE decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32') END"""
CODE = r"""CASE WHEN part RLIKE r'^#[0-9]' THEN try_cast(regexp_replace(regexp_extract(part, r'^#([0-9]+)', 1), r'^0+(?=.)', '') AS BIGINT)
  ELSE try_cast(conv(nullif(regexp_extract(part, r'^#[xX]0*([0-9a-fA-F]{1,8})(?![0-9a-fA-F])', 1), ''), 16, 10) AS BIGINT) END"""
LOOK = "try_element_at(try_element_at(from_json(r'{}', 'map<string, map<string, string>>'), substring({}, 1, 1)), {})"
NAME = "regexp_extract(part, r'^[A-Za-z][A-Za-z0-9]{0,30};', 0)"


def reference(closed: bool) -> str:
    """What stands after an ampersand, with the reference that it begins with resolved: a number, a name with its semicolon, or the longest old name.

    closed: as in XML, what lacks its semicolon is no reference.
    """
    old = "NULL" if closed else letting("name", f"regexp_extract(part, r'{LOOSE}', 0)", f"concat({LOOK.format(NAMED, 'name', 'name')}, substring(part, length(name) + 1))")
    return f"""CASE WHEN part RLIKE r'^#(?:[0-9]+|[xX][0-9a-fA-F]+){";" if closed else ""}' THEN concat({letting("code", CODE, NUMBERED)}, regexp_replace(part, r'^#(?:[0-9]+|[xX][0-9a-fA-F]+);?', ''))
  ELSE coalesce({letting("name", NAME, f"concat({LOOK.format(NAMED, 'name', 'name')}, substring(part, length(name) + 1))")}, {old}, concat('&', part)) END"""


def unescaped(x: str, closed: bool = False) -> str:
    """Of SQL that is short, as it is written three times."""
    return f"CASE WHEN contains({x}, '&') THEN array_join(transform(split({x}, '&'), (part, i) -> CASE WHEN i = 0 THEN part ELSE {reference(closed)} END), '') ELSE {x} END"


def unescape(c: Column) -> Column:
    """Character references as HTML 5 reads them: named ones, of the old names also without semicolon, and numbers."""
    return applied(c, unescaped("x"))


def squeezed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def flattened(x: str, closed: bool = False) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({unescaped(x, closed)}, '<[^>]+>', ' '), r'(?U)\\s+', ' '), '^ | $', '')"


def flat(c: Column, closed: bool = False) -> Column:
    """Readable text of a string that may hold markup: references first, then tags, then white space. Null is empty.

    closed: references need their semicolon, as in XML; one that a page cuts off stays as it is written.
    """
    return applied(blank(c), flattened("x", closed))


# Values that are objects or lists themselves are not text.
FIELDS = "map_filter(from_json(x, 'map<string, string>'), (k, v) -> NOT startswith(v, '{') AND NOT startswith(v, '['))"
OBJECT = letting("m", FIELDS, f"coalesce({', '.join(f"try_element_at(m, '{k}')" for k in TEXT_KEYS)}, array_join(map_values(m), ' '), x)")
NODE = letting("y", f"CASE WHEN startswith(x, '{{') THEN {OBJECT} WHEN startswith(x, '[') THEN coalesce(array_join(from_json(x, 'array<string>'), ', '), x) ELSE x END", flattened("y"))


def node(c: Column) -> Column:
    """Readable text of a JSON node given as text: of an object its first known key, else its values; of a list its items."""
    return applied(blank(c), NODE)


def date_of(c: Column) -> Column:
    """The day that is written, or null. Numbers are seconds, or milliseconds above 1e11, and give the day in UTC."""
    number = F.expr("1.0D") * F.when(c.rlike(r"^-?\d{9,}(\.\d+)?$"), c).try_cast("double")
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    written = F.regexp_extract(blank(c), r"\d{4}-\d{2}-\d{2}", 0)
    tidy = F.initcap(F.lower(F.trim(c)))
    other = F.coalesce(*(F.try_to_timestamp(tidy, F.lit(f)).cast("date") for f in DATE_FORMS))
    return F.when(number.isNotNull(), F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))).when(written != "", F.try_to_timestamp(written, F.lit("yyyy-MM-dd")).cast("date")).otherwise(other)


def remote_of(*bits: Column) -> Column:
    """True, false, or null when nothing is said."""
    said = F.concat_ws(" ", *bits)
    return let(said, lambda t: F.when(has(t, REMOTE_WORDS), ~has(t, NOT_REMOTE_WORDS)))


def lines_of(html: Column) -> Column:
    """The text of a detail page with its line breaks: tags first, then references, so escaped markup stays as text."""
    broken = F.regexp_replace(blank(html), r"(?i)<br\s*/?>|</p>|</li>", "\n")
    text = unescape(F.regexp_replace(broken, r"<[^>]+>", " "))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)[\s&&[^\n]]+", " "))), lambda x: x != "")
    return F.array_join(lines, "\n")


def before_query(url: Column) -> Column:
    return F.substring_index(blank(url), "?", 1)


def posting_number(url: Column) -> Column:
    """The digits, six or more, that end a part of a posting's url."""
    return F.regexp_extract(before_query(url), r"(\d{6,})(?:[/?#]|$)", 1)


def detail_key(url: Column) -> Column:
    """The url that a posting's detail page is stored under: the board's own for a public Workday url, else the same."""
    p, plain = r"^https://([^/]+)/(?:[a-z]{2}-[A-Z]{2}/)?([^/]+)/job/(.+)$", before_query(url)
    host = F.regexp_extract(plain, p, 1)
    own = F.concat(F.lit("https://"), host, F.lit("/wday/cxs/"), F.substring_index(host, ".", 1), F.lit("/"), F.regexp_extract(plain, p, 2), F.lit("/job/"), F.regexp_extract(plain, p, 3))
    return F.when(host != "", own).otherwise(blank(url))


#: Fixed value: sections of a SmartRecruiters page in the order they are shown.
SECTIONS = ["jobDescription", "qualifications", "additionalInformation", "companyDescription"]


def sections(payload: Column) -> Column:
    parts = [F.nullif(lines_of(F.get_json_object(payload, f"$.jobAd.sections.{s}.text")), F.lit("")) for s in SECTIONS]
    return F.concat_ws("\n\n", *parts)


def capped_location(location: Column) -> Column:
    """The first place and how many more, of more than two divided by bars (or else slashes) or more than three by commas."""
    loc = F.trim(blank(location))

    def parts(by: str) -> Column:
        return F.filter(F.transform(F.split(loc, by), lambda x: F.trim(x)), lambda x: x != "")

    def cut(p: Column, most: int) -> Column:
        return F.when(F.size(p) > most, F.concat(F.get(p, F.lit(0)), F.lit(" +"), (F.size(p) - 1).cast("string"), F.lit(" more"))).otherwise(loc)

    bars, slashes, commas = parts(r"\|"), parts("/"), parts(",")
    shown = F.when(F.size(bars) > 1, cut(bars, 2)).when(F.size(slashes) > 1, cut(slashes, 2)).when(F.size(commas) > 3, cut(commas, 1)).otherwise(loc)
    return F.when(loc == "", "Location not stated").otherwise(shown)


def spaced_name(c: Column) -> Column:
    """Lower-case letters and digits, words one space apart."""
    return F.trim(F.regexp_replace(F.lower(blank(c)), r"[^a-z0-9]+", " "))


def bare_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(blank(c)), r"[^a-z0-9]", "")


def repaired_url(url: Column) -> Column:
    return F.regexp_replace(url, r"^(https://jobs\.smartrecruiters\.com/[^/]+)/postings/", "$1/")


def fit_band(fit: Column) -> Column:
    """good from 70, mid from 50, else low; null where nothing was judged."""
    return F.when(fit.isNull() | (fit < 0), None).when(fit >= 70, "good").when(fit >= 50, "mid").otherwise("low")


def known_as(value: Column, names: dict[str, str], codes: list[str]) -> Column:
    """The code that a name stands for, or the code itself; what is neither is an error. Blank is null."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    code = F.coalesce(F.try_element_at(table, value), F.upper(value))
    refused = F.raise_error(F.concat(F.lit("not known: "), value))
    return F.when(blank(value) == "", None).when(code.isin(*codes), code).otherwise(refused)


def country_code(name: Column) -> Column:
    return known_as(F.lower(F.trim(name)), rules.COUNTRY_NAMES, [c for c, _ in rules.COUNTRIES])


def currency_code(name: Column) -> Column:
    return known_as(F.upper(F.trim(name)), rules.CURRENCY_NAMES, rules.CURRENCIES)
