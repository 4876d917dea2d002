"""Title, level, working mode and right to work; keys and links of a posting."""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacanta.functions import rules
from vacanta.functions.place import has, let


def seniority(title: Column) -> Column:
    """0 when nothing tells; a junior word wins over all others."""
    title = F.coalesce(title, F.lit(""))
    (junior, first), *others = rules.LEVELS
    return F.when(has(title, first), junior).otherwise(F.greatest(F.lit(0), *(F.when(has(title, p), n).otherwise(0) for n, p in others)))


def mentions(low: Column, words: list[str]) -> Column:
    """Whether lower-case text holds any of these: much cheaper than a pattern, and most texts go no further."""
    return reduce(lambda a, b: a | b, (low.contains(w) for w in words))


def work_mode(title: Column, location: Column, description: Column, remote: Column) -> Column:
    """hybrid before office before remote (by flag or text) before unstated."""

    def mode(text: Column, low: Column) -> Column:
        hybrid = mentions(low, ["hybrid", "office", "site"]) & has(text, rules.HYBRID)
        office = mentions(low, ["office", "site", "person"]) & has(text, rules.ONSITE)
        remote_text = mentions(low, ["remote", "anywhere"]) & has(text, rules.REMOTE)
        return F.when(hybrid, "hybrid").when(office, "office").when(F.coalesce(remote, F.lit(False)) | remote_text, "remote").otherwise("unstated")

    return let(F.concat_ws(" ", title, location, description), lambda t: let(F.lower(t), lambda low: mode(t, low)))


def work_rights(description: Column) -> Column:
    """A refusal of sponsorship before export control before an offer; empty when nothing is said."""

    def note(text: Column, low: Column) -> Column:
        refused = mentions(low, ["sponsor", "visa", "permit", "right"]) & has(text, rules.NO_SPONSOR)
        controlled = mentions(low, ["export", "itar", "ear", "author", "person", "citizen", "clearance", "vetting"]) & has(text, rules.EXPORT_CONTROL)
        offered = mentions(low, ["sponsor", "visa"]) & has(text, rules.WILL_SPONSOR)
        return F.when(refused, "no sponsorship").when(controlled, "export control or clearance").when(offered, "sponsorship offered").otherwise("")

    return let(F.coalesce(description, F.lit("")), lambda t: let(F.lower(t), lambda low: note(t, low)))


def any_of(terms: list[str]) -> str:
    """One pattern of literal terms, longest first, with a word's edge where a term has a letter or digit."""
    edge = lambda c: r"\b" if c.isalnum() else ""
    return "|".join(edge(t[0]) + re.escape(t) + edge(t[-1]) for t in sorted(terms, key=len, reverse=True))


def whole_words(terms: list[str]) -> str:
    """One pattern of literal terms, longest first, between edges of words."""
    return r"\b(?:" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + r")\b"


def any_place(terms: list[str]) -> str:
    """One pattern of literal terms anywhere in a place."""
    return "|".join(re.escape(t) for t in terms)


#: Short forms in titles and what they stand for.
SHORT_FORMS = [
    ("fp&a", "financial planning and analysis"), ("hr", "human resources"), ("qa", "quality assurance"), ("pm", "project manager"), ("bd", "business development"),
    ("sre", "site reliability engineer"), ("ml", "machine learning"), ("bi", "business intelligence"), ("ux", "user experience"), ("cs", "customer success"),
    ("m&a", "mergers and acquisitions"), ("ap", "accounts payable"), ("ar", "accounts receivable"),
]


def title_variants(terms: list[str]) -> list[str]:
    """Wanted titles with short forms written out and the reverse, wherever they stand, and with '&' for 'and'; on the driver.

    Two rounds, as a form that is written out may hold an 'and'.
    """
    swaps = SHORT_FORMS + [(long, short) for short, long in SHORT_FORMS]
    joins = [("&", " and "), (" and ", " & ")]

    def tidy(t: str) -> str:
        return " ".join(t.split())

    known = {tidy(t.lower()) for t in terms}
    for _ in range(2):
        known |= {t.replace(x, y) for t in known for x, y in swaps}
        known |= {tidy(t.replace(x, y)) for t in known for x, y in joins}
    return sorted(filter(None, map(tidy, known)))


def reason_key(reason: Column) -> Column:
    """A drop reason without what stands in brackets."""
    short = F.trim(F.regexp_replace(reason, r"\(.*?\)", ""))
    return F.when(short == "", reason).otherwise(short)

def uid(url: Column, company: Column, title: Column, location: Column) -> Column:
    link = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    basis = F.when(link != "", F.regexp_replace(link, r"[?#].*$", "")).otherwise(F.lower(F.concat_ws("|", company, title, location)))
    return F.substring(F.sha1(basis), 1, 16)


def source_key(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def directness(platform: Column) -> Column:
    p = F.lower(F.coalesce(platform, F.lit("")))
    return F.when(p == "linkedin", 0).when(p == "nhs", 1).otherwise(2)


def safe_url(url: Column) -> Column:
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[^\x20-\x7E\xA0-\x{10FFFF}]", "")
    return F.when(clean.rlike("(?i)^(https?://|mailto:)"), clean).otherwise("")
