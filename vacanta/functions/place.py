"""Countries and towns of a location string."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacanta.functions import rules


def ignoring_case(pattern: str) -> str:
    """Case is ignored for all letters, and \\w and \\s are those of Unicode."""
    return "(?iuU)" + pattern


def has(text: Column, pattern: str) -> Column:
    return text.rlike(ignoring_case(pattern))


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def country_of(location: Column) -> Column:
    """A country named outright, else a US state after a comma, else a known town; the first rule that holds."""

    def first(low: Column) -> Column:
        named = [F.when(low.rlike("(?U)" + p), F.lit(c)) for c, p in rules.COUNTRIES]
        state = location.rlike(r",\s*(?:" + "|".join(rules.STATE_CODES) + r")\b") | low.rlike(r",\s*(?:" + "|".join(rules.STATE_NAMES) + r")\b")
        towns = [F.when(low.rlike("(?U)" + p), F.lit(c)) for c, p in rules.CITIES]
        return F.coalesce(*named, F.when(state, F.lit("US")), *towns)

    return let(F.lower(location), first)


def countries_in(location: Column) -> Column:
    """All countries named, ascending."""
    parts = F.array_distinct(F.array_compact(F.transform(F.split(F.coalesce(location, F.lit("")), rules.SPLIT), country_of)))
    return let(parts, lambda found: F.array_sort(F.when(F.size(found) > 0, found).otherwise(F.array_compact(F.array(country_of(location))))))


def remote_scope(description: Column) -> Column:
    """Countries that the body of a remote role limits it to."""
    phrases = F.regexp_extract_all(F.coalesce(description, F.lit("")), F.lit(ignoring_case(rules.REMOTE_SCOPE)), F.lit(0))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(phrases, countries_in))))


def generic_remote(location: Column) -> Column:
    return has(location, rules.GENERIC_REMOTE)


def city_of(location: Column) -> Column:
    x = F.element_at(F.split(F.coalesce(location, F.lit("")), r"[|/]"), 1)
    x = F.regexp_replace(x, "(?iu)" + rules.MODE_PREFIX, "")
    x = F.regexp_replace(F.element_at(F.split(x, ","), 1), r"^[ \-–—]+|[ \-–—]+$", "")
    x = F.regexp_replace(x, rules.COUNTRY_STATE_PREFIX, "")
    x = F.regexp_replace(x, "(?i)" + rules.AREA_SUFFIX, "")
    x = F.regexp_replace(x, "(?i)" + rules.POSTCODE_SUFFIX, "")
    return let(x, lambda town: F.when((town == "") | has(town, rules.NOT_A_CITY) | (F.length(town) > 34), F.lit("")).otherwise(F.trim(town)))


def posting_country(tag: Column, found: Column) -> Column:
    return F.coalesce(F.nullif(tag, F.lit("")), F.when(F.size(found) == 1, F.get(found, F.lit(0))).when(F.size(found) > 1, F.lit("multiple")))
