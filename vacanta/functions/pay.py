"""Pay: a struct of min, max, currency, period, raw and confirmed, read from text."""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacanta.functions import rules
from vacanta.functions.place import has, ignoring_case, let

KIND = "struct<min: double, max: double, currency: string, period: string, raw: string, confirmed: boolean>"


def salary(low=None, high=None, currency=None, period=None, raw=None, confirmed=False) -> Column:
    parts = [F.lit(x) if not isinstance(x, Column) else x for x in (low, high, currency, "year" if period is None else period, raw, confirmed)]
    names = ["min", "max", "currency", "period", "raw", "confirmed"]
    return F.struct(*(p.alias(n) for p, n in zip(parts, names, strict=True))).cast(KIND)


def top(s: Column) -> Column:
    return F.coalesce(s["max"], s["min"])


def annualised(s: Column, days: int = 220, hours: int = 8) -> Column:
    return top(s) * F.when(s["period"] == "day", days).when(s["period"] == "hour", days * hours).otherwise(1)


def number(token: Column) -> Column:
    plain = F.regexp_replace(F.trim(token), ",", "")
    scale = F.when(F.lower(plain).endswith("k"), 1000.0).otherwise(1.0)
    return F.expr("1.0D") * F.regexp_replace(plain, r"\s?[kK]$", "").try_cast("double") * scale


def holds(low: Column, *parts: str) -> Column:
    """Whether a lower-case text holds one of the parts: a search that spares most texts a pattern."""
    return reduce(or_, map(low.contains, parts))


def period_of(text: Column) -> Column:
    return let(F.lower(text), lambda low: F.when(holds(low, "da", "pd") & has(text, rules.PER_DAY), "day").when(holds(low, "hr", "hour") & has(text, rules.PER_HOUR), "hour").otherwise("year"))


def from_figure(text: Column) -> Column:
    """The text from its first digit on, with the sign and space before it, where any pattern of pay begins at the earliest."""
    return F.regexp_extract(text, r"(?sU).{0,2}\d.*", 0)


def scan(text: Column, default: Column, need_context: bool) -> Column:
    """A range, else a single figure; figures that only a word can tell from prose need one in the 120 characters before."""

    def introduced(t: Column, pattern: str) -> Column:
        at = F.regexp_instr(t, F.lit(pattern))
        return has(F.substring(t, F.greatest(F.lit(1), at - 120), F.least(F.lit(120), at - 1)), rules.PAY_WORD)

    def code(symbol: Column) -> Column:
        return F.coalesce(F.when(symbol == "£", "GBP").when(symbol == "$", "USD").when(symbol == "€", "EUR"), default)

    def look(t: Column, tail: Column, period: Column, ranges: str, singles: str) -> Column:
        both, one = ignoring_case(ranges), ignoring_case(singles)

        def single(m: Column) -> Column:
            value = number(F.regexp_extract(m, one, 2))
            doubt = ~introduced(t, one) if need_context else F.lit(False)
            good = (m != "") & ~doubt & F.coalesce(value > 0, F.lit(False))
            return F.when(good, salary(value, value, code(F.regexp_extract(m, one, 1)), period, F.trim(m), True)).otherwise(salary())

        def ranged(m: Column) -> Column:
            # The match is read again for its parts: short, whatever the length of the text.
            mark = F.coalesce(F.nullif(F.regexp_extract(m, both, 1), F.lit("")), F.nullif(F.regexp_extract(m, both, 3), F.lit("")))
            low, high = number(F.regexp_extract(m, both, 2)), number(F.regexp_extract(m, both, 4))
            doubt = F.lit(True) if need_context else mark.isNull()
            return (
                F.when((m != "") & doubt & ~introduced(t, both), salary())
                .when((m != "") & (high >= low), salary(low, high, code(mark), period, F.trim(m), True))
                .otherwise(let(F.regexp_extract(tail, one, 0), single))
            )

        return let(F.regexp_extract(tail, both, 0), ranged)

    def by_period(t: Column) -> Column:
        # Rates have to carry a sign at their first figure; yearly figures need not.
        return let(from_figure(t), lambda tail: let(period_of(t), lambda p: F.when(p == "year", look(t, tail, p, rules.YEAR_RANGE, rules.YEAR_SINGLE)).otherwise(look(t, tail, p, rules.RATE_RANGE, rules.RATE_SINGLE))))

    return let(text, lambda t: F.when(t.rlike(r"\d"), by_period(t)).otherwise(salary()))


def parse(text: Column, default: Column | None = None) -> Column:
    """Each pattern is run once on a text; texts without a digit are not searched at all."""
    default = F.lit(None).cast("string") if default is None else default

    def whole(full: Column) -> Column:
        first, rest = F.substring(full, 1, 400), F.substring(full, 401, 19600)
        silent = let(F.lower(first), lambda low: holds(low, "compet", "doe", "depend", "negot")) & has(first, rules.NOISE) & ~first.rlike(r"[£$€]\s?\d")
        near = let(scan(first, default, False), lambda s: F.when(s["confirmed"] | (F.length(full) <= 400), s).otherwise(scan(rest, default, True)))
        return F.when(full == "", salary()).when(silent, salary(raw=F.substring(F.trim(first), 1, 120))).otherwise(near)

    # Single spaces stay as they are, so most texts have nothing to replace.
    return let(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s{2,}|[\s&&[^ ]]", " ")), whole)


def from_range(low_cents: Column, low_value: Column, low_plain: Column, high_cents: Column, high_value: Column, high_plain: Column, currency: Column, title: Column) -> Column:
    """Pay of a structured range in cents or units; the high end falls back to the low one. Null without any figure."""

    def amount(cents: Column, *units: Column) -> Column:
        return F.coalesce(F.when(cents > 0, cents / 100.0), *(F.when(u > 0, u.cast("double")) for u in units))

    def both(x: Column) -> Column:
        low, high = x["low"], x["high"]
        shown = F.concat(F.format_number(low, 0), F.lit("-"), F.format_number(high, 0))
        raw = F.when(low.isNotNull() & high.isNotNull(), F.coalesce(F.nullif(title, F.lit("")), shown))
        return F.when(low.isNotNull() | high.isNotNull(), salary(low, F.coalesce(high, low), currency, F.lit("year"), raw, True))

    return let(F.struct(amount(low_cents, low_value, low_plain).alias("low"), amount(high_cents, high_value, high_plain).alias("high")), both)


def label(s: Column) -> Column:
    code = F.upper(F.coalesce(s["currency"], F.lit("")))
    sign = F.when(code == "GBP", "£").when(code == "USD", "$").when(code == "EUR", "€").otherwise(F.concat(F.coalesce(s["currency"], F.lit("")), F.when(code == "", "").otherwise(" ")))
    per = F.when(s["period"] == "day", "/day").when(s["period"] == "hour", "/hr").otherwise("")

    def shown(v: Column) -> Column:
        thousands = F.concat(sign, F.format_number(v / 1000, 0), F.lit("k"))
        return F.when((s["period"] == "year") & (v >= 10_000), thousands).otherwise(F.concat(sign, F.format_number(v, 0)))

    band = s["min"].isNotNull() & s["max"].isNotNull() & (s["min"] != s["max"])
    said = F.when(band, F.concat(shown(s["min"]), F.lit(" - "), shown(s["max"]), per)).when(top(s).isNotNull(), F.concat(shown(top(s)), per)).otherwise(F.coalesce(s["raw"], F.lit("salary stated")))
    return F.when(s["confirmed"], said).otherwise("unconfirmed salary")


def clears_floor(s: Column, floor: float | None, currency: str | None) -> Column:
    """struct<keep, why>: what can't be compared is kept, with a note."""
    def verdict(keep: bool, why) -> Column:
        return F.struct(F.lit(keep).alias("keep"), (why if isinstance(why, Column) else F.lit(why)).alias("why"))

    if not floor:
        return verdict(True, "")
    out = F.when(~s["confirmed"], verdict(True, "unconfirmed salary"))
    if currency:
        out = out.when(s["currency"] != currency, verdict(True, F.concat(F.lit("salary in "), s["currency"], F.lit(f", floor in {currency}, not compared"))))
        out = out.when(s["currency"].isNull(), verdict(True, f"salary has no currency, floor in {currency}, not compared"))
    year = annualised(s)
    below = verdict(False, F.concat(F.lit("stated pay "), F.coalesce(s["raw"], F.format_number(year, 0)), F.lit(" below floor")))
    return out.when(year.isNull(), verdict(True, "unconfirmed salary")).when(year < floor, below).otherwise(verdict(True, ""))
