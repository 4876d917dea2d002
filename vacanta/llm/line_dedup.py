"""Line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host. The pages that hold a line (counted once a page, white space at its ends aside) are
divided by all pages of the host; a line above the ratio is boilerplate there and goes from every page of the
host. Hosts with fewer pages than min_pages, and pages without host, keep all lines. Blank lines stay as they are.
A null text has no lines and stays null; an empty one stays empty; repeated rows count as pages of their own.

Counting is a grouped sum with partial sums in every task, so a host with a third of all pages adds one row for
each task and line. The boilerplate of a host is one array; it has at most (mean lines of a page) / ratio entries,
whatever the number of pages, so the join that brings it back has a bounded side for each host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacanta.llm.shared import written


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """For each host with any: the hashes of its boilerplate lines. pages has host and text."""
    own = F.array_distinct(F.transform(F.filter(lines(F.col("text")), lambda x: F.trim(x) != ""), key))
    named = pages.filter("host <> ''").select("host", own.alias("own"))
    # The page itself is counted as a line of hash null, so that totals need no second pass.
    each = named.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.coalesce("own", F.array().cast("array<bigint>")))).alias("line"))
    count = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    total = count.filter(F.col("line").isNull() & (F.col("n") >= min_pages)).select("host", F.col("n").alias("total"))
    often = count.filter(F.col("line").isNotNull() & (F.col("n") > ratio * min_pages)).join(total, "host")
    return often.filter(F.col("n") > ratio * F.col("total")).groupBy("host").agg(F.collect_list("line").alias("drop"))


def drop_boilerplate(pages: DataFrame, host: str, text: str = "text", ratio: float = 0.3, min_pages: int = 5) -> DataFrame:
    """pages with text less its boilerplate lines, and n_lines and n_dropped (of those not blank).

    Columns of pages may have any names; those named n_lines or n_dropped give way to these.
    """
    # Written, so that Spark knows its size: small lists are broadcast and pages stay where they are; larger ones
    # are joined by host, where a hot host's pages can be split, as nothing but the join is in that stage.
    found = written(boilerplate(pages.select(F.col(host).alias("host"), F.col(text).alias("text")), ratio, min_pages), "boilerplate")
    row = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), F.col(host).alias("host"), F.col(text).alias("text"))
    joined = row.join(found, "host", "left")
    full = F.filter(lines(F.col("text")), lambda x: F.trim(x) != "")
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(lines(F.col("text")), lambda x: (F.trim(x) == "") | ~F.array_contains("drop", key(x))), "\n")
    )
    dropped = F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size(F.filter(full, lambda x: F.array_contains("drop", key(x)))))
    none = F.col("text").isNull()
    counts = [F.when(none, 0).otherwise(F.size(full)).cast("long").alias("n_lines"), F.when(none, 0).otherwise(dropped).cast("long").alias("n_dropped")]
    names = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    # Named only at the end: an input column named drop must not be taken for the list of lines.
    same = [(kept if c == text else F.col("row")[c]).alias(f"c{i}") for i, c in enumerate(names)]
    return joined.select(*same, *counts).toDF(*names, "n_lines", "n_dropped")


#: Each element that ends a line in the text of a page.
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"


def page_text(html: Column) -> Column:
    """The text of a page: scripts, styles and comments go, block elements end a line, blank lines go."""
    x = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    x = F.regexp_replace(F.replace(x, F.lit("\n"), F.lit(" ")), rf"(?i)</?({BLOCKS})([ /][^>]*)?>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    x = F.regexp_replace(x, r"[ \t\r\f]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r" ?\n[ \n]*", "\n"), r"^\n|\n$", ""))


def page_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]*)", 1))
