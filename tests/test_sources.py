import html
import json
import random
from html.entities import html5

import duckdb
import pytest
from pyspark.sql import functions as F

from vacanta import source_queries
from vacanta.functions import text
from vacanta.sources import boards, discover, registry

RAW = "source_key string, company string, platform string, url string, payload string"


def test_references_are_read_as_pages_mean_them(spark):
    rnd = random.Random(1)
    cases = [
        "Children&apos;s nurse", "a &check; b", "x &amp y", "&ampx", "&notit; &notin; &not", "&#8217;&#x2019;s", "&#128;&#150;&#129;", "&#0;&#1;&#xD800;&#99999999999999999999;", "&#x110000;&#xFFFFFFFFFFFF;",
        "&NotEqualTilde;", "&;&&amp;&", "&#;", "&#x;", "AT&T", "&copy2026", "&lt;p&gt;", "&#x26;lt;", "&frac12 &frac12;x", "&#65 B", "&#x41G", "&#xfdd0;&#xfffe;&#127;&#13;&#11;", "", "&" * 50,
    ]
    cases += ["&" + rnd.choice(list(html5)) + rnd.choice(["", "x", " ", ";", "1"]) for _ in range(500)]
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", text.unescape(F.col("c")).alias("read")).collect()
    assert {r["c"]: r["read"] for r in rows} == {c: html.unescape(c) for c in cases}
    nulls = spark.createDataFrame([(None,)], "c string").select(text.unescape(F.col("c")), text.flat(F.col("c")), text.node(F.col("c"))).first()
    assert tuple(nulls) == (None, "", "")


def test_a_page_keeps_references_that_are_cut_off(spark, tmp_path):
    """page_texts on pages whose references lack their semicolon gives the rows of its SQL; flat() reads them as HTML 5 does unless told."""
    cut = [(1, "https://x/a", "<b>A &amp; B</b> les&&amp</p> &quot"), (2, "https://x/b", "&copy; 2026 &am &ampx &lt;p&gt; &notit &nbsp;&#65")]
    pages = spark.createDataFrame(cut, "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(source_queries.oracle_sql()["page_texts"])
    got = source_queries.page_texts(spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert [r[0] for r in pages.orderBy("page_id").select(text.flat(F.col("html"))).collect()] == ['A & B les&& "', "© 2026 &am &x ¬it A"]


def deep(levels: int, inner):
    for _ in range(levels):
        inner = {"x": 1, "below": inner}
    return inner


def titles(spark, payload):
    raw = spark.createDataFrame([("k", "C", "else", "u", payload if isinstance(payload, str) or payload is None else json.dumps(payload))], RAW)
    return [r["title"] for r in boards.parse(raw, {}).orderBy("place").collect()]


JOB = [{"title": "A", "url": "https://x/a"}, "no object", {"name": "B", "link": "https://x/b"}, {"name": "C", "link": "ftp://x"}]


@pytest.mark.parametrize(
    ("payload", "want"),
    [
        (JOB, ["A", "B"]), (deep(1, JOB), ["A", "B"]), (deep(6, JOB), ["A", "B"]), (deep(7, JOB), []),
        ({"first": [{"id": 1}], "second": JOB}, ["A", "B"]), ({"first": {"a": [1, 2], "b": {"c": JOB}}, "second": [{"title": "Z", "url": "https://z"}]}, ["A", "B"]),
        ([[{"id": 1}], JOB], ["A", "B"]), ([0] * 50 + [JOB], []), ({"x": [{"title": None}]}, []), ("no json", []), ("", []), (None, []), ("[]", []), ("{}", []), (" \n" + json.dumps(JOB), ["A", "B"]),
    ],
)
def test_the_walk_to_the_first_list(spark, payload, want):
    assert titles(spark, payload) == want


def test_one_scan_for_all_formats(spark, tmp_path):
    rows = [("a", "C", "lever", "u", json.dumps([{"text": "L", "hostedUrl": "https://l"}])), ("b", "C", "greenhouse", "u", json.dumps({"jobs": [{"title": "G", "absolute_url": "https://g"}]})), ("c", "C", "mine", "u", "L|https://m"), ("d", "C", "lever", "u", "[oops"), ("e", "C", None, "u", None)]
    spark.createDataFrame(rows, RAW).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    mine = lambda payload, board, url: F.array(boards.item(F.substring_index(payload, "|", 1), F.substring_index(payload, "|", -1), F.lit("Leeds"), []))
    got = boards.parse(raw, boards.BOARDS | {"mine": mine})
    assert {(r["source_key"], r["platform"], r["title"], r["location"]) for r in got.collect()} == {("a", "lever", "L", ""), ("b", "greenhouse", "G", ""), ("c", "mine", "L", "Leeds")}
    assert str(got._jdf.queryExecution().executedPlan()).count("FileScan") == 1
    every = boards.parse(raw, every=True)
    assert {(r["source_key"], r["title"]) for r in every.collect()} == {("a", "L"), ("b", "G"), ("c", None), ("d", None), ("e", None)}


def test_registry_folders(spark, tmp_path):
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    lines = ['{"company": "A", "url": "https://a#x"}', '{"json": {"company": "B", "url": "https://b"}}', '{"company": "broken', "", '{"company": "no url"}', "[1]"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(first)
    spark.createDataFrame([('{"company": "again", "url": "https://a"}',), ('{"company": "C", "url": "https://c", "extra": 1}',)], "value string").coalesce(1).write.text(second)
    entries = registry.read(spark, first, second)
    loaded = registry.load(entries)
    assert [r["company"] for r in loaded.orderBy("file", "place").collect()] == ["A", "B", "again", "C"]
    assert {r["company"] for r in registry.unique(registry.expand(loaded, [])).collect()} == {"A", "B", "C"}
    assert [r["entry"] for r in registry.rejected(entries).orderBy("file", "place").collect()] == [lines[2], lines[4], lines[5]]
    saved = str(tmp_path / "saved")
    registry.write(loaded, saved)
    again = registry.load(registry.read(spark, saved))
    assert sorted(map(repr, again.select("company", "url", "platform").collect())) == sorted(map(repr, loaded.select("company", "url", "platform").collect()))
    assert registry.load(registry.entries_of(spark.createDataFrame([(0, '{"sources": [{"company": "A", "url": "https://a"}]}'), (1, "[]"), (2, "oops")], "file int, value string"))).count() == 1


def test_pages_of_one_url_are_read_apart(spark):
    link = "<script>phApp.ddo = {}</script> https://jobs.lever.co/acme/1 https://jobs.lever.co/acme/2 https://jobs.lever.co/api"
    pages = spark.createDataFrame([("https://a.example/x", link), ("https://a.example/x", link), (None, "https://jobs.lever.co/acme/3")], "url string, html string")
    got = [tuple(r) for r in discover.boards_in(pages).select("url", "platform", "token").collect()]
    want = [("https://a.example/x", "lever", "acme"), ("https://a.example/x", "phenom", "a.example")]
    assert sorted(got, key=str) == sorted(want * 2 + [(None, "lever", "acme")], key=str)


def test_pages_are_read_to_their_end(spark):
    """A board is found behind 400,000 signs and more, words or one long run; names that follow each other without a gap are found as before."""
    end = " https://jobs.lever.co/acme https://beta.recruitee.com/x"
    pages = spark.createDataFrame([("https://w.example/", "word ", 90_000, end), ("https://r.example/", "a", 450_000, end), ("https://n.example/", "", 0, "aa.recruitee.combb.recruitee.com .icims.com A-1.fa.x.oraclecloud.com")], "url string, x string, n int, e string")
    found = discover.boards_in(pages.withColumn("html", F.concat(F.repeat("x", F.col("n")), "e"))).select("url", "platform", "token").collect()
    want = [(f"https://{x}.example/", *b) for x in "wr" for b in (("lever", "acme"), ("recruitee", "beta"))]
    assert sorted(map(tuple, found)) == sorted([*want, ("https://n.example/", "recruitee", "aa"), ("https://n.example/", "recruitee", "bb"), ("https://n.example/", "oracle", "A-1.fa.x.oraclecloud.com")])
