import re

import pytest
from pyspark.sql import functions as F

from vacanta import queries
from vacanta.functions import role, text
from vacanta.operators import documents, history, screen
from vacanta.sources import boards

NUMBER = re.compile(r"(?<![\w.])\d[\d,.]*\s?[%kKmMbB]?(?![\w])")


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_titles(spark):
    cv = "Senior Data Engineer, Acme (2019 - 2021)\n  Data Engineer | Beta\nHead of Finance at Gamma\nan engineer by heart\nData engineer\nManager of Sales, X"
    got = one(spark, documents.titles(F.col("t")), t=cv)
    assert got == ["data engineer", "head of finance", "manager of sales"]
    assert one(spark, documents.titles(F.col("t")), t=None) == []


def test_unsourced(spark):
    draft, source = "Led 45 engineers and grew sales 250%, to 1,200.5k, in 2021, with 3 global launches, weekly and weekly.", "I led 45 people; weekly notes"
    assert one(spark, documents.unsourced(F.col("a"), F.col("b")), a=draft, b=source) == ["250%", "1,200.5k", "global"]
    assert one(spark, documents.unsourced(F.col("a"), F.col("b")), a=None, b=None) == []


def test_figures_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in docs.select("text", documents.all_of(F.coalesce("text", F.lit("")), "(?U)" + documents.W.FIGURE).alias("found")).collect():
        assert [x.strip() for x in r["found"]] == [x.strip() for x in NUMBER.findall(r["text"] or "")]


def test_variants():
    got = role.title_variants(["FP&A  Manager"])
    assert {"fp&a manager", "financial planning and analysis manager", "financial planning & analysis manager"} <= set(got)


def test_alone_without_company(spark):
    rows = spark.createDataFrame([(1, None, None, "x"), (2, None, None, "y"), (3, "A", "b", " z "), (4, "a", "B ", "z")], "l_orderkey long, company string, title string, location string")
    full = rows.selectExpr("*", "0 l_linenumber", "0L l_partkey", "0L l_suppkey", "'lever' platform", "'' description", "array('kept') flags").withColumn("salary", screen.pay.salary())
    got = {r["l_orderkey"]: (r["location"], r["flags"]) for r in screen.dedupe(full).collect()}
    assert got == {1: ("x", ["kept"]), 2: ("y", ["kept"]), 3: ("z", ["kept", "posted in 1 locations"])}


def test_place_gate(spark):
    r = screen.Rules(["x"], countries=["UK"], remote_ok=False, places_excluded=["leeds"])
    for place, want in (("Leeds", "location excluded (Leeds)"), ("Leeds / Paris", "Paris outside target countries"), ("Leeds | London", None), ("Remote", "remote role and remote is off"), ("", "no location given and remote is off"), (None, "no location given and remote is off"), ("Nowhere", "location not recognised (Nowhere)")):
        gate = screen.place_gate(F.col("p"), screen.place.countries_in(F.col("p")), F.col("d"), F.lit(None).cast("boolean"), r)
        assert one(spark, gate, p=place, d="") == want, place


def test_dates_and_flags(spark):
    for written, day in (("2026-08-18T00:30:00+0100", "2026-08-18"), ("18 August 2026", "2026-08-18"), ("Aug 3, 2026", "2026-08-03"), ("1767225600000", "2026-01-01"), ("1767225600", "2026-01-01"), ("31/12/2025", "2025-12-31"), ("Posted Today", None), ("", None), (None, None)):
        assert one(spark, text.date_of(F.col("t")).cast("string"), t=written) == day, written
    for said, away in (("Remote", True), ("non-remote", False), ("London", None), ("", None)):
        assert one(spark, text.remote_of(F.col("t")), t=said) is away
    assert one(spark, text.detail_key(F.col("t")), t="https://x.wd5.myworkdayjobs.com/en-US/site/job/City/T_R1?a=b") == "https://x.wd5.myworkdayjobs.com/wday/cxs/x/site/job/City/T_R1"
    assert one(spark, text.capped_location(F.col("t")), t="a | b | c") == "a +2 more"


def test_bad_payloads(spark):
    raw = spark.createDataFrame([("a", "A", "lever", "u", "[oops"), ("b", "B", "lever", "u", '[{"text": "T", "hostedUrl": "http://x"}]'), ("c", "C", "ashby", "u", None)], "source_key string, company string, platform string, url string, payload string")
    parsed = boards.parse(raw)
    assert [r["source_key"] for r in parsed.collect()] == ["b"]
    assert [r["source_key"] for r in boards.bad_payloads(raw, parsed).collect()] == ["a"]


def test_refusals(spark):
    with pytest.raises(Exception, match="not known: atlantis"):
        one(spark, text.country_code(F.col("t")), t="Atlantis")
    rules = screen.Rules(["x"], dealbreakers=[("bad", "(", True)])
    with pytest.raises(Exception, match="(?i)regex|pattern|Unclosed"):
        screen.validated(spark, rules)


def test_import_of_a_seen_set(spark):
    seen, legacy = (spark.createDataFrame(x, "uid string, first_seen string, last_seen string") for x in ([("a", "1", "2")], [("a", "0", "0"), ("b", "0", "1")]))
    once = history.import_seen(seen, legacy)
    assert {tuple(r) for r in history.import_seen(once, legacy).collect()} == {("a", "1", "2"), ("b", "0", "1")}


def test_large_groups_dedupe_alike_and_left_out_texts_are_not_shuffled(spark, monkeypatch):
    rows = [(i, "Acme" if i % 3 else " ACME", "Engineer" if i % 5 else None, ["lever", "nhs", "linkedin"][i % 3], ["London", " london", "Paris", "", "Leeds"][i % 5 - i % 2], "x" * (i % 7), i % 4 == 0) for i in range(200)]
    p = spark.createDataFrame(rows, "id long, company string, title string, platform string, location string, description string, paid boolean").withColumn("salary", F.struct(F.col("paid").alias("confirmed")))
    keep = ["id", "company", "title", "platform", "location"]

    def result():
        return screen.dedupe(p, ["id"], ["UK"], keep)

    plan = result()._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "struct<description" not in plan and "description, description" not in plan
    small = sorted(map(repr, result().collect()))
    monkeypatch.setattr(screen, "HOT", 5)
    assert sorted(map(repr, result().collect())) == small
    assert len(small) == 41


def test_dedupe_by_a_note_of_pay_and_any_buckets(spark, monkeypatch):
    """paid in place of the salary, and groups counted in few buckets or many, large or not, give the same rows; places are trimmed, platforms may be null."""
    rows = [(i, "Acme" if i % 3 else " ACME", "Engineer" if i % 5 else None, ["lever", None, "linkedin"][i % 3], ["London", " london", "Paris ", None, "Leeds"][i % 5 - i % 2], i % 7, i % 4 == 0) for i in range(200)]
    p = spark.createDataFrame(rows, "id long, company string, title string, platform string, location string, n_chars int, paid boolean")
    by_salary = p.withColumn("salary", F.struct(F.col("paid").alias("confirmed"))).drop("paid")

    def result(rows):
        return sorted(map(repr, screen.dedupe(rows, ["id"], ["UK"], ["id", "company", "platform", "location"]).collect()))

    want = result(by_salary)
    assert result(p) == want and len(want) == 41
    assert any("London / Leeds / Paris" in x and "posted in 3 locations" in x for x in want)
    for hot, buckets in ((5, 1), (5, 1 << 16), (1, 7), (1000, 1)):
        monkeypatch.setattr(screen, "HOT", hot)
        monkeypatch.setattr(screen, "BUCKETS", buckets)
        assert result(p) == want


def test_sections_are_searched_as_strings(spark):
    """Names of sections are no patterns of the plan; in any case, inside words and after marks they are found as before."""
    texts = ["", None, "* EXPERIENCE\nx", "unskilled in Techno", "A Professional Summary, education", "Qualifications - Technologies: employment ABOUT", "me@here.org", "a@b"]
    rows = documents.signals(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"))
    every = ["summary", "experience", "education", "skills"]
    want = [every, every, ["summary", "education", "skills"], every, ["experience", "skills"], [], every, every]
    assert [r["missing_sections"] for r in rows.orderBy("i").collect()] == want
    assert [r["i"] for r in rows.filter("has_email").collect()] == [6]
    assert "qualifications|" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_limits_of_remote_roles_far_behind(spark):
    """The screen drops a remote role that the end of a long description limits, and its score reads the same; rules may name the characters that count."""
    body = "The team plans. " * 500 + "You are located in the United States."
    rows = spark.createDataFrame([("Data Engineer", "Remote", body, True)], "title string, location string, description string, remote boolean").withColumn("salary", screen.pay.salary())
    for chars, want in ((None, "remote but restricted to US"), (3000, None)):
        r = screen.Rules(["data engineer"], countries=["UK"], scope_chars=chars)
        assert screen.screen(screen.derive(rows), r).first()["drop_reason"] == want
        assert screen.screen(screen.derive(screen.read(rows, r)), r).first()["drop_reason"] == want


def test_screen_reasons_reads_descriptions_to_their_end(spark):
    """What screen_reasons reads of a description, with its own rules."""
    rows = spark.createDataFrame([("The team plans. " * 500 + said,) for said in ("You are located in the United States.", "A take home exercise.")], "description string")
    assert sorted((r["read"]["scope"], r["read"]["hard"]) for r in screen.readings(rows, queries.RULES).collect()) == [([], True), (["US"], False)]
