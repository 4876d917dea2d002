import pytest
from pyspark.sql import functions as F

from vacanta.functions import pay, place, role


def one(spark, column, **values):
    kinds = {str: "string", bool: "boolean"}
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "low", "high", "currency", "period"),
    [
        ("Base £55k - £70k plus bonus", 55000, 70000, "GBP", "year"),
        ("€500-€600 a day", 500, 600, "EUR", "day"),
        ("$40 hourly", 40, 40, "USD", "hour"),
        ("we serve 40,000 to 120,000 requests", None, None, None, "year"),
        ("Competitive, £45,000", 45000, 45000, "GBP", "year"),
        ("x " * 250 + "Base salary range: £48,000 - £72,000", 48000, 72000, "GBP", "year"),
        ("x " * 250 + "raised £48,000 - £72,000 in funds", None, None, None, "year"),
        ("", None, None, None, "year"),
    ],
)
def test_pay(spark, text, low, high, currency, period):
    got = one(spark, pay.parse(F.col("t")), t=text)
    assert (got["min"], got["max"], got["currency"], got["period"], got["confirmed"]) == (low, high, currency, period, low is not None)


@pytest.mark.parametrize(
    ("location", "countries", "city"),
    [("London, Ontario", [], "London"), ("Cambridge, MA", ["US"], "Cambridge"), ("York", ["UK"], "York"), ("MÜNCHEN", ["DE"], "MÜNCHEN"), ("Paris, France; Madrid", ["ES", "FR"], "Paris"), ("Hybrid - Leeds", ["UK"], "Leeds")],
)
def test_place(spark, location, countries, city):
    assert one(spark, place.countries_in(F.col("t")), t=location) == countries
    assert one(spark, place.city_of(F.col("t")), t=location) == city


@pytest.mark.parametrize(("title", "level"), [("Head of Data", 5), ("Leadership Coach", 0), ("Junior Engineer", 1), ("VP Sales", 6), ("Analyst I", 1), ("", 0)])
def test_level(spark, title, level):
    assert one(spark, role.seniority(F.col("t")), t=title) == level


def test_safe_url(spark):
    assert one(spark, role.safe_url(F.col("t")), t="java\tscript:alert(1)") == ""
    assert one(spark, role.safe_url(F.col("t")), t="https://a.example/b") == "https://a.example/b"


def test_mode_of_whole_texts(spark):
    """What stands far behind counts as what stands first."""
    mode = lambda text: one(spark, role.work_mode(F.lit(""), F.lit(""), F.col("t"), F.lit(None).cast("boolean")), t=text)
    for said, want in (("It is hybrid.", "hybrid"), ("An on-site role.", "office"), ("Fully remote.", "remote"), ("Nothing.", "unstated")):
        assert mode(said) == want and mode("The team plans. " * 5000 + said) == want


def test_scope_of_whole_texts(spark):
    """A limit far behind counts as one that stands first."""
    scope = lambda text: one(spark, place.remote_scope(F.col("t")), t=text)
    for said, want in (("You are located in the United States.", ["US"]), ("Remote work from the UK only.", ["UK"]), ("Nothing.", [])):
        assert scope(said) == want and scope("The team plans. " * 5000 + said) == want
