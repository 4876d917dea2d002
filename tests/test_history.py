import random

import pytest
from pyspark.sql import functions as F

from vacanta.functions import pay
from vacanta.operators import history, phrases, score


def test_merge_of_duplicates(spark):
    roles = spark.createDataFrame(
        [("a", "Acme", "Dev ", "linkedin", "long text"), ("b", "acme ", "dev", "ashby", ""), ("c", "ACME", "DEV", "ashby", "text"), ("d", "Other", "Dev", "ashby", None)],
        "uid string, company string, title string, platform string, description string",
    ).withColumn("salary", pay.salary())
    states = spark.createDataFrame(
        [("a", "interviewing", "call", "2026-01-03"), ("b", "skipped", "no", "2026-01-02"), ("c", "new", "", "2026-01-01"), ("d", "new", "mine", "2026-01-01")],
        "uid string, status string, note string, updated_at string",
    )
    artifacts = spark.createDataFrame([("a", 1), ("d", 2), (None, 3)], "uid string, id int")
    left, merged, moved = history.merge_duplicates(roles, states, artifacts)
    assert {r["uid"] for r in left.collect()} == {"c", "d"}
    assert {tuple(r)[:3] for r in merged.collect()} == {("c", "interviewing", "call"), ("d", "new", "mine")}
    assert {tuple(r) for r in moved.select("uid", "id").collect()} == {("c", 1), ("d", 2), (None, 3)}


def test_merges_of_states_as_a_loop_would(spark):
    """Many groups against a plain loop over each group in the order of choice."""
    rnd = random.Random(4)
    kinds = list(history.PROGRESS)
    roles = [(f"u{i:03d}", rnd.choice(["Acme", "acme ", "Other", None]), f"t{i % 25}", rnd.choice(["linkedin", "nhs", "ashby"]), "x" * rnd.randrange(4)) for i in range(300)]
    states = [(u, rnd.choice(kinds), rnd.choice(["", None, f"note {u}"]), f"2026-01-{rnd.randrange(1, 28):02d}") for u, *_ in roles if rnd.random() < 0.8]
    want, held = {}, {u: s for u, *s in states}
    groups = {}
    for u, company, title, platform, text in roles:
        groups.setdefault((company.lower().strip() if company else u, title), []).append(({"linkedin": 0, "nhs": 1}.get(platform, 2), len(text), u))
    for members in groups.values():
        order = [u for *_, u in sorted(members, key=lambda m: (-m[0], -m[1], m[2]))]
        best, far, moved, first = None, 0, None, None
        for i, u in enumerate(order):
            status, note, at = held.get(u, (None, None, None))
            if status is None or (status == "new" and i):
                continue
            p = history.PROGRESS[status]
            if i and p > far:
                moved = note or moved
            first = first or note or None
            best = status if best is None or p > history.PROGRESS[best] else best
            far = max(far, p)
        acted = [held[u][2] for i, u in enumerate(order) if u in held and (held[u][0] != "new" or i == 0)]
        if best is not None:
            want[order[0]] = (best, moved or first or "", max(acted))
    r = spark.createDataFrame(roles, "uid string, company string, title string, platform string, description string").withColumn("salary", pay.salary())
    s = spark.createDataFrame(states, "uid string, status string, note string, updated_at string")
    _, merged, _ = history.merge_duplicates(r, s, spark.createDataFrame([], "uid string, id int"))
    assert {u: tuple(rest) for u, *rest in merged.collect()} == want


def test_unknown_status_is_an_error(spark):
    events = spark.createDataFrame([("a", "lost", "", 1)], "uid string, status string, note string, at int")
    with pytest.raises(Exception, match="unknown status"):
        history.fold_statuses(events, ["at"]).collect()


def test_live_and_seen(spark):
    roles = spark.sql("SELECT * FROM VALUES ('a', DATE'2026-01-01', DATE'2026-01-20'), ('b', DATE'2026-01-20', DATE'2026-01-20'), ('c', DATE'2026-01-01', DATE'2026-01-05') AS t(uid, first_seen, last_seen)")
    assert {(r["uid"], r["is_new"]) for r in history.live(roles).collect()} == {("a", False), ("b", True)}
    assert history.live(roles.limit(0)).count() == 0
    seen = roles.filter("uid = 'a'")
    assert {(r["uid"], r["is_new"]) for r in history.split_seen(roles, seen, False).collect()} == {("a", False), ("b", True), ("c", True)}
    assert not any(r["is_new"] for r in history.split_seen(roles, seen, True).collect())
    after = history.record_seen(seen, roles, F.lit("2026-02-01").cast("date"))
    assert after.filter("last_seen = DATE'2026-02-01'").count() == 3
    states = spark.createDataFrame([("a", "offer", "", "x")], "uid string, status string, note string, updated_at string")
    once = history.default_states(states, roles, F.lit("y"))
    assert once.count() == history.default_states(once, roles, F.lit("z")).count() == 3


def test_shared_phrases(spark):
    left = spark.createDataFrame([(1, "x one two three four five six seven y"), (2, None), (3, ""), (4, "one two three")], "d int, text string")
    right = spark.createDataFrame([(9, "ONE two, three four five six seven z"), (8, None)], "i int, body string")
    assert [tuple(r) for r in phrases.shared_phrases(left, "d", "text", right, "i", "body").collect()] == [(1, 9, 7, "one two three four five six seven")]


def test_shared_phrases_of_repeated_words(spark):
    same = " ".join(["x"] * 300)
    left = spark.createDataFrame([(1, same), (2, "a b c d e f g h q a b c d e f g h i")], "d int, text string")
    right = spark.createDataFrame([(1, same + " x"), (2, "a b c d e f g h i j"), (3, "q a b c d e f")], "i int, body string")
    got = {tuple(r) for r in phrases.shared_phrases(left, "d", "text", right, "i", "body").collect()}
    assert got == {(1, 1, 300, same), (2, 2, 9, "a b c d e f g h i"), (2, 3, 7, "q a b c d e f")}


def test_score(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES ('Data Engineer', array('UK'), array(), true, DATE'2026-01-30', array()), ('Director', array(), array('US'), true, NULL, array('x')),"
        " (NULL, array('FR'), array(), NULL, DATE'2026-01-15', array()) AS t(title, countries, scope, remote, posted_at, flags)"
    )
    kinds = {c: F.col(c).cast("array<string>") for c in ("countries", "scope", "flags")}
    text = F.when(F.col("title") == "Data Engineer", "£80,000").otherwise("")
    posted = rows.withColumns(kinds).withColumn("salary", pay.parse(text))
    got = score.score(posted, ["data engineer"], (2, 3), ["UK"], ["FR"], 60000.0, "GBP", F.lit("2026-02-01").cast("date"))
    by = {r["title"]: r for r in got.collect()}
    assert by["Data Engineer"]["score"] == 35 + 20 + 10 + 10 + 15 + 10
    assert by["Director"]["score"] == 0 and score.STRETCH in by["Director"]["flags"]
    assert by[None]["score"] == 8 + 8 + 10
    assert by[None]["reasons"] == ["in FR, relocation", "unconfirmed salary", "posted 17 days ago"]


def test_shared_phrases_are_told_by_their_words(spark, monkeypatch):
    """Hashes only choose where grams are made: with one hash for all, the result is the same."""
    left = spark.createDataFrame([(1, "a b c d e f g h. x"), (2, "b c d e f g"), (3, "a b c d e"), (4, None), (5, "z y x w v u t")], "d int, text string")
    right = spark.createDataFrame([(7, "q A b c d e f g q"), (8, "t u v w x y z")], "i int, body string")
    want = [(1, 7, 7, "a b c d e f g"), (2, 7, 6, "b c d e f g")]
    assert sorted(map(tuple, phrases.shared_phrases(left, "d", "text", right, "i", "body").collect())) == want
    monkeypatch.setattr(phrases, "hashed", lambda w, i, n: F.lit(0).cast("long"))
    assert sorted(map(tuple, phrases.shared_phrases(left, "d", "text", right, "i", "body").collect())) == want


def test_pay_is_looked_for_from_the_first_figure_on(spark):
    """Patterns of pay read no text before the first figure, its sign and a space; what they find is as in the whole text."""
    texts = ["prose £ 45,000 x", "base a b  40k to\t50K.", "😀 😀 £300 - £400 per DAY", "no figure", "DaıLY £٣٠٠", "1 then $12.5 an hour", "DOE, 40k"]
    rows = spark.createDataFrame(enumerate(texts), "i int, t string").select("i", pay.from_figure(F.col("t")).alias("tail"), pay.parse(F.col("t")).alias("p")).orderBy("i").collect()
    assert [r["tail"] for r in rows] == ["£ 45,000 x", "  40k to\t50K.", " £300 - £400 per DAY", "", " £٣٠٠", "1 then $12.5 an hour", ", 40k"]
    assert [(r["p"]["min"], r["p"]["max"], r["p"]["period"], r["p"]["confirmed"]) for r in rows] == [
        (45000.0, 45000.0, "year", True), (40000.0, 50000.0, "year", True), (300.0, 400.0, "day", True), (None, None, "year", False), (None, None, "year", False), (12.5, 12.5, "hour", True), (None, None, "year", False),
    ]
