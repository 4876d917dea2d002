"""Rows that every operator has to take."""

import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(x: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def documents(spark, extra=()):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [
        (1, base),
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (5, base),
        (6, base.upper() + " seventeen"),
        (7, "x " * 30000 + "end"),
        (8, "short one"),
        (9, "Ünïcode — “quotes” 漢字 😀 and space wide " + base),
        (10, "a\\b <|im_start|> it's we'll 123 456 \x1c\x85 end"),
        (10, "a\\b <|im_start|> it's we'll 123 456 \x1c\x85 end"),
        *extra,
    ]
    # Columns whose names an operator might use itself.
    return spark.createDataFrame([(i, t, "en", "s", 7, 8) for i, t in rows], "doc_id long, text string, lang string, source string, n_words long, label int")


def empty(spark):
    return documents(spark).limit(0)
