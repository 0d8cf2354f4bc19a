"""Small tables for the operators' tests."""

import os

FOLDER = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


def have_tables():
    return os.path.isdir(FOLDER)


def odd_documents(spark):
    """Nulls, empty, blank, long, repeated and equal texts, and columns that clash."""
    long = "lang " * 60_000 + "x" * 5000
    rows = [
        (1, "the of and to in is that a be it", "en", "s"), (2, None, "en", None), (3, "", None, "s"),
        (4, " \n\t ", "de", "s"), (5, long, "en", "s"), (6, long, "en", "s"), (1, "the of and to in is that a be it", "en", "s"),
        (None, "der die und das ist nicht ein auf sich", "de", "s"), (8, "12 34 !!", None, None), (9, "Ünï çodé 漢字 \U0001f600", "fr", "s"),
        (10, "the of and to in is that a be it", None, "s"),
    ]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return made.selectExpr(
        "*", "length(text) AS n_chars", "1 AS score", "'q' AS lang_pred", "2 AS ids", "3 AS hash", "4 AS cid", "5 AS rid", "6 AS key", "7 AS root"
    )
