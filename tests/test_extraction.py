"""The choice of a PDF backend, reason by reason."""

from pyspark.sql import functions as F

from shirabe.operators.extraction import extraction_choice


def test_reasons_in_order(spark):
    rows = [
        (1, "plain text of a page", "Word", "arial", False), (2, "plain text of a page", "pdfTeX", "arial", None), (3, "formula text here", "pdfTeX", "CMMI10", False),
        (4, "", None, None, None), (4, "x" * 19, None, None, None), (5, "αβγδεζηθικ λμν", "x", "y", False), (5, "text " * 4, "x", "y", False), (6, "�" * 20 + "ab", "x", "CMMI10", False), (7, "fine text of a page", "x", "y", True),
        (7, None, None, None, None), (8, None, None, None, None), (9, "αβγδεζηθικ" + "漢字", "x", "y", False),
    ]
    df = spark.createDataFrame(rows, "k long, t string, producer string, fonts string, unmapped boolean")
    got = {r["k"]: (r["backend"], r["mode"], r["reason"]) for r in extraction_choice(df, "k", "t", F.col("producer"), F.col("fonts"), F.col("unmapped")).collect()}
    assert got == {
        1: ("text", None, "plain"), 2: ("layout", "txt", "tex"), 3: ("layout", "txt", "math"), 4: ("layout", "ocr", "empty"), 5: ("layout", "ocr", "greek"),
        6: ("layout", "ocr", "broken"), 7: ("layout", "ocr", "unmapped"), 8: ("layout", "ocr", "empty"), 9: ("text", None, "plain"),
    }
    assert extraction_choice(df.limit(0), "k", "t", F.col("producer"), F.col("fonts"), F.col("unmapped")).count() == 0
