"""Small tables for the corpus operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: What every operator must bear: nulls, empties, ties, repeated rows, long texts.
ODD = [
    (1, "The cat sat on the mat and looked at the dog", "en", "a", 44),
    (2, "THE CAT sat on the mat and looked at the dog", "en", None, 44),
    (3, None, None, "a", None), (4, "", "en", "a", 0), (5, "   \n\t ", "de", "b", 6), (6, "12 34 56", None, "b", 8),
    (7, "Der Hund und die Katze gehen über die Straße", "de", "b", 44), (7, "Der Hund und die Katze gehen über die Straße", "de", "b", 44),
    (None, "an id is missing here and that is fine", "en", "c", 38), (8, "ÉCOLE école", "fr", "c", 11), (9, "école école", "fr", "c", 11),
    (10, "x" * 30_000, "en", "a", 30_000), (11, "word " * 9_000, "en", "a", 45_000), (12, "é\U0001f600   odd\x00 signs", "en", "a", 14),
]


def table(spark, rows, extra=True):
    frame = spark.createDataFrame(rows, DOCS)
    if extra:  # columns whose names the operators use inside
        from pyspark.sql import functions as F

        frame = frame.withColumns({n: F.lit("x") for n in ("h", "row", "n", "fp", "tag", "keep_id", "length", "rank", "bucket", "tokens", "p", "segs")})
    return frame
