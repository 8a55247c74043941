"""Awkward documents: nulls, empties, long texts, ties, repeated rows, extra columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hits string, shard string, mix string"


def docs(spark):
    long = "Wörter und mehr\n" * 4000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a"),
        (2, "the QUICK brown fox jumps over the lazy dog", "en", "b"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, long, "de", "a"),
        (5, long, "de", "a"),
        (6, long, "de", "c"),
        (None, "A row without a number", "en", "a"),
        (7, " \t\n\r ", "en", "a"),
        (8, "naïve Ünïcode ​ \U0001f600 text | with !! and *** ", "fr", "ü"),
        (9, "\x00\x1c odd \x85 spaces here", "en", ""),
    ]
    return spark.createDataFrame([(*r, 0, "h", "s", "m") for r in rows], DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
