"""Small document tables with everything odd in them, and brute-force versions of what operators compute."""

import re

from pyspark.sql import functions as F

#: Names that operators use inside; tables have them as columns of their own.
CLASHES = ["key", "fp", "row", "words", "part", "score", "own", "n", "value", "spans", "starts", "root", "_f", "_n", "quality", "held_out", "length"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s", 1), (2, None, "en", "s", 0), (3, "", "en", None, 0), (4, " \t\n ", None, "s", 4), (5, "one", "en", "s", 3),
    (None, "a row that has no number of its own but some words", "en", "s", 1), (7, "the quick brown fox jumps over the lazy dog again and again", "en", "s", 1), (7, "the quick brown fox jumps over the lazy dog again and again", "en", "s", 1),
    (8, "Ünïcödé ÄÖ wörds   with  runs of spaces   and 　 others", "de", "s", 9), (9, "word " * 30_000, "en", "s", 150_000), (-3, "a negative number for a document <|endoftext|> here", "en", "s", 4),
]


def table(spark, rows, clashes=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES}) if clashes else df


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows(df):
    return [r.asDict() for r in df.collect()]
