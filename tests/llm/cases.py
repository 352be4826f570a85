"""Small tables with the awkward rows every operator must stand."""

from __future__ import annotations

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string"


def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, extra columns with clashing names."""
    long = " ".join(f"word{i % 700}" for i in range(9000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 10, 1, "k"),
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 10, 1, "k"),
        (2, None, "en", "a", None, None, None),
        (3, "", None, "b", 0, 0, ""),
        (4, " \t\n\x0b\x0c\r ", "de", None, 7, 7, ""),
        (None, "no id here at all", "en", None, 1, 1, "x"),
        (5, long, "en", "b", len(long), 2, "y"),
        (6, "same line\nsame line\n\nother # line |\nsame line", "en", "", 1, 1, ""),
        (7, "Ünïcode ŝtrîng 𝔘𝔫𝔦 日本語 it's <|endoftext|> K x y z w q", "fr", "\U0001f600", 1, 1, ""),
        (8, "a b c d e a b c d e f g h i j k l m", "es", "c", 1, 1, ""),
        (8, "other text with the same id and more words in it now", "es", "c", 1, 1, ""),
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]
