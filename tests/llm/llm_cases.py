"""Small frames shared by the tests of this folder."""

#: doc_id, text, lang, source: nulls, empty and long texts, copies, repeated rows, a repeated id with another text.
DOCS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a"),
    (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "b"),
    (3, "", "en", None),
    (4, None, None, "a"),
    (5, "Straße 12 é 日本 🎉", "de", "b"),
    (6, "word " * 30_000, "en", "a"),
    (7, "the same row", "fr", "c"),
    (7, "the same row", "fr", "c"),
    (None, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", None, None),
    (8, " \t\n ", "en", "a"),
    (9, "x" * 100_000, "en", "a"),
]

#: Columns whose names the operators also use.
CLASHING = ("size", "n", "key", "id", "row", "kept", "component_id", "score", "lang_pred", "part", "h", "bands", "part_of", "_row", "source_size", "copies", "base")


def frame(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")
    return docs.selectExpr("*", *[f"'extra' as {c}" for c in CLASHING])


def sources(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")
