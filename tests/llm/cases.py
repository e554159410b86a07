"""Small documents that every operator has to handle."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, odd characters, clashing extra columns."""
    words = " ".join(f"w{i % 97} thing{i}" for i in range(12_000))
    rows = [
        (5, "Hello,  World's don't 123 café CAFÉ ﬁ Σίσυφος ΟΔΟΣ", "en", "a", 9),
        (3, None, None, None, None),
        (3, "", "en", "a", 0),
        (None, "no id here token = abcdef0123456789abcdef", "en", "a", 1),
        (7, " \t\n\x0b\x0c\r ", "en", "a", 7),
        (9, words, "en", "a", len(words)),
        (9, words, "en", "a", len(words)),
        (11, words + " tail", "en", "a", 1),
        (-4, "x" * 50_000, "en", "a", 1),
        (12, "İstanbul x² ½ ǅ naïve é  nbsp em 你好 🙂🙂 l'eau *** don't!!! it's's", "tr", "b", 1),
        (13, "Hello,  World's don't 123 café CAFÉ ﬁ Σίσυφος ΟΔΟΣ", "en", "b", 9),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("recipe", "kept", "row", "place", "key", "label", "score", "length", "__keep", "__drop", "KEEP", "drop", "keep_0", "fp", "node", "of", "n", "text_0"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
