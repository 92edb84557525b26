"""Small tables with everything that may go wrong in them."""

LONG = " ".join(f"word{i % 997} Thing{i}" for i in range(60_000))

#: doc_id, text, source
DOCS = [
    (1, "the quick brown fox jumps over the lazy dog", "a"), (2, "The Quick Brown fox jumps over the lazy dog", "a"),
    (2, "The Quick Brown fox jumps over the lazy dog", "a"), (3, "", "b"), (4, None, None), (None, "a null id", "b"),
    (5, "one", "é"), (6, " \t\n ", "b"), (7, LONG, "a"), (8, LONG + " tail", "c"), (9, "STRASSE Straße Été İ", "c"),
    (10, "strasse Straße Été İ", "c"), (2, "another text under the same id", None), (None, None, None),
]


def docs(spark, rows=DOCS):
    """The rows with extra columns whose names operators might use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    extra = "id fp key row norm run hash size kept keep_id component_id nth digest words label bucket _id _label lang".split()
    return df.selectExpr("doc_id", "text", "source", "length(text) as n_chars", *[f"'x' as `{c}`" for c in extra])


def empty(spark):
    return docs(spark).where("1 = 0")
