import pytest

CLASH = ("id", "n", "n_words", "spans", "blob", "band", "root", "row", "term", "node", "label", "line", "_text", "_id", "shard", "w", "_hit_blob", "_spans", "_own_blob", "_gone", "_key", "own", "number", "at", "body", "_row")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward value, beside columns whose names operators use themselves."""
    long = " ".join(f"word{i % 977} of{i}" for i in range(60000))
    near = [f"alpha{i} beta{i} gamma{i} delta{i}" for i in range(40)]
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\r "), (4, "one"), (5, "one"), (5, "one"), (6, "two words"), (7, long), (8, long + " end"),
        (9, " ".join(near)), (10, " ".join(near[:20] + ["changed"] + near[20:])), (11, " ".join(near)), (12, "naïve ß 漢字 😀 ퟿"), (13, "a\x00b   c"), (None, "no id"), (None, None),
    ]
    data = [(i, t, "en" if i and i % 2 else None, "src", *[f"c{k}" for k in range(len(CLASH))]) for i, t in rows]
    fields = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(data, fields)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
