import pytest

from seqloom.shipping import ship

PASSAGE = " ".join(f"passage{i}" for i in range(60))
LINE = "This very common line is long enough to go"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, exact and near copies, repeated rows, clashing column names."""
    ship(spark)
    words = [f"w{i}" for i in range(300)]
    base = " ".join(words)
    near = " ".join([*words[:150], "changed", *words[151:]])
    long_text = "\n".join(f"line {i % 997} of a very long text " + "é" * (i % 7) for i in range(6000))
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "a"), (4, None, None, None), (5, "", "en", "b"), (6, "  \n\t ", "de", "b"),
        (7, long_text, "en", "a"), (8, "one two", "fr", "c"), (8, "one two", "fr", "c"), (8, "other text with the same id", None, "c"),
        (None, f"{PASSAGE}\n{LINE}", "en", "a"), (9, f"x y {PASSAGE} z\n{LINE.upper()}", "en", None), (10, f"{PASSAGE}\n  {LINE}  ", "en", "a"),
        (11, f"{LINE}\nfoo <|endoftext|> bar", "en", "b"), (12, "日本語 ́ 1234 it's x", "es", "b"), (13, LINE, "en", "a"),
    ]
    rows = [(*t, len(t[1] or ""), n, 2 * n, "k", n, "s", n, "r", 1.5) for n, t in enumerate(texts)]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, rep int, shard int, key string, size int, hash string, `row` int, bucket string, position double"
    )
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 1), (3, 1, 1), (None, 1, 1), (99, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
