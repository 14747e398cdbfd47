import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, band long, _id long"


@pytest.fixture(scope="session")
def docs(spark):
    """The whole documents table of the smallest size."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return sorted(docs.collect(), key=lambda r: r["doc_id"])


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a very long one, copies, and rows that repeat."""
    words = [f"w{i * i % 997}x{i}" for i in range(60_000)]
    long = " ".join(words)
    line = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen."
    other = "A sentence of its own stands here, and nobody else has any like it."
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "two words"), (6, long), (7, long), (8, line),
        (9, f"{other} {line}\n{line}"), (None, line), (None, None), (10, "Ünïcode ß 中文字 🙂\x00 <|endoftext|> end"),
        (11, "same same same same same same same same same same"), (11, "same same same same same same same same same same"),
        (11, "another text with this id"), (12, "\n".join([line] * 30)), (13, "a" * 5000), (14, "\r\n\x0b\x1c x\x85y\xa0z"),
    ]
    langs, sources = ["en", None, "de"], ["s1", "s2", None, "s3"]
    return [(i, t, langs[k % 3], sources[k % 4], None if t is None else len(t), k, k, k, k) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows, with further columns that are named like ones the operators use."""
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
