import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "k1 string, fp string, position string, words string, score string, g1 string, p1 string, p string, pn string"
)


@pytest.fixture(scope="session")
def given(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows(given):
    """Given texts with the cases that must not break anything, and columns with clashing names."""
    own = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in given.orderBy("doc_id").limit(60).collect()]
    long = " ".join(f"w{i % 4000} Licence" for i in range(30_000))
    odd = [
        (1000, None, "en", "src1", None),
        (1001, "", "en", None, 0),
        (1002, " \t\n\x0b\x0c\r ", None, "src1", 7),
        (None, "no id but words in it", None, None, 21),
        (None, None, None, None, None),
        (1003, long, "en", "src2", len(long)),
        (1004, "Released under the MIT License. mit license MIT-license; Apache License", "en", "src2", 70),
        (1005, "ÀÉ x İ K 😀 tab\there", "fr", "src3", 20),
        (1006, "one two", "en", "src3", 7),
        own[0], own[0], own[1],
        (7001, own[2][1], "en", "src9", own[2][4]),
    ]
    return [(*r, *"abcdefghi") for r in own + odd]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
