import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


ODD = [
    (1001, None, None, None, None), (1002, "", "en", "src0", 0), (1003, " \n\t ", None, "src1", 4), (1004, "one", "en", None, 3),
    (1005, "a b c d e f g", "en", "src0", 13), (1005, "a b c d e f g", "en", "src0", 13), (1006, "A B C D E F G", "xx", "src0", 13),
    (1007, "word " * 60_000, "en", "src9", 300_000), (1008, "x" * 150_000, "en", "src9", 150_000), (1009, "<|endoftext|> ends <|endoftext|>", "en", "src2", 32),
    (1010, "12 34 !!", "en", "src2", 8), (1011, "ÄÖ аб 中文 é\x1c y", "de", "src2", 12), (None, "a text without a key", "en", "src3", 20),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("h", "n", "words", "block", "label", "epoch", "tokens", "items", "score", "n_tokens", "kind"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
