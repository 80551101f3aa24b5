import pytest
from pyspark.sql import functions as F

#: Texts that every operator has to take: null, empty, white space, one word, marks, ties and repeats.
ODD = [None, "", " \n\t ", "word", "!!! ... ???", "a a a a a a a a a a", "Ünïcödé ßtraße 日本語 😀 ́x", "tab\tand\r\nline end ", "x" * 3000]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Odd texts, repeated rows and ids, null ids, and extra columns named like the operators' own."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "word"), (3, "another"), (None, "word"), (None, None), (90, " ".join(f"w{k % 977}" for k in range(40_000)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    names = ["values", "hash", "key", "n", "label", "score", "part", "its", "copy", "again", "row", "leaked", "bits", "id", "data"]
    return df.withColumns({n: F.lit("clash") for n in names}).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
