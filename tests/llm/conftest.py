import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text) of the smallest documents table."""
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names operators may use too."""

    def make(pairs, extra=True):
        rows = [(d, t, None, None, None if t is None else len(t)) for d, t in pairs]
        df = spark.createDataFrame(rows, COLUMNS)
        names = "key row value hash text_hash failed_rule size ranges new digest drop_id leaked_id found_id part length"
        return df.withColumns({n: F.lit(n) for n in names.split()}) if extra else df

    return make
