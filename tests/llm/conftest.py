import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=None):
        """(doc_id, text[, lang[, source]]) as documents; extra adds columns whose names clash with those operators use."""
        full = [(*r, *(None,) * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in extra:
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make


@pytest.fixture(scope="session")
def tokenizer():
    from plumbline.llm.queries import tokenizer_file

    return tokenizer_file()


