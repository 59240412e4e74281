import itertools

import pytest

from tidemart.llm.session import prepared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
_number = itertools.count()


@pytest.fixture
def docs(spark, folder):
    """Stores (doc_id, text) or full rows as a documents table, with columns whose names operators use themselves."""
    prepared(spark)

    def make(rows, files=3):
        full = [(*r, "en", f"src{i % 2}", len(r[1] or "")) if len(r) == 2 else r for i, r in enumerate(rows)]
        frame = spark.createDataFrame([(*r, -1, "clash", 7) for r in full], SCHEMA + ", n_words long, seq string, id long")
        path = f"{folder}/{next(_number)}/documents.parquet"
        frame.repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return make
