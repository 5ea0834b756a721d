from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from texts or (doc_id, text) pairs, with columns whose names operators use inside."""

    def make(rows, extra: bool = False):
        pairs = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        data = [(i, t, "en", "src", len(t) if t else 0) for i, t in pairs]
        df = spark.createDataFrame(data, DOCUMENTS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("content", "rep", "key", "row", "features", "score", "slot", "shard", "words", "rate", "group", "stratum", "times", "quality", "toxic", "domain", "n_tokens", "half", "place", "fit", "id"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


#: Null, empty, blank, one word, repeated rows, and a very long text.
ODD = [None, "", " \n\t ", "word", "word", "x" * 50_000, "a b c d e f g h " * 3_000]


@pytest.fixture
def odd(make_docs):
    return make_docs([*ODD, (2, ODD[2]), (None, "no id at all in this row of words")], extra=True)


@pytest.fixture
def empty(make_docs):
    return make_docs([], extra=True)
