import pytest
from pyspark.sql import types as T

WORDS = "the of and thing worthless ration elle que der die und sich clown idiot Licensed under the MIT License. All rights reserved. CC-BY".split()


@pytest.fixture(scope="session")
def documents(spark):
    """Small documents with nulls, empty and long texts, ties, repeated rows, and clashing columns."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("fp", T.StringType())])

    def make(texts, langs=None):
        rows = [(i, t, (langs or {}).get(i, "en"), f"src{(i or 0) % 3}", len(t or ""), "clash", "clash") for i, t in texts]
        return spark.createDataFrame(rows, schema)

    return make


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "Word"), (4, "Word"), (5, "a b"), (6, "😀 漢字 <|endoftext|> É\x85x"), (7, "x" * 3000), (8, "long words " * 4000), (None, "no id"), (9, "a b"), (10, "\x00 zero")]
