import os

import pytest
from pyspark.sql import functions as F

from tidegate.llm.tokens import TOKEN_RE, token_count, vocabulary_token_count


def test_jvm_and_python_agree(spark):
    texts = ["Hello, wörld 1234567!", "Русский текст…", "漢字　と🙂 ", "", " \n\t", "a b", None, "éx"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in df.select("i", token_count(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [None if t is None else len(TOKEN_RE.findall(t)) for t in texts]


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers"), reason="no vocabulary files here")
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_vocabularies(spark, name):
    df = spark.createDataFrame([("two words",), (None,), ("",)], "t string")
    got = [r.n for r in df.select(vocabulary_token_count(F.col("t"), f"/opt/tokenizers/{name}").alias("n")).collect()]
    assert got[0] >= 2 and got[1] is None and got[2] == 0
