import os

from pyspark.sql import functions as F

from hubflow.llm import common


def test_staged_tables_are_deleted_on_request(spark):
    a, b = common.staged(spark.range(5)), common.staged(spark.range(3))
    assert (a.count(), b.count()) == (5, 3)
    common.discard(a)
    assert not os.path.exists(a.staged_path) and os.path.exists(b.staged_path)
    common.discard_staged()
    assert not os.path.exists(b.staged_path) and not common._STAGED


def test_words_split_on_the_six_separators_only(spark):
    text = " a\tb\nc\x0bd\x0ce\rf\u00a0g\u2003h\x1ci  \x85 "
    df = spark.createDataFrame([(text,), (None,), ("",), (" ",)], "t string")
    got = [r[0] for r in df.select(common.words(F.col("t"))).collect()]
    assert got == [[w.decode() for w in (t or "").encode().split()] for t in (text, None, "", " ")]


def test_let_binds_a_value_once(spark):
    got = spark.range(1).select(common.let(F.lit(3) + F.col("id"), lambda x: x * x)).first()[0]
    assert got == 9
