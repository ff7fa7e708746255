import zlib

from pyspark.sql import functions as F

from hubflow.llm import langid
from hubflow.llm.queries import LLM_QUERIES

DOCS = "doc_id long, text string, lang string, key string, score string"


def test_held_out_accuracy_and_columns(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = LLM_QUERIES["op2_language_id"](spark, sf).collect()
    assert len(got) == len(docs)
    langs = {d.lang for d in docs.values()}
    right = total = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.lang_pred in langs and 0 <= r.score <= 1
        if r.held_out:
            total += 1
            right += r.lang_pred == docs[r.doc_id].lang
    assert total > 100 and right / total > 0.97


def test_predictions_use_the_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    plain = langid.identify(docs, model, F.col("doc_id")).collect()
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")).withColumn("doc_id", F.col("doc_id") + 1000)
    moved = langid.identify(other, model, F.col("doc_id")).collect()
    assert {(r.key, r.lang_pred, r.score) for r in plain} == {(r.key - 1000, r.lang_pred, r.score) for r in moved}


def test_the_sample_is_bounded_and_repeatable(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = langid.fit(docs, snippets=3), langid.fit(docs.repartition(7), snippets=3)
    assert a == b
    assert all(len(d) <= 3 * 4 * (langid.SNIPPET_CHARS + 1) for d in a.dictionaries)


def test_odd_texts(spark):
    train = [(i, f"the quick brown fox and the lazy dog number {i} " * 5, "en", "", "") for i in range(9)]
    train += [(100 + i, f"der schnelle braune fuchs und der faule hund {i} " * 5, "de", "", "") for i in range(8)]
    train += [(200, None, "en", "", ""), (201, "bonjour", None, "", ""), (None, "le monde", None, "", "")]
    model = langid.fit(spark.createDataFrame(train, DOCS))
    assert model.names == ("en", "de")
    texts = [None, "", "123 !? _ \n", "the dog", "DER!! SCHNELLE&&& BRAUNE### FUCHS!! UND DER FAULE HUND", "der hund " * 100_000, "the dog", "²½"]
    df = spark.createDataFrame([(i, t, None, "k", "s") for i, t in enumerate(texts)], DOCS)
    got = {r.key: (r.lang_pred, r.score, r.rejected) for r in langid.identify(df, model, F.col("doc_id")).collect()}
    assert got[0] == got[1] == got[2] == got[7] == ("und", 0.0, True)
    assert [got[i][0] for i in (3, 4, 5, 6)] == ["en", "de", "de", "en"] and got[3] == got[6]
    assert langid.identify(df.limit(0), model, F.col("doc_id")).count() == 0


def test_nothing_to_learn_from_and_ties(spark):
    empty = langid.fit(spark.createDataFrame([], DOCS))
    df = spark.createDataFrame([(1, "words", "en", "", "")], DOCS)
    assert empty.names == () and langid.identify(df, empty, F.col("doc_id")).first().lang_pred == "und"
    same = langid.LanguageModel(("a", "b"), (b"xyzxyzxyz", b"xyzxyzxyz"))
    assert langid.scorer(same)("xyz") == ("a", 0.0)
    assert langid.scorer(langid.LanguageModel(("a",), (b"xyzxyzxyz",)))("xyz") == ("a", 1.0)


def test_copies_fill_one_place_and_all_languages_are_learned(spark):
    rows = [(0, "aaa bbb " * 20, "x0", "", "")] * 400 + [(i, f"word{i} other", f"x{i % 300}", "", "") for i in range(900)]
    model = langid.fit(spark.createDataFrame(rows, DOCS), snippets=4)
    assert len(model.names) == 300 and model.names[0] == "x0"
    # four different texts of that language, one of them the copied one
    assert sorted(model.dictionaries[0].decode().split()) == sorted(["aaa", "bbb"] * 20 + ["word", "other"] * 3)


def test_against_a_plain_loop_over_dictionaries(spark):
    """Dictionaries and predictions made again without Spark's help."""
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.withColumn("h", F.xxhash64(F.lit(7), "text")).collect()
    by, count = {}, {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.text is not None and r.lang is not None:
            at = r.h % (max(len(r.text) - 1024, 0) + 1)
            by.setdefault(r.lang, {})[r.h] = langid.letters(r.text[at : at + 1024])
            count[r.lang] = count.get(r.lang, 0) + 1
    names = sorted(by, key=lambda k: (-count[k], k))
    tools = []
    for k in names:
        raw = " ".join(by[k][h] for h in reversed(sorted(by[k])[:128])).encode().ljust(8)
        params = zstandard.ZstdCompressionParameters.from_level(6, write_content_size=False, write_checksum=False, write_dict_id=False)
        tools.append(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params))
    got = {r.doc_id: (r.lang_pred, r.score) for r in LLM_QUERIES["op2_language_id"](spark, "/root/testdata/sf0.001").collect()}
    for r in rows:
        norm = langid.letters(r.text)
        sizes = [sum(len(c.compress(norm[i : i + 2048].encode())) for i in range(0, len(norm), 2048)) for c in tools]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        if norm:
            assert got[r.doc_id] == (names[best], 1 - sizes[best] / min(s for i, s in enumerate(sizes) if i != best))
        else:
            assert got[r.doc_id] == ("und", 0.0)
