from collections import Counter

import corpus_pipeline
import pytest
from hubflow.llm.common import staged
from hubflow.llm.queries import LLM_QUERIES

from .test_decontaminate import plain_leaks
from .test_mixing import brute_targets
from .test_simhash import plain_fingerprint, plain_groups

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], SF)))
    return [(df.columns, df.collect()) for df in out]


def ids(rows):
    return Counter(r.doc_id for r in rows)


def test_columns_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]


def test_every_stage_against_brute_force(spark, steps):
    (columns, docs), (_, clean), (_, unique), (_, pure), (_, mixed), (last, shards) = steps
    assert all(c == columns for c, _ in steps[:-1]) and last == [*columns, "shard", "slot"]

    kept = {r.doc_id for r in LLM_QUERIES["op9_quality_rules"](spark, SF).collect() if r.kept}
    assert ids(clean) == Counter(kept) and 0 < len(kept) < len(docs)

    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in clean]
    assert ids(unique) == Counter(set(plain_groups(rows))) and len(unique) < len(clean)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaking = {d for d, _ in plain_leaks([(r.doc_id, r.text) for r in unique], items)}
    assert ids(pure) == ids(r for r in unique if r.doc_id not in leaking) and leaking

    words = {r.doc_id: len(r.text.encode().split()) for r in pure}
    source = {r.doc_id: r.source for r in pure}
    sizes, taken = Counter(), Counter()
    for d, n in words.items():
        sizes[source[d]] += n
    for d, n in ids(mixed).items():
        assert n <= 3
        taken[source[d]] += n * words[d]
    for s, t in brute_targets(dict(sizes)).items():
        assert abs(taken[s] - t) < 50

    assert ids(shards) == ids(mixed)
    slots = {}
    for r in shards:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 24


def test_run_is_the_stages_and_takes_odd_tables(spark, tmp_path):
    docs = [(None, None, None, None, None, "x"), (None, "", "en", "s", 0, "y"), (1, "a " * 60, "en", "s", 1, "z"), (1, "a " * 60, "en", "s", 1, "z")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string"
    for name, rows in (("odd", docs), ("none", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "x")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        assert corpus_pipeline.run(spark, sf).count() == 0  # short or all repeats: the base rules reject these
