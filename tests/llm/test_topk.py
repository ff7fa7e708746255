import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hubflow.llm import topk
from hubflow.llm.queries import LLM_QUERIES


def plain(rows, k, step, scale=1024):
    """Every query against every row."""
    kept = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x * scale) for x in v):
            kept.append((i, [math.floor(scale * float(x)) for x in v]))
    out = []
    for a, (i, q) in enumerate(kept):
        if i is None or i % step:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), j is None, j or 0) for b, (j, v) in enumerate(kept) if a != b]
        out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, rows, k=10, step=5, **sizes):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, row int, bucket int")
    got = topk.top_k(df, F.col("vec_id") % step == 0, k, **sizes)
    return sorted([(r.query_id, r["rank"], r["id"], r.score) for r in got.collect()], key=repr)


def test_buckets_rounds_and_both_searches(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    # lengths from a tenth to ten, tight clusters for the coordinate search
    x = centres[rng.integers(0, 6, 900)] + rng.normal(size=(900, 16)) * rng.choice([0.01, 1.0], 900)[:, None]
    x *= 10 ** rng.uniform(-1, 1, 900)[:, None]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    assert found(spark, rows, bucket_rows=64, block_rows=32, growth=2) == plain(rows, 10, 5)
    assert found(spark, rows) == plain(rows, 10, 5)
    # one bucket, of nearly equal lengths, and what it chooses for each query
    y = x / np.linalg.norm(x, axis=1)[:, None] * rng.uniform(0.95, 1, 900)[:, None]
    chosen, kept = [], topk.Bucket.by_coordinates
    monkeypatch.setattr(topk.Bucket, "by_coordinates", lambda self, unit, cosine: chosen.append(len(kept(self, unit, cosine))) or kept(self, unit, cosine))
    ids, m = np.arange(900), np.floor(1024 * y).astype(np.int64)
    size = np.sqrt((m.astype(float) ** 2).sum(1))
    bucket = topk.Bucket(ids, ids, m, size)
    scores = m @ m.T
    np.fill_diagonal(scores, np.iinfo(np.int64).min)
    floor = np.sort(scores, axis=1)[:, -10].astype(float)
    for q, places, s in topk.search(bucket, m, ids, size, floor, 10):
        want = sorted((-int(scores[q, j]), int(j)) for j in range(900) if j != q)[:10]
        assert [(-int(a), int(bucket.ids[p])) for p, a in zip(places, s)] == want
    assert 100 < len(chosen) < 900 and np.median(chosen) < 200


def test_ties_and_odd_rows(spark):
    v = [1.0, -0.5, 0.25]
    rows = [(i, v) for i in range(40)] + [(0, v), (None, v), (None, [0.5] * 3), (5, None), (7, [1.0, None, 0.0]), (8, [float("nan")] * 3), (9, [float("inf"), 0.0, 0.0])]
    rows += [(50, []), (55, [2.0]), (60, [0.0] * 3), (65, [-3.0, 0.0, 0.0, 9.0]), (-5, [0.001, 0.0, -0.001]), (70, [1e300, 0.0, 1.0]), (75, [1e306, 0.0, 1.0])]
    small = [r for r in rows if r[0] not in (70,)]
    assert found(spark, small, bucket_rows=8, block_rows=4, growth=2) == plain(small, 10, 5)
    assert found(spark, rows)  # a component beyond 2**31 is cut
    assert found(spark, rows[:3], k=10) == plain(rows[:3], 10, 5)
    assert found(spark, [(0, v)]) == [] and found(spark, []) == []


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-(2**20), 2**20, 9)]) for i in range(60)]
    assert found(spark, rows, bucket_rows=16) == plain(rows, 10, 5)


def test_a_third_of_all_rows_are_equal(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, (x[0] if i % 3 == 0 else x[i]).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cut = topk.vectors(df, "vec_id", "embedding", 1024, F.lit(True)).repartitionByRange(12, F.desc("size"), F.xxhash64("row"))
    sizes = [r[0] for r in cut.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 400
    assert found(spark, rows, step=50, bucket_rows=128) == plain(rows, 10, 50)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    got = sorted(tuple(r) for r in LLM_QUERIES["op12_top_k"](spark, folder).collect())
    assert got == sorted(con.sql(topk.OP12_SQL).fetchall()) and len(got) == 50
