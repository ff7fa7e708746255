"""Exact top-k by inner product, by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets. For a query q whose k-th best
score so far is t, a bucket whose longest vector has length l can only hold a
better one if some cosine reaches t / (|q| l): the local cosine threshold. If it
is above 1 the bucket is pruned whole, before anything is sent to it. Otherwise
the bucket is searched in one of two ways, chosen by that threshold:

* by coordinates, if it is at least ``COORDINATE_COSINE``: a unit vector at most
  the angle of the threshold away from the query has each coordinate in an
  interval around the query's. The bucket has its coordinates sorted; of a few
  coordinates in which the query is largest, the one whose interval holds fewest
  vectors gives the candidates and the others thin them out;
* by length, else: only vectors of length t / |q| or more, a prefix of the bucket.

What is left is verified by its inner product, in whole numbers.

Buckets are searched in rounds from the longest vectors on, each round having
``GROWTH`` times the buckets of the one before; after a round the k best of every
query and so its threshold are renewed. Hence a query passes on at most k rows a
bucket, all better than what ``1 / GROWTH`` of the vectors gave. A cell, one block
of queries and one bucket, is a task's unit: both sizes are bounded, and no
vector meets a query outside a cell that the threshold lets through.

Equal lengths and equal vectors are dealt over buckets by row number.

Defined cases: vectors that are null or hold a null or a non-finite component
(also after scaling) take no part; a shorter vector counts as padded with zeros,
an empty one scores 0; scaled components beyond 2**31 are cut to it and scores to
the range of a long; rows that repeat an id are rows of their own, each a
candidate of the other and, if the id is a query's, each with a result of its
own; a null id is no query and comes last among ties; an empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, staged, table

SCALE = 1024
#: Vectors of a bucket (about: the cuts are sampled), queries of a block.
BUCKET_ROWS = 8192
BLOCK_ROWS = 1024
#: Buckets of a round, in those of all rounds before it.
GROWTH = 16
#: Local threshold from which coordinates are searched, and how many of them.
COORDINATE_COSINE = 0.8
FOCUS = 4
#: Queries whose products are held at once.
AT_ONCE = 128
_LIMIT = 1 << 31
_ROOM = 1e-9  # pruning bounds are floats: so much is left for their error
_MOST = (1 << 63) - 1


def vectors(df: DataFrame, key: str, vector: str, scale: int, is_query: Column) -> DataFrame:
    """``id, row, query, v (whole numbers), size (length)`` of the vectors that
    take part."""
    rows = df.select(
        F.col(key).cast("long").alias("id"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(is_query, F.lit(False)).alias("query"),
        F.transform(F.col(vector), lambda x: x.cast("double") * F.lit(float(scale))).alias("x"),
    )
    whole = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform("x", lambda x: F.floor(F.greatest(F.least(x, F.lit(float(_LIMIT))), F.lit(float(-_LIMIT)))))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.where(F.col("x").isNotNull() & whole).select("id", "row", "query", v.alias("v")).withColumn("size", size)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of whole numbers, padded with zeros to ``width``."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, exact: in floats where
    all sums are whole numbers that floats hold, else in longs, else in Python's
    numbers, cut to the range of a long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most <= _MOST:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -_MOST - 1, _MOST).astype(np.int64)


class Bucket:
    """The vectors of a cell by decreasing length, with coordinates sorted on demand."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, matrix: np.ndarray, size: np.ndarray):
        order = np.argsort(-size, kind="stable")
        self.ids, self.rows, self.matrix, self.size = ids[order], rows[order], matrix[order], size[order]
        self._unit, self._sorted = None, {}

    def unit(self) -> np.ndarray:
        if self._unit is None:
            self._unit = self.matrix / np.maximum(self.size, 1)[:, None]
        return self._unit

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._sorted:
            order = np.argsort(self.unit()[:, f], kind="stable")
            self._sorted[f] = order, self.unit()[order, f]
        return self._sorted[f]

    def long_enough(self, least: float) -> int:
        """How many vectors, from the longest on, have at least that length."""
        return int(np.searchsorted(-self.size, -least, side="right"))

    def by_coordinates(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Places of the vectors whose focus coordinates allow the cosine."""
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        q = np.clip(unit[focus], -1, 1)
        wide = np.sqrt((1 - q * q) * (1 - cosine * cosine))
        low = np.where(-q >= cosine, -1.0, q * cosine - wide) - _ROOM
        high = np.where(q >= cosine, 1.0, q * cosine + wide) + _ROOM
        ranges = []
        for f, lo, hi in zip(focus, low, high):
            order, values = self.coordinate(f)
            ranges.append((np.searchsorted(values, lo, "left"), np.searchsorted(values, hi, "right"), order))
        least = min(range(len(ranges)), key=lambda i: ranges[i][1] - ranges[i][0])
        begin, end, order = ranges[least]
        places = order[begin:end]
        for i, f in enumerate(focus):
            if i != least and len(places):
                x = self.unit()[places, f]
                places = places[(x >= low[i]) & (x <= high[i])]
        return places


def search(bucket: Bucket, queries: np.ndarray, query_rows: np.ndarray, query_size: np.ndarray, floor: np.ndarray, k: int):
    """Up to ``k`` best rows of the bucket for each query, of scores ``floor``
    (NaN: none yet) or more. Yields the query's number, places and scores."""
    if not len(bucket.size):
        return
    longest = bucket.size[0]
    reach = query_size * longest
    cosine = np.divide(floor, reach, out=np.full(len(reach), np.nan), where=reach > 0) * (1 - _ROOM)
    # no threshold yet, or one that any vector may meet
    free = np.isnan(floor) | (floor <= 0)
    near = ~free & (cosine >= COORDINATE_COSINE) & (cosine <= 1)
    by_length = np.flatnonzero(free | (cosine < COORDINATE_COSINE))

    def best(q, places, scores):
        keep = np.ones(len(places), bool) if np.isnan(floor[q]) else scores >= floor[q]
        keep &= bucket.rows[places] != query_rows[q]
        places, scores = places[keep], scores[keep]
        if len(places) > k:  # the k-th score and all that tie with it
            keep = scores >= np.partition(scores, -k)[-k]
            places, scores = places[keep], scores[keep]
        order = np.lexsort((bucket.rows[places], bucket.ids[places], -scores.astype(object) if len(scores) and scores.min() == -_MOST - 1 else -scores))[:k]
        return q, places[order], scores[order]

    for q in np.flatnonzero(near):
        places = bucket.by_coordinates(queries[q] / query_size[q], float(cosine[q]))
        places = places[places < bucket.long_enough(floor[q] / query_size[q] * (1 - _ROOM))]
        yield best(q, places, _products(bucket.matrix[places], queries[q : q + 1])[:, 0])
    for at in range(0, len(by_length), AT_ONCE):
        some = by_length[at : at + AT_ONCE]
        prefix = [len(bucket.size) if free[q] else bucket.long_enough(floor[q] / query_size[q] * (1 - _ROOM)) for q in some]
        n = max(prefix)
        scores = _products(queries[some], bucket.matrix[:n])
        for i, q in enumerate(some):
            yield best(q, np.arange(prefix[i]), scores[i, : prefix[i]])


_NO_ID = np.iinfo(np.int64).max  # ties: a null id comes last (with rows as further order)


def _cell(_key, candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    width = max([int(x) for t in (candidates, queries) for x in t["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)], default=0)
    ids = candidates["id"].combine_chunks()
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    bucket = Bucket(ids.fill_null(_NO_ID).to_numpy(), candidates["row"].to_numpy(), _matrix(candidates["v"], width), candidates["size"].to_numpy())
    null_rows = candidates["row"].to_numpy()[~known]
    # as a float it may round up: the next one below loses no tie
    floor = np.nextafter(queries["floor"].cast(pa.float64(), safe=False).to_numpy(), -np.inf)
    rows, found, scores = [], [], []
    query_rows = queries["row"].to_numpy()
    for q, places, s in search(bucket, _matrix(queries["v"], width), query_rows, queries["size"].to_numpy(), floor, k):
        rows.append(np.full(len(places), q))
        found.append(places)
        scores.append(s)
    q = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    places = np.concatenate(found) if found else np.zeros(0, np.int64)
    return pa.table(
        {
            "query_id": queries["id"].combine_chunks().take(pa.array(q)),
            "query_row": pa.array(query_rows[q], pa.int64()),
            "id": pa.array(bucket.ids[places], pa.int64(), mask=np.isin(bucket.rows[places], null_rows)),
            "row": pa.array(bucket.rows[places], pa.int64()),
            "score": pa.array(np.concatenate(scores) if scores else [], pa.int64()),
        }
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
    bucket_rows: int = BUCKET_ROWS,
    block_rows: int = BLOCK_ROWS,
    growth: int = GROWTH,
) -> DataFrame:
    """The ``k`` rows of ``df`` with the highest inner products with each row
    for which ``is_query`` holds, itself left out: ``query_id, query_row, rank,
    id, row, score``."""
    rows = staged(vectors(df, key, vector, scale, is_query))
    total, queries = rows.agg(F.count("*"), F.count(F.when(F.col("query"), 1))).first()
    buckets, blocks = max(1, -(-total // bucket_rows)), max(1, -(-queries // block_rows))
    salt = F.xxhash64("row")
    cut = staged(rows.repartitionByRange(buckets, F.desc("size"), salt).withColumn("bucket", F.spark_partition_id()))
    longest = staged(cut.groupBy("bucket").agg(F.max("size").alias("longest")))
    block = F.pmod(F.xxhash64(F.lit(7), "row"), F.lit(blocks)).cast("int")
    asked = staged(cut.where("query").select("id", "row", "v", "size", block.alias("block")))
    found, begin, end = None, 0, 1
    # a part without rows gets no bucket, so that the last may lie beyond the count
    last = (longest.agg(F.max("bucket")).first()[0] or 0) + 1
    while begin < last:
        if found is None:
            open_queries = asked.withColumn("floor", F.lit(None).cast("long"))
        else:
            floors = found.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("floor"))
            open_queries = asked.join(floors, "row", "left")
        round_ = longest.where(F.col("bucket").between(begin, end - 1))
        spread = open_queries.withColumn("bucket", F.explode(F.sequence(F.lit(begin), F.lit(min(end, last) - 1)))).join(round_, "bucket")
        hopeful = F.col("floor").isNull() | (F.col("floor") <= F.col("size") * F.col("longest") * (1 + 1e-9))
        spread = staged(spread.where(hopeful).drop("longest"))
        cells = spread.select("bucket", "block").distinct()
        members = cut.join(cells, "bucket").select(F.col("bucket").alias("at"), F.col("block").alias("by"), "id", "row", "v", "size")
        kind = "query_id long, query_row long, id long, row long, score long"
        pairs = members.groupBy("at", "by").cogroup(spread.groupBy("bucket", "block"))
        got = pairs.applyInArrow(lambda key, a, b: _cell(key, a, b, k), kind)
        now = staged(_best(got if found is None else got.unionByName(found.drop("rank")), k))
        discard(spread)
        if found is not None:
            discard(found)
        found, begin, end = now, end, end * growth
    for x in (rows, cut, longest, asked):
        discard(x)
    return found


def op12_top_k(spark, sf_dir: str) -> DataFrame:
    """The 10 best of all embeddings for every hundredth."""
    found = top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP12_SQL = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(1024 * x::DOUBLE))) = 0
), numbered AS (SELECT *, row_number() OVER () AS r FROM scaled),
scores AS (
  SELECT q.vec_id AS query_id, q.r AS r, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM numbered q JOIN numbered c ON q.r <> c.r
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id ASC NULLS LAST) AS rank FROM scores
) WHERE rank <= 10
"""
