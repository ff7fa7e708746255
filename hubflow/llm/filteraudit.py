"""Audit of how filters interact, by min-plus removal ranks.

A document's failures under ``k`` filters are a mask, so documents are counted
by (part, mask), of which a part has at most ``2**k``. The mask matrix M
(mask x filter) holds 0 where the mask fails the filter and infinity elsewhere;
the position matrix P (filter x order) holds the inverse permutation of every
order of the filters: the step at which a filter is applied. Their product in
the (min, +) semiring,

    R[mask, order] = min over filters f of M[mask, f] + P[f, order],

is the step at which an order removes the documents of a mask (infinity: they
are kept). Scattering each mask's document counts to (order, R) gives what every
step removes; running sums of that give what is kept, and a filter's failures
less what it removes are those that were removed before it.

Failures are found by one pass over the texts, a count by text hash for copies,
and joins on the text hash and the id; only (part, mask) counts, pre-aggregated
where the rows are, meet by part. A frequent text or part is split by these.

Defined cases: a null text is empty; a null part is the empty part; a null id has
no label and is no copy, and gives no other row a smaller id; rows that repeat an
id are counted each, and none is a copy of the other; several labels of one id
count as one that holds if any does, null labels as 0; a very long text is read
whole in one task, its words are held once; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_slices, staged, table

NAMES = "ABCDE"
MIN_WORDS = 50
#: Percent: least distinct words of all words, most upper-case letters of all characters.
MIN_DISTINCT = 65
MAX_UPPER = 5
SYMBOLS = b"#$%&*|"

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no character


def text_mask(text: bytes) -> int:
    """Failures of a UTF-8 text: bit 0 too few words, bit 1 too few distinct
    ones, bit 2 too much upper case, bit 3 a symbol."""
    words = text.split()  # at the bytes 0x20 and 0x09 to 0x0D
    upper = len(text) - len(text.translate(None, _UPPER))
    characters = len(text.translate(None, _CONTINUED))
    short = len(words) < MIN_WORDS
    repeated = 100 * len(set(words)) < MIN_DISTINCT * len(words)
    loud = 100 * upper > MAX_UPPER * characters
    marked = len(text.translate(None, SYMBOLS)) < len(text)
    return short + 2 * repeated + 4 * loud + 8 * marked


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``key, part, mask`` of every row; bit 4 of the mask marks a text that a
    smaller key has too."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))

    def compute(batches):
        for cut in row_slices(batches):
            texts = [t or b"" for t in cut.column(2).cast(pa.binary()).to_pylist()]
            masks = pa.array([text_mask(t) for t in texts], pa.int32())
            hashes = pa.array([blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), masks, hashes], ["key", "part", "mask", "hash"])

    kind = rows.schema["key"].dataType.simpleString()
    marked = staged(rows.mapInArrow(compute, f"key {kind}, part string, mask int, hash binary"))
    first = marked.groupBy("hash").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")
    copy = F.when(F.col("key") > F.col("first"), 1 << 4).otherwise(0)
    return marked.join(first, "hash", "left").select("key", "part", F.col("mask").bitwiseOR(copy).alias("mask"))


def removal_ranks(k: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All orders of ``k`` filters, the position matrix P (filter x order,
    steps from 1), and R (mask x order): the step that removes a mask,
    ``k + 1`` for infinity."""
    orders = list(permutations(range(k)))
    position = np.argsort(np.array(orders), axis=1).T + 1
    fails = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1
    mask_matrix = np.where(fails, 0, k + 1)
    rank = np.full((1 << k, len(orders)), k + 1)
    for f in range(k):  # the min-plus product, one filter at a time
        np.minimum(rank, mask_matrix[:, f, None] + position[f], out=rank)
    return orders, position, rank


def audit(masks: DataFrame, names: Sequence[str] = NAMES) -> DataFrame:
    """``masks`` (part, mask, docs, good, toxic: counts, in any number of rows a
    mask) to one row per part, order of the filters and step. ``names`` has a
    name for each bit of the mask; ``k`` filters have ``k!`` orders, so few are
    meant."""
    k = len(names)
    weights = ["docs", "good", "toxic"]
    counted = masks.groupBy("part", "mask").agg(*[F.sum(w).alias(w) for w in weights])
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *weights)).alias("counts"))  # at most 2**k
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def scatter(batches):
        orders, position, rank = removal_ranks(k)
        spelled = ["".join(names[f] for f in order) for order in orders]
        at = np.arange(len(orders))
        filters = np.array(orders)
        order_col = pa.array(np.repeat(spelled, k))
        step_col = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)))
        filter_col = pa.array(np.array(list(names))[filters.ravel()])
        for batch in batches:
            for row in batch.to_pylist():
                weight = np.zeros((1 << k, 3), np.int64)
                for c in row["counts"]:
                    weight[c["mask"]] = [c[w] for w in weights]
                lost = np.zeros((len(orders), k + 2, 3), np.int64)
                np.add.at(lost, (at[None, :], rank), weight[:, None, :])
                removed = lost[:, 1 : k + 1, 0]
                fails = np.array([weight[(np.arange(1 << k) >> f) & 1 == 1, 0].sum() for f in range(k)])
                alone = weight[1 << np.arange(k), 0]
                shapley = np.array([lost[at, position[f], 0].sum() for f in range(k)])
                values = [
                    weight[:, 0].sum() - np.cumsum(removed, axis=1),
                    removed,
                    fails[filters] - removed,
                    alone[filters],
                    lost[:, 1 : k + 1, 1],
                    lost[:, 1 : k + 1, 2],
                    shapley[filters],
                ]
                part_col = pa.array([row["part"]] * len(step_col), pa.string())
                yield pa.RecordBatch.from_arrays([part_col, order_col, step_col, *[pa.array(v.ravel()) for v in values], filter_col], ["part", "filter_order", "step", *columns, "filter"])

    return parts.mapInArrow(scatter, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns) + ", filter string")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The five filters over ``documents``, with what ``labels`` says of the
    documents that each step removes."""
    failed = failures(table(spark, sf_dir, "documents"))
    flag = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(c)
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("key")).agg(flag("quality"), flag("toxic"))
    either = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    masks = failed.join(labels, "key", "left").select("part", "mask", F.lit(1).cast("long").alias("docs"), either("quality").alias("good"), either("toxic").alias("toxic"))
    return audit(masks)


OP13_SQL = r"""
WITH told AS (
  SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic
  FROM labels GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), marked AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         {'A': len(w) < 50,
          'B': 100 * len(list_distinct(w)) < 65 * len(w),
          'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'),
          'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS f
  FROM texts LEFT JOIN told USING (doc_id)
), long AS (
  SELECT *, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END)
         || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS failed
  FROM marked
), kinds AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM long GROUP BY part, failed
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x
), steps AS (
  SELECT filter_order, s::INTEGER AS step, filter_order[s] AS filter, filter_order[1:s - 1] AS before
  FROM orders, range(1, 6) r(s)
), told_steps AS (
  SELECT part, filter_order, step, filter,
    coalesce(sum(n) FILTER (WHERE NOT regexp_matches(failed, '[' || before || filter || ']')), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE contains(failed, filter) AND translate(failed, before, '') = failed), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE contains(failed, filter) AND translate(failed, before, '') <> failed), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE failed = filter), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE contains(failed, filter) AND translate(failed, before, '') = failed), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE contains(failed, filter) AND translate(failed, before, '') = failed), 0) AS toxic_lost
  FROM kinds, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley, filter
FROM told_steps
"""
