"""Shuffled shards by a two-pass external shuffle.

Pass one scatters the records uniformly into memory-sized buckets by a seeded
hash of all their columns. Pass two loads one bucket a task, puts it in random
order by Fisher-Yates and writes it. The buckets one after another are the
shuffled order; shard ``s`` of ``S`` takes the ranks ``s*N/S`` to
``(s+1)*N/S``, so shard counts differ by one at most.

Rows that are equal in all columns have equal hashes. Hashes are counted first;
where more than ``EQUAL_ROWS`` rows share one, equal rows are counted exactly
and travel as one row with its number of copies, cut into pieces of at most
``EQUAL_ROWS`` copies, each of which draws a bucket of its own. So neither a
shuffle nor a bucket holds a third of all rows because they are equal.

Reruns agree: buckets, the order before the shuffle and the draws depend on the
rows and the seed alone, so a bucket that is made anew after a lost executor is
the same one.

Defined cases: null ids and null or empty texts are ordinary rows (a null text
has size 8 and checksum 0); rows that are equal in all columns are
interchangeable and each gets its own slot; a text may be as long as a bucket or
longer and is moved whole; an empty table gives no rows. Columns of the input
named ``shard`` or ``slot`` are replaced. Columns that hold maps take no part in
the hash, but do in the comparison of rows.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hubflow.sources.sinks import shared_dir

from .common import staged, table

SHARDS = 24
SEED = 20240601
#: Bytes of records that one bucket holds, about.
BUCKET_BYTES = 48 << 20
#: Equal rows that are dealt to a bucket together.
EQUAL_ROWS = 64


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text and eight for the id."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def fisher_yates(n: int, rng: np.random.Generator) -> list[int]:
    """A uniform random order of ``range(n)``."""
    order = list(range(n))
    draws = rng.integers(0, np.arange(1, n + 1)).tolist() if n else []
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return order


def _pieces(docs: DataFrame, hot: DataFrame, content: Column, number, equal_rows: int) -> DataFrame:
    """The distinct rows of ``docs`` whose hash is in ``hot``, each as pieces
    (``__n`` copies, ``__bucket``) that add up to its number of copies."""
    marked = docs.withColumn("__content", content)
    rows = marked.join(hot.select("__content"), "__content", "left_semi")
    counted = rows.groupBy("__content", *[f"`{c}`" for c in docs.columns]).agg(F.count("*").alias("__c"))
    parts = F.ceil(F.col("__c") / equal_rows)
    dealt = counted.withColumn("__p", parts).withColumn("__j", F.explode(F.expr("sequence(0L, __p - 1)")))
    copies = F.expr("__c div __p + if(__j < __c % __p, 1, 0)")
    return dealt.select(*docs.columns, "__content", copies.alias("__n"), number(F.xxhash64("__content", "__j")).alias("__bucket"))


def shuffled_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    text: str = "text",
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    equal_rows: int = EQUAL_ROWS,
) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (gapless from 0 in each shard)."""
    docs = docs.drop("shard", "slot")
    columns = docs.columns
    hashable = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    content = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in hashable])

    size = record_size(F.col(f"`{text}`"))
    counts = staged(docs.select(content.alias("__content"), size.alias("b")).groupBy("__content").agg(F.count("*").alias("__c"), F.sum("b").alias("b")))
    total = counts.agg(F.sum("__c").alias("n"), F.sum("b").alias("b")).first()
    rows, buckets = total["n"] or 0, max(shards, math.ceil((total["b"] or 0) / bucket_bytes))

    def number(draw: Column) -> Column:
        return F.pmod(draw, F.lit(buckets)).cast("int")

    scattered = docs.withColumns({"__content": content, "__n": F.lit(1).cast("long"), "__bucket": number(content)})
    held = counts.where(F.col("__c") <= equal_rows).select(number(F.col("__content")).alias("__bucket"), F.col("__c").alias("__n"))
    hot = counts.where(F.col("__c") > equal_rows)
    if not hot.isEmpty():
        hot = staged(hot)
        pieces = staged(_pieces(docs, hot, content, number, equal_rows))
        scattered = scattered.join(hot.select("__content"), "__content", "left_anti").select(*columns, "__content", "__n", "__bucket").unionByName(pieces)
        held = held.unionByName(pieces.select("__bucket", "__n"))

    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy("__bucket").agg(F.sum("__n").alias("__n"))
    starts = staged(sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    scattered = scattered.join(starts, "__bucket").select(*columns, "__content", "__n", "__bucket", "__start")

    def shuffle(bucket_rows: pa.Table) -> pa.Table:
        ordered = bucket_rows.select(["__content", "__n"]).append_column("__i", pa.array(np.arange(bucket_rows.num_rows)))
        first = ordered.sort_by([("__content", "ascending"), ("__n", "ascending")])
        first = np.repeat(first["__i"].to_numpy(), first["__n"].to_numpy())
        bucket = bucket_rows["__bucket"][0].as_py()
        order = first[fisher_yates(len(first), np.random.Generator(np.random.PCG64([seed, bucket])))]
        rank = pa.array(bucket_rows["__start"][0].as_py() + np.arange(len(order)), pa.int64())
        return bucket_rows.select(columns).take(pa.array(order)).append_column("__rank", rank)

    def buckets_of(batches):
        """A task holds one bucket; where Spark gave it more, one after another."""
        held = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        for bucket in held["__bucket"].unique().to_pylist() if held else []:
            yield from shuffle(held.filter(pc.equal(held["__bucket"], bucket))).to_batches(max_chunksize=1024)

    whole = scattered.repartitionById(buckets, F.col("__bucket"))
    out = whole.mapInArrow(buckets_of, T.StructType([*docs.schema.fields, T.StructField("__rank", T.LongType())]))
    shard = F.expr(f"(__rank * {shards}) div {max(rows, 1)}")
    first_rank = F.expr(f"(((__rank * {shards}) div {max(rows, 1)}) * {rows} + {shards - 1}) div {shards}")
    return out.select(*columns, shard.cast("int").alias("shard"), (F.col("__rank") - first_rank).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; the records of a file are in slot order."""
    sharded.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def op4_shuffled_shards(spark, sf_dir: str) -> DataFrame:
    """All documents written to shuffled shards; the result is read from those."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(shuffled_shards(docs), path)
    schema = T.StructType([*docs.schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    text = F.col("text")
    return spark.read.schema(schema).parquet(path).select(
        "doc_id",
        record_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
