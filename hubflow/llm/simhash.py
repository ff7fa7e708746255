"""SimHash near-duplicates by a Gray-order hierarchical index.

A text's fingerprint has 64 bits, each the majority of that bit over the hashes
of its word shingles. Documents whose fingerprints differ in at most
``max_bits`` bits are linked; groups are the connected components of the links.

Search: fingerprints are cut into blocks, and two that differ in at most
``max_bits`` bits agree in at least ``blocks - max_bits`` of them, so every
choice of that many blocks makes one table of buckets that no link escapes. In
a bucket the fingerprints are sorted by Gray rank, where neighbours share most
bits. Runs of neighbours form nodes that factor out the bits all members share
(mask and pattern), runs of nodes form upper nodes, and pairs of nodes are
compared from the top: a pair whose shared patterns already differ in more than
``max_bits`` bits is pruned with everything below it. The bottom compares whole
fingerprints, so the search is exact.

Only distinct fingerprints are searched, so copies cost nothing. A bucket above
``BUCKET_ROWS`` is split into parts by hash, and every two parts meet in a task
of bounded size. A bucket emits the edges of a spanning forest, not its pairs.

Defined cases: null and empty texts have fingerprint zero and are linked like
any other; texts with fewer words than a shingle are one shingle; a null id
never names a group (a group without ids has a null name); an empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_slices, staged, table
from .components import components

SHINGLE = 4
MAX_BITS = 4
BLOCKS = 6
#: Distinct fingerprints of a bucket that one task compares, and children of a node.
BUCKET_ROWS = 4096
FANOUT = 8
#: Rows gathered before their buckets are searched, and node pairs held at once.
ROWS_AT_ONCE = 100_000
PAIRS_AT_ONCE = 1 << 19


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of the lower-cased (A-Z) text; zero without words."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    m = max(1, len(w) - shingle + 1)
    a, b = starts[:m].tolist(), ends[len(w) - m :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, m, 1 << 14):
        hashes = np.array([digest(joined[x:y], 42) for x, y in zip(a[i : i + (1 << 14)], b[i : i + (1 << 14)])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > m, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: Column, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key`` and ``fp`` (the fingerprint's bits as a long) of every row."""
    rows = docs.select(key.alias("key"), F.col(text).alias("text"))

    def compute(batches):
        for part in row_slices(batches):
            got = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got.view(np.int64))], ["key", "fp"])

    return rows.mapInArrow(compute, f"key {rows.schema['key'].dataType.simpleString()}, fp long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    rank = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def _runs(sizes: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut consecutive groups of the given sizes into runs of at most
    ``fanout``: where each run begins, and how many runs each group has."""
    per = -(-sizes // fanout)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    within = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    return np.repeat(first, per) + within * fanout, per


def linked(bucket: np.ndarray, code: np.ndarray, max_bits: int = MAX_BITS, fanout: int = FANOUT) -> tuple[np.ndarray, np.ndarray]:
    """Edges (indexes into ``code``) that span the links inside each bucket."""
    order = np.lexsort((gray_rank(code), bucket))
    code, label = code[order], np.arange(len(order))
    _, sizes = np.unique(bucket[order], return_counts=True)
    # levels of nodes from single fingerprints up to one node a bucket: the
    # bits that all members have as one, and as zero, and the children
    levels = [(code, ~code, None, None)]
    while (sizes > 1).any():
        ones, zeros = levels[-1][:2]
        at, per = _runs(sizes, fanout)
        ends = np.concatenate((at[1:], [len(ones)]))
        levels.append((np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at), at, ends))
        sizes = per
    top = np.arange(len(levels[-1][0]))
    stack = [(len(levels) - 1, top, top)]
    while stack:
        level, a, b = stack.pop()
        if level == 0:
            keep = a < b
            _union(label, a[keep], b[keep])
            continue
        if len(a) > PAIRS_AT_ONCE // (fanout * fanout):
            half = len(a) // 2
            stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        _, _, at, ends = levels[level]
        na, nb = ends[a] - at[a], ends[b] - at[b]
        total = na * nb
        pair = np.repeat(np.arange(len(a)), total)
        k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        x, y = at[a][pair] + k // nb[pair], at[b][pair] + k % nb[pair]
        ones, zeros = levels[level - 1][:2]
        differ = np.bitwise_count((ones[x] & zeros[y]) | (zeros[x] & ones[y]))
        keep = (differ <= max_bits) & (x <= y)
        if keep.any():
            stack.append((level - 1, x[keep], y[keep]))
    child = np.flatnonzero(label != np.arange(len(label)))
    return order[child], order[label[child]]


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of each a and b; a class is labelled by its first member."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def links(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``distinct`` (fp) to edges (a, b) that span all links."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    tables = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        mask = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen)
        mask -= 1 << 64 if mask >> 63 else 0
        tables.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("k")))
    dealt = distinct.select("fp", F.explode(F.array(*tables)).alias("b")).select("fp", "b.t", "b.k")
    large = staged(dealt.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows))
    parts = F.coalesce(F.ceil(F.col("n") / (bucket_rows // 2)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), "fp"), F.col("parts")).cast("int")
    split = dealt.join(large, ["t", "k"], "left").withColumn("parts", parts).withColumn("own", own)
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    bucket = F.xxhash64("t", "k", F.least("own", "other"), F.greatest("own", "other"))
    rows = split.select(bucket.alias("bucket"), "fp").repartition("bucket").sortWithinPartitions("bucket")

    def search(batches):
        def edges_of(b, c):
            x, y = linked(b, c.view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(c[x]), pa.array(c[y])], ["a", "b"])

        held_b, held_c, held = [], [], 0
        for batch in batches:
            held_b.append(batch.column(0).to_numpy())
            held_c.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held >= ROWS_AT_ONCE:
                b, c = np.concatenate(held_b), np.concatenate(held_c)
                cut = int(np.searchsorted(b, b[-1]))  # the last bucket may go on
                if cut:
                    yield edges_of(b[:cut], c[:cut])
                held_b, held_c, held = [b[cut:]], [c[cut:]], len(b) - cut
        if held:
            yield edges_of(np.concatenate(held_b), np.concatenate(held_c))

    return rows.mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, text_hash, fp, component_id`` of every row of ``docs``."""
    id_and_hash = F.struct(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    rows = staged(fingerprints(docs, id_and_hash, text, shingle).select("key.doc_id", "key.text_hash", "fp"))
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = components(links(distinct.select("fp"), max_bits).distinct())
    groups = staged(
        distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    )
    names = staged(groups.groupBy("label").agg(F.min("first_id").alias("component_id")))
    named = staged(groups.join(names, "label").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group: that with the smallest id (null ids last, then by
    text). Rows equal in id and text count as one."""
    rows = near_duplicates(docs, key, text, shingle, max_bits)
    # groups without any id go by fingerprint: they have no name to tell them apart
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp"))
    who = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"))
    keep = staged(rows.groupBy(group.alias("g")).agg(F.min(who).alias("w")).select("w.doc_id", "w.text_hash").distinct())
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(key).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
    )
    keep = keep.withColumnsRenamed({"doc_id": "k_id", "text_hash": "k_hash"})
    same = packed["doc_id"].eqNullSafe(keep["k_id"]) & (packed["text_hash"] == keep["k_hash"])
    left = packed.join(keep, same, "left_semi")
    one = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("doc_id"))
    return left.withColumn("n", one).where("n = 1").select("row.*")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
