"""Prefix trie of conversations by van Emde Boas recursion.

A trie over sequences of at most ``2**j`` turns is cut at half depth. The cut
prefixes are named; the sequences up to the cut form an upper trie under the
same root, what follows a cut prefix forms a lower trie with that prefix as its
root, and all these tries of at most ``2**(j-1)`` turns are cut again, every one
of a level in the same jobs, until single turns are left: the nodes. Equal
sequences under one root are merged at each level, so that a prefix that very
many conversations share is one row below the level that finds it.

Sequences are names, not lists: two halves of a sequence have names, and the pair
of them names the whole (a table of halves for each level, made bottom up). So a
row has a fixed size however long a conversation is, and no conversation, prefix
or group of copies is gathered anywhere.

Totals of subtrees are grafted upward by the same cuts: the total of a lower trie
is added to its cut prefix, a sum per root makes the totals of the next level,
and what was added to a sequence's end is handed down to all nodes along it by
cutting the sequence again.

Turns get their places by one range sort over all turns and sums over its
partitions, so a conversation may be longer than a task. The ids of the
conversations that end at a node are sorted the same way and hashed in order,
as pieces of text.

Defined cases: turns are ordered by number, null first, and turns of one number
by the SHA-256 of role and text; repeated rows are turns of their own; a null
role or text is empty; rows without a conversation id belong to none; texts are
read once, whole, and only their hash and number of words travel; an empty table
has no root and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, table

#: Conversations of a family share the first turns of the one whose id is a multiple.
FAMILY = 20
#: At most this many turns less one are taken from it.
LENT = 4
#: Bytes of joined ids that are hashed at once.
PIECE = 1 << 16


def _root() -> Column:
    zero = F.lit(0).cast("long")
    return F.struct(zero.alias("a"), zero.alias("b"))


def _name(kind: str, *parts: Column) -> Column:
    """A 128-bit name of what the parts name together."""
    return F.struct(F.xxhash64(F.lit(f"{kind} a"), *parts).alias("a"), F.xxhash64(F.lit(f"{kind} b"), *parts).alias("b"))


def _only(name: Column) -> Column:
    """The one name of a group that isn't null; null if there is none. (Longs
    are aggregated in place, structs would need a sort.)"""
    a, b = F.max(name["a"]), F.max(name["b"])
    return F.when(a.isNotNull(), F.struct(a.alias("a"), b.alias("b")))


def _number(batches):
    """Places of the rows within each run of equal first columns."""
    last, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        at = np.arange(len(key))
        new = np.concatenate(([last is None or key[0] != last], key[1:] != key[:-1]))
        place = at - np.maximum.accumulate(np.where(new, at, 0))
        if not new[0]:
            place[: int(new.argmax()) if new.any() else len(key)] += n
        last, n = key[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], [*batch.schema.names, "place"])


def placed(conversations: DataFrame) -> DataFrame:
    """``conv, pos, tok, words, turns``: every turn's place from 0, name, words
    of the text, and the number of turns of the conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("tie"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv", F.asc_nulls_first("turn"), "tie", "row"]  # equal rows are dealt by their number
    number = lambda at: F.conv(F.substring("tie", at, 15), 16, 10).cast("long")
    ranged = (
        staged(rows)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv", F.spark_partition_id().alias("pid"), F.struct(number(1).alias("a"), number(16).alias("b")).alias("tok"), "words")
    )
    part = staged(ranged.select("conv", "pid", "tok.a", "tok.b", "words").mapInArrow(_number, "conv long, pid int, a long, b long, words long, place long"))
    pieces = part.groupBy("conv", "pid").agg(F.count("*").alias("n"))
    own = Window.partitionBy("conv")
    pieces = pieces.select(
        "conv",
        "pid",
        (F.sum("n").over(own.orderBy("pid")) - F.col("n")).alias("before"),
        F.sum("n").over(own).alias("turns"),
    )
    return part.join(staged(pieces), ["conv", "pid"]).select("conv", (F.col("before") + F.col("place")).alias("pos"), F.struct("a", "b").alias("tok"), "words", "turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``placed`` turns to the conversations that are rebuilt from them: their
    turns (conv, pos, tok, words), and all ids (conv), turnless ones included."""
    turns = staged(turns)
    convs = turns.where("pos = 0").select("conv", "turns")
    base = convs.select(F.col("conv").alias("base"), F.col("turns").alias("base_turns"))
    lent = staged(
        convs.select("conv", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), (F.crc32(F.col("conv").cast("string")) % LENT).alias("h"))
        .join(base, "base", "left")
        .select("conv", "base", "h", F.least("h", F.coalesce("base_turns", F.lit(0))).alias("lent"))
    )
    own = turns.join(lent, "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "tok", "words")
    first = turns.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < LENT - 1)).select(F.col("conv").alias("base"), "pos", "tok", "words")
    taken = first.join(lent.where("lent > 0"), "base").where("pos < lent").select("conv", "pos", "tok", "words")
    return staged(own.unionByName(taken)), lent.select("conv")


def _batch(rows: list[tuple], key: str, *rest: str) -> pa.RecordBatch:
    """Rows whose last value is a text and whose others are longs."""
    names = [*key, *rest]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1], pa.string())], names)


def _ends(ids: DataFrame) -> DataFrame:
    """``ids`` (key, conv) to (key, sha): SHA-256 of the key's ids in order."""
    flat = ids.select("key.a", "key.b", "conv")
    ranged = flat.repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv")

    def join(batches):
        key, begin, held, size = None, None, [], 0
        for batch in batches:
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != key or size >= PIECE:
                    if held:
                        yield key, begin, held
                    key, begin, held, size = (a, b), conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield key, begin, held

    def pieces(batches):
        out, size = [], 0
        for key, begin, held in join(batches):
            out.append((*key, begin, ",".join(held)))
            size += len(out[-1][-1])
            if size >= PIECE or len(out) >= 4096:
                yield _batch(out, "ab", "begin", "ids")
                out, size = [], 0
        yield _batch(out, "ab", "begin", "ids")

    def digest(batches):
        key, h = None, None
        for batch in batches:
            out = []
            for a, b, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (a, b) != key:
                    if h:
                        out.append((*key, h.hexdigest()))
                    key, h = (a, b), sha256(text.encode())
                else:
                    h.update(b"," + text.encode())
            yield _batch(out, "ab", "sha")
        if h:
            yield _batch([(*key, h.hexdigest())], "ab", "sha")

    cut = ranged.mapInArrow(pieces, "a long, b long, begin long, ids string")
    done = cut.repartition("a", "b").sortWithinPartitions("a", "b", "begin").mapInArrow(digest, "a long, b long, sha string")
    return done.select(F.struct("a", "b").alias("key"), "sha")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``turns`` (conv, pos gapless from 0, tok, words) and all ids (conv, once
    each) to one row per node: ``conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``."""
    deepest = turns.agg(F.max("pos")).first()[0]
    levels = deepest.bit_length() if deepest is not None else 0  # 2**levels >= turns of any conversation

    # names of halves, bottom up
    blocks, halves = turns.select("conv", F.col("pos").alias("i"), F.col("tok").alias("seq")), {}
    for j in range(1, levels + 1):
        even = F.col("i") % 2 == 0
        pairs = blocks.groupBy("conv", F.floor(F.col("i") / 2).alias("i")).agg(
            _only(F.when(even, F.col("seq"))).alias("left"), _only(F.when(~even, F.col("seq"))).alias("right")
        )
        # a half that nothing follows keeps its name
        blocks = staged(pairs.withColumn("seq", F.when(F.col("right").isNull(), F.col("left")).otherwise(_name("halves", F.col("left"), F.col("right")))))
        halves[j] = staged(blocks.where("right IS NOT NULL").select("seq", "left", "right").distinct())
    whole = blocks.select("conv", "seq")

    # cuts, top down: root, seq -> the part up to the cut under the same root,
    # and what follows under the name of the cut prefix
    tries = staged(
        whole.groupBy("seq")
        .agg(F.count("*").alias("n"), F.min("conv").alias("first"))
        .select(_root().alias("root"), "seq", _name("cut", _root(), F.col("seq")).alias("end"), F.lit(0).cast("long").alias("above"), "n", "first", F.col("seq").alias("whole"))
    )
    cuts = {}
    for j in range(levels, 0, -1):
        cut = tries.join(halves[j], "seq", "left").withColumn("left", F.coalesce("left", "seq"))
        cuts[j] = cut = staged(cut.withColumn("mid", _name("cut", F.col("root"), F.col("left"))))
        ends_here = F.when(F.col("right").isNull(), F.col("whole"))
        upper = cut.select("root", F.col("left").alias("seq"), F.col("mid").alias("end"), "above", "n", "first", ends_here.alias("whole"))
        below = (F.col("above") + (1 << (j - 1))).alias("above")
        lower = cut.where("right IS NOT NULL").select(F.col("mid").alias("root"), F.col("right").alias("seq"), "end", below, "n", "first", "whole")
        merged = upper.unionByName(lower).groupBy("root", "seq", "end", "above")
        tries = staged(merged.agg(F.sum("n").alias("n"), F.min("first").alias("first"), _only(F.col("whole")).alias("whole")))

    # single turns under a root: the nodes
    said = turns.groupBy(F.col("tok").alias("seq")).agg(F.max("words").alias("words"))
    children = tries.groupBy(F.col("root").alias("end")).agg(F.count("*").alias("n_children"))
    nodes = staged(
        tries.join(said, "seq")
        .join(children, "end", "left")
        .select(
            "root", "seq", "end", (F.col("above") + 1).alias("depth"), "n", "first", "whole",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            ((F.col("n") - 1) * F.col("words")).alias("saved"),
            F.col("n_children").isNull().cast("long").alias("leaves"),
        )
    )

    # totals of tries by root, and what each cut prefix gets from the trie below it
    sums = [F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")]
    totals, grafts = staged(nodes.groupBy("root").agg(*sums)), {}
    for j in range(1, levels + 1):
        stems = cuts[j].where("right IS NOT NULL").select("root", "left", "mid").distinct()
        lower = totals.withColumnRenamed("root", "mid")
        grafts[j] = staged(stems.join(lower, "mid").select("root", F.col("left").alias("seq"), "saved", "leaves"))
        totals = staged(totals.unionByName(grafts[j].drop("seq")).groupBy("root").agg(*sums))

    # handed down along the sequences that end at a cut prefix
    given = None
    for j in range(levels, 0, -1):
        parts = grafts[j]
        if given is not None:
            along = given.join(cuts[j].select("root", "seq", "left", "mid", "right"), ["root", "seq"])
            upper = along.select("root", F.col("left").alias("seq"), "saved", "leaves")
            lower = along.where("right IS NOT NULL").select(F.col("mid").alias("root"), F.col("right").alias("seq"), "saved", "leaves")
            parts = parts.unionByName(upper).unionByName(lower)
        given = staged(parts.groupBy("root", "seq").agg(*sums))
    if given is not None:
        given = given.withColumnsRenamed({"saved": "more_saved", "leaves": "more_leaves"})
        nodes = nodes.join(given, ["root", "seq"], "left")
        for c in ("saved", "leaves"):
            nodes = nodes.withColumn(c, F.col(c) + F.coalesce(f"more_{c}", F.lit(0)))

    # the root, the parents' names and the ends
    turnless = convs.join(whole, "conv", "left_anti").select(_root().alias("key"), "conv")
    ends = staged(_ends(whole.select(F.col("seq").alias("key"), "conv").unionByName(turnless)))
    top = totals.where((F.col("root.a") == 0) & (F.col("root.b") == 0)).select("saved", "leaves").first()
    n_top = tries.where((F.col("root.a") == 0) & (F.col("root.b") == 0)).count()
    as_long = lambda x: F.lit(x).cast("long")
    root = (
        convs.agg(F.min("conv").alias("first"), F.count("*").alias("n"))
        .where("n > 0")
        .select(
            F.lit(None).cast("struct<a:long,b:long>").alias("root"), _root().alias("end"), as_long(0).alias("depth"), "n", "first", _root().alias("whole"),
            as_long(n_top).alias("n_children"), as_long(top["saved"] if top else 0).alias("saved"), as_long(top["leaves"] if top else 1).alias("leaves"),
        )
    )
    every = nodes.select(root.columns).unionByName(root)
    parents = every.select(F.col("end").alias("root"), F.col("first").alias("parent"))
    return (
        every.join(parents, "root", "left")
        .join(ends.withColumnRenamed("key", "whole"), "whole", "left")
        .select(
            F.col("first").alias("conv_id"),
            "depth",
            F.col("parent").alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            "n_children",
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("sha", F.lit(sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(*rebuilt(placed(table(spark, sf_dir, "conversations"))))


# CRC-32 (polynomial 0xEDB88320, reflected) of the decimal digits, bit by bit
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda crc, byte: list_reduce(
      list_prepend(xor(crc, byte), range(8)),
      lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)))"""

OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, sha256(length(r) || ':' || r || t) AS tok,
         len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || t)) - 1 AS p
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)
), ids AS (
  SELECT c, c - c % 20 AS base, ({_CRC32.format("c")}) % 4 AS h FROM (SELECT DISTINCT c FROM turns)
), rows AS (
  SELECT i.c, 0 AS part, p, tok, words FROM ids i JOIN turns t ON t.c = i.base WHERE p < h
  UNION ALL
  SELECT i.c, 1 AS part, p, tok, words FROM ids i JOIN turns t ON t.c = i.c WHERE p >= h
), seqs AS (
  SELECT ids.c, coalesce(s, []) AS s, coalesce(w, []) AS w
  FROM ids LEFT JOIN (SELECT c, list(tok ORDER BY part, p) AS s, list(words ORDER BY part, p) AS w FROM rows GROUP BY c) USING (c)
), members AS (
  SELECT c, unnest(range(len(s) + 1)) AS d, s, w FROM seqs
), nodes AS (
  SELECT s[1:d] AS path, d, min(c) AS conv_id, count(*) AS n, any_value(CASE WHEN d > 0 THEN w[d] ELSE 0 END) AS words,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(s) = d), '') AS ends
  FROM members GROUP BY s[1:d], d
), kids AS (
  SELECT path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), known AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)
), above AS (
  SELECT path[1:k] AS path, (n - 1) * words AS saved, n_children = 0 AS leaf FROM known, LATERAL unnest(range(d + 1)) u(k)
), totals AS (
  SELECT path, sum(saved) AS saved, count(*) FILTER (WHERE leaf) AS n_leaves FROM above GROUP BY path
)
SELECT k.conv_id, k.d::BIGINT AS depth, up.conv_id AS parent_conv_id, k.n::BIGINT AS n_convs, k.n_children::BIGINT AS n_children,
       t.n_leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM known k JOIN totals t USING (path) LEFT JOIN known up ON k.d > 0 AND up.path = k.path[1:k.d - 1]
"""
