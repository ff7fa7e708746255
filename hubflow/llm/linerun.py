"""Removal of repeated line runs: a suffix array over sequences of line ids.

Lines with a word are numbered by their 64-bit hash; a document is a sequence of
line ids. Suffixes are ranked by distributed prefix doubling: the rank of the
first ``h`` lines and the rank ``h`` lines further on make the rank of the first
``2h``, named in sorted order. After each step suffixes whose prefix occurs once
drop out; after the last, suffixes of one rank are an interval of the suffix
array whose common prefix has ``min_lines`` lines. The first of an interval (by
id, then line) stays, the runs that the others begin are deleted; overlapping
runs merge into maximal ones. Blank lines belong to no run and stay.

All of it is DataFrame operations. Ranks are written to the shared folder once
made, so a recomputed task can't name them differently; a frequent line or run
is pre-aggregated when counted and split when joined.

Defined cases: a null text has no lines and stays empty; an empty text has one
blank line; documents with fewer lines lose nothing; null ids come after all
others; rows equal in id and text count as one document, so they don't delete
each other's lines; an empty table gives no rows. Other columns are passed on by
``drop_repeated_runs`` and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, staged, table

MIN_LINES = 2


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _written(lines: Column) -> Column:
    """Place and id of the lines that have a word."""
    every = F.transform(lines, lambda x, i: F.struct(i.alias("place"), F.xxhash64(x).alias("id"), x.rlike(r"[^\x20\x09-\x0D]").alias("word")))
    return F.filter(every, lambda x: x["word"])


def suffix_ranks(docs: DataFrame, depth: int) -> DataFrame:
    """``docs`` (rid, doc_id, text) to (rid, doc_id, i, rank): the suffixes whose
    first ``depth`` lines occur twice or more, ranks in suffix order."""
    cells = F.posexplode(F.transform(_written(_lines(F.col("text"))), lambda x: x["id"]))
    now = docs.select("rid", "doc_id", cells.alias("i", "rank")).distinct()
    pair = ["rank", "next"]
    h = 0
    while h < depth:
        step = min(h, depth - h) if h else 1
        if h:  # a line that was dropped breaks the runs through its place
            ahead = Window.partitionBy("rid", "doc_id").orderBy("i").rangeBetween(step, step)
            now = now.withColumn("next", F.max("rank").over(ahead)).where("next is not null")
        else:
            now = now.withColumn("next", F.lit(0).cast("long"))
        now = staged(now)
        names = now.groupBy(*pair).count().where("count > 1").orderBy(*pair).select(*pair, F.monotonically_increasing_id().alias("name"))
        now = now.join(staged(names), pair).select("rid", "doc_id", "i", F.col("name").alias("rank"))
        h += step
    return now


def later_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` (rid, doc_id, text) to (rid, doc_id, starts): where runs of
    ``min_lines`` lines begin that also begin at an earlier place."""
    ranked = staged(suffix_ranks(docs, min_lines))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("rid"), F.col("i"))
    first = staged(ranked.groupBy("rank").agg(F.min(place).alias("first")))
    later = ranked.join(first, "rank").where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("rid", "doc_id").agg(F.collect_list("i").alias("starts"))


def without_runs(text: Column, starts: Column, min_lines: int) -> Column:
    """A struct: lines with a word, lines and runs deleted, and the text kept."""
    begun = F.coalesce(starts, F.array().cast("array<int>"))
    gone = F.array_distinct(F.flatten(F.transform(begun, lambda s: F.sequence(s, s + min_lines - 1))))
    parts = F.struct(_lines(text).alias("lines"), gone.alias("gone"))

    def result(x):
        def kept(w):
            places = F.transform(x["gone"], lambda g: F.get(w, g)["place"])
            stay = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), places)
            return F.struct(
                F.size(w).cast("long").alias("n_lines"),
                F.size(x["gone"]).cast("long").alias("n_removed"),
                F.size(F.array_except(x["gone"], F.transform(x["gone"], lambda g: g + 1))).cast("long").alias("n_runs"),
                F.array_join(F.transform(stay, lambda p: F.get(x["lines"], p)), "\n").alias("kept"),
            )

        return let(_written(x["lines"]), kept)

    return let(parts, result)


def drop_repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """``row`` (the input row as a struct) and ``out`` (see ``without_runs``)."""
    rows = docs.select(
        F.xxhash64(F.col(key), F.col(text)).alias("rid"), F.col(key).alias("doc_id"), F.col(text).alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    runs = later_runs(rows.select("rid", "doc_id", "text"), min_lines).withColumnsRenamed({"rid": "r_rid", "doc_id": "r_id"})
    same = (rows["rid"] == runs["r_rid"]) & rows["doc_id"].eqNullSafe(runs["r_id"])
    return rows.join(runs, same, "left").select("row", without_runs(F.col("text"), F.col("starts"), min_lines).alias("out"))


def op7_line_runs(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without later copies of line runs."""
    got = drop_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("row.doc_id", "out.n_lines", "out.n_removed", "out.n_runs", F.sha2("out.kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents
), numbered AS (
  SELECT doc_id, line, place, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i
  FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), pairs AS (
  SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM numbered
), later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, i) AS copy FROM pairs WHERE next IS NOT NULL)
  WHERE copy > 1
), gone AS (
  SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i FROM later UNION ALL SELECT doc_id, i + 1 FROM later)
), marked AS (
  SELECT s.doc_id, s.line, s.place, n.i IS NOT NULL AS has_word, g.i IS NOT NULL AS removed,
         g.i IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gone b WHERE b.doc_id = g.doc_id AND b.i = g.i - 1) AS opens
  FROM split s LEFT JOIN numbered n ON n.doc_id = s.doc_id AND n.place = s.place
               LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.i = n.i
)
SELECT d.doc_id, count(*) FILTER (WHERE has_word) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed,
       count(*) FILTER (WHERE opens) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT removed), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id
GROUP BY d.doc_id
"""
