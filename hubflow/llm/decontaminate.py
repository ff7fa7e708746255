"""Benchmark decontamination: CGK embedding, bit-sampling LSH, edit verification.

A document leaks an item if a stretch of its words is within ``1 - similarity``
of the item's length in word edits. Words are runs of letters and digits,
lower-cased.

* An item of which ``e`` words may be edited is cut into ``e // 2 + 1`` parts
  of nearly equal length (``cut``). Wherever the edits lie, spread or in one
  block, a part is left with one edit at most, so the search is for parts with
  up to ``PART_EDITS`` edits, and items of every length are found alike.
* A window is embedded by a CGK random walk: at each step the current symbol is
  output, and a random function of step and symbol says whether the walk moves
  on. Few edits between two windows make few Hamming differences between their
  embeddings, as the walks fall into step again.
* A hash table samples ``SAMPLES`` of the output positions; windows and parts
  that agree on them are candidates. ``tables_for`` says how many tables reach
  the target recall; ``tests/llm`` measures it for an edit at each word of a
  part of each length.
* Candidates are verified by exact edit distance: the part against the words
  around the window, and where it is near, the whole item against the words of
  the document around it, so the result has no false pair.
* A part that several items share (a question template) is searched once. An
  item that shares it is tried only where the document holds one of its rarest
  word pairs around the part. An edit destroys two pairs at most, so of one pair
  more than twice the edits one is left, and no item is lost.

Parts are grouped by length into classes (``CLASS_RATIO``); windows start at
every word of every document, once per class. Before they are embedded, windows
are dropped that can't be within the edits allowed: an edit destroys at most two
of a part's word pairs and three of its triples, so a window must keep a number
of pairs and triples that occur in parts (of five words: a triple, or the first
and the last two words). After that, windows are dropped whose
signature no part has in any table. Both tests look at bitmaps of fixed size
(``BITMAP_BITS``), whatever the number of items; these let some windows through
to the join and never lose one.

Items with fewer than ``MIN_ITEM_WORDS`` words allow no edit: they are found by
equality of word sequences, without an embedding. ``drop_leaks`` keeps documents
that hold only such items.

Defined cases: null or empty texts and items match nothing; very long texts are
searched whole, a few arrays of their length at a time; equal items are all reported; null ids are reported as null; rows equal in id and
text are reported once; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_slices, staged, table

SIMILARITY = 0.8
MIN_ITEM_WORDS = 5
CLASS_RATIO = 1.3
SAMPLES = 3
#: Edits that the part of an item with the fewest of them has at most.
PART_EDITS = 1
#: Chance that a sampled position agrees for a window with as many edits, and
#: the recall that the tables together must reach there.
AGREE = 0.55
TARGET_RECALL = 0.98
BITMAP_BITS = 1 << 22
SEED = 20240610
WINDOWS_AT_ONCE = 4096
WORDS_AT_ONCE = 1 << 18
#: Words whose codes a task remembers, and the longest of them in bytes.
CODES_KEPT = 1 << 18
CODED_BYTES = 64

_WORD = re.compile(r"[^\W_]+")
_ODD = re.compile(r"[^\x00-\x7f\w]")  # beyond ASCII, neither letter nor digit
_ASCII = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_U = np.uint64


def tables_for(recall: float = TARGET_RECALL, agree: float = AGREE, samples: int = SAMPLES) -> int:
    """Tables that together miss a window at the bound with 1 - recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**samples))


TABLES = tables_for()


def tokens(text: str | None) -> list[bytes]:
    """Runs of letters and digits, lower-cased, in UTF-8."""
    low = (text or "").lower()
    if not low.isascii() and _ODD.search(low):
        return [w.encode() for w in _WORD.findall(low)]
    return low.encode().translate(_ASCII).split()


def codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class WordCodes(dict):
    """Codes of the words met last, as most words of a text were met before."""

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(word)
        if len(word) <= CODED_BYTES:
            if len(self) >= CODES_KEPT:
                self.clear()
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _bits(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9) >> _U(64 - BITMAP_BITS.bit_length() + 1)).astype(np.int64)


def gram_bits(code: np.ndarray, n: int) -> np.ndarray:
    """The bits of every ``n`` consecutive words."""
    m = max(0, len(code) - n + 1)
    with np.errstate(over="ignore"):
        h = np.full(m, _U(n))
        for i in range(n):
            h = h * _U(0x9E3779B97F4A7C15) + code[i : i + m]
    return _bits(h)


def bits_at(code: np.ndarray, at: np.ndarray, offsets: tuple[int, ...], seed: int) -> np.ndarray:
    """The bits of the words at ``at + offsets``."""
    with np.errstate(over="ignore"):
        h = np.full(len(at), _U(seed))
        for o in offsets:
            h = h * _U(0x9E3779B97F4A7C15) + code[at + o]
    return _bits(h)


def part_bits(part: np.ndarray, c: int) -> np.ndarray:
    """What the window filter knows of a part: its pairs, and by class its
    triples and, of five words, the first two with the last two."""
    triples = bits_at(part, np.arange(max(0, len(part) - 2)), (0, 1, 2), 100 * c + 3)
    ends = bits_at(part, np.zeros(int(len(part) == 5), np.int64), (0, 1, 3, 4), 100 * c + 4)
    return np.unique(np.concatenate((gram_bits(part, 2), triples, ends)))


def near_starts(line: np.ndarray, pair: np.ndarray, known: np.ndarray, c: int, shape: tuple) -> np.ndarray:
    """Where windows of a class start that may hold a part with one edit at
    most. ``pair``: where the line has a known pair; triples and split pairs
    are looked up only there."""
    _, span, keep, _ = shape

    def upto(hits, size):
        sums = np.concatenate(([0], np.cumsum(hits, dtype=np.int32)))
        end = np.minimum(np.arange(len(line)) + span - size + 1, len(hits))
        return sums[end] - sums[np.minimum(np.arange(len(line)), len(hits))]

    enough = upto(pair, 2) >= keep[2]
    if keep[3] > 0 or min(class_lengths(c)) >= 5:
        inner = np.zeros(max(0, len(line) - 2), bool)
        at = np.flatnonzero(pair[:-1] & pair[1:])
        inner[at] = known[bits_at(line, at, (0, 1, 2), 100 * c + 3)]
        if keep[3] <= 0:
            # six words or more keep a triple; five keep one, or both ends
            # where the word between them is lost or replaced
            for gap in (2, 3):
                at = np.flatnonzero(pair[:-gap] & pair[gap:])
                inner[at] |= known[bits_at(line, at, (0, 1, gap, gap + 1), 100 * c + 4)]
        enough &= upto(inner, 3) >= max(keep[3], 1)
    return np.flatnonzero(enough)


def pair_hash(codes_: Column, i: Column) -> Column:
    """The hash of the ``i``-th word (from 1) and the next one."""
    return F.xxhash64(F.element_at(codes_, i), F.element_at(codes_, i + 1))


def signature_bits(sigs: np.ndarray) -> np.ndarray:
    """The bits of (window, table) signatures."""
    with np.errstate(over="ignore"):
        return _bits(sigs.view(np.uint64) + np.arange(1, sigs.shape[1] + 1, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F))


def bitmap(bits: DataFrame) -> np.ndarray:
    """A bitmap with the bits of ``bits`` (bit) set, packed: at most
    ``BITMAP_BITS`` distinct rows reach the driver."""
    out = np.zeros(BITMAP_BITS, bool)
    out[bits.distinct().toArrow()["bit"].to_numpy()] = True
    return np.packbits(out)


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    return math.floor(n * (1 - similarity) + 1e-9)


def length_class(n: int) -> int:
    return math.floor(math.log(n) / math.log(CLASS_RATIO) + 1e-9)


def class_lengths(c: int) -> list[int]:
    low = math.ceil(CLASS_RATIO**c - 1e-6)
    return [n for n in range(max(low - 1, 1), math.ceil(CLASS_RATIO ** (c + 1)) + 1) if length_class(n) == c]


def cut(n: int, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """The parts (from, to) of an item of ``n`` words: so many that the edits
    allowed can't put more than ``PART_EDITS`` into each."""
    parts = edits_allowed(n, similarity) // (PART_EDITS + 1) + 1
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)]


def class_shape(c: int, similarity: float = SIMILARITY, edits: int | None = None) -> tuple[int, int, dict[int, int], int]:
    """Of a class: walk steps, words that a window may span, pairs and triples
    it must keep, and edits allowed at most (``edits`` where it is given)."""
    allowed = {n: edits_allowed(n, similarity) if edits is None else edits for n in class_lengths(c)}
    lengths = list(allowed)
    spans = max(n + e for n, e in allowed.items())
    keep = {g: min(n - g + 1 - g * e for n, e in allowed.items()) for g in (2, 3)}
    return math.ceil(1.6 * lengths[0]), spans, keep, allowed[lengths[-1]]


def signatures(windows: np.ndarray, c: int, tables: int = TABLES, samples: int = SAMPLES, seed: int = SEED) -> np.ndarray:
    """``windows`` (window, symbol; 0 beyond the end) to (window, table) hashes
    of sampled positions of their CGK embeddings."""
    steps = class_shape(c)[0]
    rng = np.random.Generator(np.random.PCG64([seed, c]))
    walk = rng.integers(0, 1 << 63, (steps, tables), dtype=np.uint64) * _U(2) + _U(1)
    sampled = np.zeros((steps, tables), bool)
    for t in range(tables):
        sampled[rng.choice(steps, min(samples, steps), replace=False), t] = True
    wide = np.concatenate((windows, np.zeros((len(windows), max(0, steps - windows.shape[1]) + 1), np.uint64)), axis=1)
    row, at = np.arange(len(wide))[:, None], np.zeros((len(wide), tables), np.int64)
    out = np.full((len(wide), tables), _U(c + 1))
    with np.errstate(over="ignore"):
        for j in range(steps):
            symbol = wide[row, at]
            t = np.flatnonzero(sampled[j])
            if len(t):
                out[:, t] = (out[:, t] ^ symbol[:, t]) * _U(0x9E3779B97F4A7C15) ^ (out[:, t] >> _U(23))
            at += ((symbol * walk[j]) >> _U(63)).astype(np.int64)
    return out.view(np.int64)


def edit_distances(items: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row, fewest word edits that turn the item into a stretch of
    ``around``, and where the first such stretch ends."""
    idx = np.arange(around.shape[1] + 1)
    row = np.zeros((len(items), len(idx)), np.int64)
    for i in range(items.shape[1]):
        now = np.empty_like(row)
        now[:, 0] = i + 1
        now[:, 1:] = np.minimum(row[:, :-1] + (around != items[:, i : i + 1]), row[:, 1:] + 1)
        row = np.minimum.accumulate(now - idx, axis=1) + idx
    end = row.argmin(1)
    return row[np.arange(len(row)), end], end


def edit_distance(item: np.ndarray, around: np.ndarray) -> tuple[int, int]:
    """``edit_distances`` of one item."""
    edits, end = edit_distances(item[None], around[None])
    return int(edits[0]), int(end[0])


def _lists(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).ravel()))


def _matrix(col: pa.ListArray, at: np.ndarray) -> np.ndarray:
    """The lists ``at`` of a column, which are of one length, as rows."""
    lengths = col.value_lengths().to_numpy()
    start = np.cumsum(lengths) - lengths
    return col.flatten().to_numpy().view(np.uint64)[start[at][:, None] + np.arange(lengths[at[0]])]


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, edits, item_words, word_at``: each document and the
    items it leaks, with the fewest edits and where that stretch ends."""
    spark = docs.sparkSession
    id_type, item_type = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    given = items.select(F.xxhash64(F.col(item), F.col(item_text)).alias("iid"), F.col(item).alias("item_id"), F.col(item_text).alias("text"))
    rows = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("rid"), F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def prepare(batches):
        for part in row_slices(batches):
            out = []  # row, from, words, words of the item
            for i, w in enumerate(map(tokens, part.column(2).to_pylist())):
                if w:
                    code = codes(w)
                    out += [(i, a, code[a:b], code) for a, b in (cut(len(w), similarity) if len(w) >= MIN_ITEM_WORDS else [(0, len(w))])]
            took = pa.array([r[0] for r in out], pa.int64())
            c, n = [length_class(len(r[2])) for r in out], [len(r[3]) for r in out]
            # how far an item may reach beyond its place if this part is found
            slack = [edits_allowed(y, similarity) + class_shape(x, similarity, PART_EDITS)[1] - len(r[2]) + 3 * PART_EDITS for x, y, r in zip(c, n, out)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(took),
                    part.column(1).take(took),
                    pa.array(c, pa.int32()),
                    pa.array([r[1] for r in out], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(slack, pa.int64()),
                    pa.array(np.array([xxhash.xxh64_intdigest(r[2].tobytes()) for r in out], np.uint64).view(np.int64)),
                    pa.array([r[2].view(np.int64).tolist() for r in out], pa.list_(pa.int64())),
                    pa.array([None if r[1] else r[3].view(np.int64).tolist() for r in out], pa.list_(pa.int64())),
                ],
                ["iid", "item_id", "c", "at", "n", "slack", "pid", "words", "item"],
            )

    every = staged(given.mapInArrow(prepare, f"iid long, item_id {item_type}, c int, at long, n long, slack long, pid long, words array<long>, item array<long>").distinct())
    prepared = every.where(F.col("n") >= MIN_ITEM_WORDS)
    classes = sorted(r["c"] for r in prepared.select("c").distinct().collect())  # few: lengths grow by a ratio
    shapes = {c: class_shape(c, similarity, PART_EDITS) for c in classes}

    def embed_parts(batches):
        for batch in batches:
            c, words = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for one in np.unique(c):
                at = np.flatnonzero(c == one)
                wide = np.zeros((len(at), max(len(words[i]) for i in at)), np.int64)
                for r, i in enumerate(at):
                    wide[r, : len(words[i])] = words[i]
                sig = signatures(wide.view(np.uint64), int(one))
                grams = [part_bits(np.array(words[i], np.int64).view(np.uint64), int(one)).tolist() for i in at]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).take(pa.array(at)) for k in range(2)),
                        pa.array(sig.tolist(), pa.list_(pa.int64())),
                        pa.array(signature_bits(sig).tolist(), pa.list_(pa.int64())),
                        pa.array(grams, pa.list_(pa.int64())),
                    ],
                    ["c", "pid", "sigs", "bits", "grams"],
                )

    # a part that many items share is searched once
    texts_of_parts = prepared.select("c", "pid", "words").distinct()
    of_parts = staged(texts_of_parts.mapInArrow(embed_parts, "c int, pid long, sigs array<long>, bits array<long>, grams array<long>"))
    grams = spark.sparkContext.broadcast(bitmap(of_parts.select(F.explode("grams").alias("bit"))))
    signed = spark.sparkContext.broadcast(bitmap(of_parts.select(F.explode("bits").alias("bit"))))

    def windows(batches):
        known, known_signature = (np.unpackbits(x.value).astype(bool) for x in (grams, signed))
        gap = max((span + 2 * edits for _, span, _, edits in shapes.values()), default=0)
        seen = WordCodes()

        def search(rids, ids, texts):
            # all texts one after the other, with a gap that no window bridges
            pad = np.zeros(gap, np.uint64)
            line = np.concatenate([pad, *(x for t in texts for x in (t, pad))])
            lengths = np.array([len(t) for t in texts])
            first = gap + np.concatenate(([0], np.cumsum(lengths + gap)[:-1]))
            pair = known[gram_bits(line, 2)]
            for c in classes:
                _, span, _, edits = shapes[c]
                start = near_starts(line, pair, known, c, shapes[c])
                own = np.searchsorted(first, start, "right") - 1
                start, own = (x[(own >= 0) & (start < first[own] + lengths[own])] for x in (start, own))
                for at in range(0, len(start), WINDOWS_AT_ONCE):
                    s, o = start[at : at + WINDOWS_AT_ONCE], own[at : at + WINDOWS_AT_ONCE]
                    sig = signatures(line[s[:, None] + np.arange(span)], c)
                    near = np.flatnonzero(known_signature[signature_bits(sig)].any(1))
                    s, o, sig = s[near], o[near], sig[near]
                    if not len(s):
                        continue
                    around = line[s[:, None] + np.arange(-edits, span + edits)].view(np.int64)
                    took = pa.array(o)
                    yield pa.RecordBatch.from_arrays(
                        [rids.take(took), ids.take(took), pa.array(np.full(len(s), c, np.int32)), pa.array(s - first[o]), _lists(around), _lists(sig)],
                        ["rid", "doc_id", "c", "start", "around", "sigs"],
                    )

        for part in row_slices(batches):
            texts, at = [], 0
            for i, text_ in enumerate(part.column(2).to_pylist()):
                texts.append(seen.of(tokens(text_)))
                if i + 1 == part.num_rows or sum(map(len, texts)) >= WORDS_AT_ONCE:
                    yield from search(part.column(0).slice(at, len(texts)), part.column(1).slice(at, len(texts)), texts)
                    texts, at = [], i + 1

    found = staged(rows.mapInArrow(windows, f"rid long, doc_id {id_type}, c int, start long, around array<long>, sigs array<long>"))
    tables = of_parts.select("c", "pid", F.posexplode("sigs").alias("t", "sig")).distinct()
    hits = found.select("rid", "doc_id", "c", "start", F.posexplode("sigs").alias("t", "sig")).join(tables, ["c", "t", "sig"])
    # rid and iid name a row but for collisions, which the ids tell apart
    candidates = staged(hits.select("rid", "doc_id", "c", "start", "pid").distinct())
    around = found.select("rid", F.col("doc_id").alias("found_id"), "c", "start", "around")
    checked = (
        candidates.join(around, ["rid", "c", "start"])
        .where(F.col("doc_id").eqNullSafe(F.col("found_id")))
        .join(texts_of_parts, ["c", "pid"])
        .select("rid", "doc_id", "pid", "start", "words", "around")
    )

    def verify_parts(batches):
        for batch in batches:
            start, words, around_ = batch.column(3).to_numpy(), batch.column(4), batch.column(5)
            size, reach = words.value_lengths().to_numpy(), around_.value_lengths().to_numpy()
            least, place = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
            for w, m in set(zip(reach.tolist(), size.tolist())):
                some = np.flatnonzero((reach == w) & (size == m))
                least[some], end = edit_distances(_matrix(words, some), _matrix(around_, some))
                place[some] = start[some] - PART_EDITS + end - m
            took = pa.array(np.flatnonzero(least <= PART_EDITS))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(took) for k in range(3)), pa.array(place).take(took)], ["rid", "doc_id", "pid", "place"])

    parts_found = staged(checked.mapInArrow(verify_parts, f"rid long, doc_id {id_type}, pid long, place long").distinct())

    def encode(batches):
        for part in row_slices(batches):
            words = [codes(tokens(x)).view(np.int64) for x in part.column(2).to_pylist()]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(w) for w in words]))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(words) if words else [], pa.int64()))],
                ["t_rid", "t_id", "codes"],
            )

    def codes_of(some: DataFrame) -> DataFrame:
        """``t_rid, t_id, codes`` of the documents in ``some`` (rid, doc_id)."""
        hit = some.select(F.col("rid").alias("n_rid"), F.col("doc_id").alias("n_id")).distinct()
        named = (rows["rid"] == hit["n_rid"]) & rows["doc_id"].eqNullSafe(hit["n_id"])
        return rows.join(hit, named, "left_semi").mapInArrow(encode, f"t_rid long, t_id {id_type}, codes array<long>")

    def with_stretch(some: DataFrame, low: Column, high: Column) -> DataFrame:
        """``some`` with ``first`` and ``around``: the words from low to high."""
        first = F.greatest(low, F.lit(0))
        joined = some.join(codes_of(some), (F.col("rid") == F.col("t_rid")) & F.col("doc_id").eqNullSafe(F.col("t_id"))).withColumn("first", first)
        return joined.withColumn("around", F.slice("codes", (F.col("first") + 1).cast("int"), F.greatest(high - F.col("first"), F.lit(0)).cast("int"))).drop("t_rid", "t_id", "codes")

    # The items of a part. Where several share it, a document must also hold,
    # near the part, one of the item's rarest pairs: edits destroy at most two
    # pairs each, so of one more than that at least one is left.
    shared = prepared.groupBy("pid").agg((F.count_distinct("iid", F.coalesce(F.col("item_id").cast("string"), F.lit(""))) > 1).alias("shared"))
    ways = staged(prepared.join(shared, "pid").select("iid", "item_id", "pid", "at", "n", "slack", "shared"))
    edits = F.floor(F.col("n") * (1 - similarity) + 1e-9)
    pairs = prepared.where("at = 0").select(
        "iid", "item_id", (2 * edits + 1).alias("need"), F.posexplode(F.transform(F.sequence(F.lit(1), (F.col("n") - 1).cast("int")), lambda i: pair_hash(F.col("item"), i))).alias("p", "pair")
    )
    often = pairs.groupBy("pair").agg(F.count("*").alias("often"))
    rarest = Window.partitionBy("iid", "item_id").orderBy("often", "p")
    rare = pairs.join(often, "pair").withColumn("r", F.row_number().over(rarest)).where("r <= need").select("iid", F.col("item_id").alias("r_id"), "pair").distinct()
    testable = F.col("shared") & (2 * edits + 1 <= F.col("n") - 1)
    keyed = staged(
        ways.where(testable).join(rare, "iid").where(F.col("item_id").eqNullSafe(F.col("r_id"))).select("iid", "item_id", "pid", "at", "n", "slack", "pair")
    )
    plain = ways.where(~testable)
    reach = keyed.groupBy("pid").agg(F.max(F.col("at") + F.col("slack")).alias("back"), F.max(F.col("n") - F.col("at") + F.col("slack")).alias("ahead"))
    marked = with_stretch(staged(parts_found.join(reach, "pid")), F.col("place") - F.col("back"), F.col("place") + F.col("ahead"))
    around_pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("around") - 1), lambda i: pair_hash(F.col("around"), i)))
    held = marked.where(F.size("around") > 1).select("rid", "doc_id", "pid", "place", F.explode(around_pairs).alias("pair"))
    located = F.col("place") - F.col("at")
    wanted = ["rid", "doc_id", "iid", "item_id", located.alias("place"), (located - F.col("slack")).alias("low"), (located + F.col("n") + F.col("slack")).alias("high")]
    near = staged(parts_found.join(plain, "pid").select(*wanted).unionByName(held.join(keyed, ["pid", "pair"]).select(*wanted)).distinct())
    whole = prepared.where("at = 0").select(F.col("iid").alias("w_iid"), F.col("item_id").alias("w_id"), F.col("item").alias("words")).distinct()
    paired = (
        with_stretch(near, F.col("low"), F.col("high"))
        .join(whole, (F.col("iid") == F.col("w_iid")) & F.col("item_id").eqNullSafe(F.col("w_id")))
        .select("rid", "doc_id", "iid", "item_id", "place", "first", "words", "around")
        # the places of a pair follow each other, so one without edits settles it
        .repartition("rid", "iid")
        .sortWithinPartitions("rid", "iid", "item_id", "place")
    )

    def verify(batches):
        exact = None  # the last pair that was found without any edit
        for batch in batches:
            out = []
            rids, iids, place, first_ = (batch.column(k).to_pylist() for k in (0, 2, 4, 5))
            items_, words_, around_ = batch.column(3), batch.column(6), batch.column(7)
            for i, rid in enumerate(rids):
                pair = (rid, iids[i], batch.column(1)[i].as_py(), items_[i].as_py())
                if pair == exact:
                    continue
                own = words_[i].values.to_numpy().view(np.uint64)
                text_ = around_[i].values.to_numpy().view(np.uint64)
                n, at = len(own), place[i] - first_[i]
                if at >= 0 and np.array_equal(text_[at : at + n], own):
                    edits, end = 0, at + n
                else:
                    edits, end = edit_distance(own, text_)
                if edits <= edits_allowed(n, similarity):
                    out.append((i, edits, n, first_[i] + end))
                    exact = exact if edits else pair
            took = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(took), batch.column(1).take(took), items_.take(took), *(pa.array([o[k] for o in out], pa.int64()) for k in (1, 2, 3))],
                ["rid", "doc_id", "item_id", "edits", "item_words", "word_at"],
            )

    verified = paired.mapInArrow(verify, f"rid long, doc_id {id_type}, item_id {item_type}, edits long, item_words long, word_at long")
    best = F.min(F.struct("edits", "word_at", "item_words")).alias("b")
    leaked = verified.groupBy("rid", "doc_id", "item_id").agg(best).select("rid", "doc_id", "item_id", "b.edits", "b.item_words", "b.word_at")
    short = every.where(F.col("n") < MIN_ITEM_WORDS)
    sizes = [r["n"] for r in short.select("n").distinct().collect()]  # below MIN_ITEM_WORDS
    if not sizes:
        return leaked

    def bit_of(batches):
        for batch in batches:
            grams_ = [gram_bits(np.array(x, np.int64).view(np.uint64), len(x))[0] for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(grams_, pa.int64())], ["bit"])

    of_short = spark.sparkContext.broadcast(bitmap(short.select("item").mapInArrow(bit_of, "bit long")))

    def equal(batches):
        known, seen = np.unpackbits(of_short.value).astype(bool), WordCodes()
        for part in row_slices(batches):
            took, grams_, ends = [], [], []
            for i, text_ in enumerate(part.column(2).to_pylist()):
                code = seen.of(tokens(text_))
                for n in sizes:
                    at = np.flatnonzero(known[gram_bits(code, n)])
                    once = {}
                    for a in at.tolist():
                        once.setdefault(code[a : a + n].tobytes(), a)
                    took += [i] * len(once)
                    grams_ += [code[a : a + n].view(np.int64).tolist() for a in once.values()]
                    ends += [a + n for a in once.values()]
            rows_ = pa.array(took, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(rows_), part.column(1).take(rows_), pa.array(grams_, pa.list_(pa.int64())), pa.array(ends, pa.int64())], ["rid", "doc_id", "gram", "word_at"]
            )

    equal_to = rows.mapInArrow(equal, f"rid long, doc_id {id_type}, gram array<long>, word_at long").distinct()
    same = equal_to.join(short.select("item_id", "n", F.col("item").alias("gram")).distinct(), "gram")
    return leaked.unionByName(same.select("rid", "doc_id", "item_id", F.lit(0).cast("long").alias("edits"), F.col("n").alias("item_words"), "word_at"))


def drop_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, min_words: int = MIN_ITEM_WORDS) -> DataFrame:
    """The rows of ``docs`` that leak no item of ``min_words`` words or more:
    shorter ones, such as "yes", occur in clean documents too."""
    found = leaks(docs, items, key, text, item, item_text, similarity).where(F.col("item_words") >= min_words)
    hit = staged(found.select(F.col("rid").alias("l_rid"), F.col("doc_id").alias("l_id")).distinct())
    rows = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("rid"), F.col(key).alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(hit, (rows["rid"] == hit["l_rid"]) & rows["doc_id"].eqNullSafe(hit["l_id"]), "left_anti").select("row.*")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Documents that leak benchmark items, with the items."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid")
