"""Search for windows of ``m`` symbols that occur twice or more in a corpus.

Shared by the suffix-sorting operators on bytes and on words. The corpus is
far too large to sort all its suffixes, so suffixes are first put into groups
that can be sorted in one task:

* A window's signature is the smallest hash of the ``k``-grams inside it. Equal
  windows have equal signatures, so a window whose signature occurs once in the
  corpus cannot repeat and is never shipped. Neighbouring windows mostly share
  their signature: such a run travels as one context (their symbols once).
* Signatures are counted first (pre-aggregated by task). Contexts with a
  signature of up to ``GROUP_ROWS`` occurrences form one group, whose suffixes
  are sorted by the operator's own method. Groups are made by that hash, not by
  a prefix of the suffix. The windows of a more frequent signature travel
  singly, keyed by the window's 128-bit hash and dealt over as many parts as the
  count demands; what is single in its part is compared across parts afterwards.
  These are decided by the hash and reach no sort. A key that a context holds
  more than once is sent once. A run that is longer than a signature can reach
  (a rule of dashes, a repeated phrase) counts as that many occurrences, so
  groups are bounded in windows, too.
* Of equal contexts that a task meets, only the first is sent: that the windows
  of all of them repeat is known on the spot, by a 128-bit hash of the context.

No group or task holds more than ``GROUP_ROWS`` rows of one key. Lists per
document hold different spans only, so they are as long as the document, however
often its row is repeated. Nothing is sampled or dropped: signatures only rule
out windows that can't have a copy. Texts are read whole, ``SEGMENT`` windows at
a time.

Rows are identified by a hash of id and text along with the id itself, so null
and repeated ids need no care; rows equal in both are separate documents that
repeat each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_slices, staged

#: Contexts that one group holds at most, and bytes of contexts gathered before
#: their groups are sorted together.
GROUP_ROWS = 20_000
BYTES_AT_ONCE = 8 << 20
#: Windows of a text hashed at a time.
SEGMENT = 1 << 20
#: Contexts that a task remembers (it may forget them: equal ones are then sent
#: again).
REMEMBERED = 1 << 17

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODES = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


@dataclass(frozen=True)
class Alphabet:
    """How texts become symbols. ``split(text bytes)`` gives the units that
    travel, ``codes(units, which)`` a 64-bit code for each (two sets of codes),
    ``pack(units, a, b)`` the bytes of a context."""

    split: Callable
    codes: Callable
    pack: Callable


def byte_alphabet() -> Alphabet:
    return Alphabet(
        lambda raw: np.frombuffer(raw, np.uint8),
        lambda units, which: _BYTE_CODES[which][units],
        lambda units, a, b: units[a:b].tobytes(),
    )


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def gram_hashes(codes: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """A hash of every ``k`` consecutive codes, built by doubling."""
    n = len(codes) - k + 1
    out, done, h, length, power = None, 0, codes, 1, base
    while True:
        if k & length:
            if out is None:
                out = h[:n].copy()
            else:
                out = out * power + h[done : done + n]
            done += length
        if done == k:
            return mix(out)
        h = h[:-length] * power + h[length:]
        length *= 2
        power = power * power


def window_minimum(v: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of every ``w`` consecutive values, and whether it occurs twice."""
    n = len(v) - w + 1
    low = tied = None
    done, m, t, length = 0, v, np.zeros(len(v), bool), 1

    def merge(a, ta, b, tb):
        return np.minimum(a, b), (a == b) | (ta & (a < b)) | (tb & (b < a))

    while True:
        if w & length:
            part, tie = m[done : done + n], t[done : done + n]
            low, tied = (part, tie) if low is None else merge(low, tied, part, tie)
            done += length
        if done == w:
            return low, tied
        m, t = merge(m[:-length], t[:-length], m[length:], t[length:])
        length *= 2


def runs(codes: np.ndarray, m: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows with one signature: signature, first window, windows, and
    in how many places the signature lies (from 2 on: or more)."""
    w = m - k + 1
    with np.errstate(over="ignore"):
        for at in range(0, len(codes) - m + 1, SEGMENT):
            v = gram_hashes(codes[at : at + SEGMENT + m - 1], k, _BASES[0])
            low, tied = window_minimum(v, w)
            first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
            n = np.diff(np.append(first, len(low)))
            # a place lies in w windows, so n windows hold n / w of them at least
            places = np.maximum(1 + np.maximum.reduceat(tied, first), -(-n // w))
            yield low[first].view(np.int64), at + first, n, places


def window_keys(codes: np.ndarray, more: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return gram_hashes(codes, m, _BASES[0]).view(np.int64), gram_hashes(more, m, _BASES[1]).view(np.int64)


def own_copies(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Of the windows of one context, given their keys: the first of each key,
    and the stretches of windows whose key the context holds twice or more (a
    periodic stretch holds as many keys as its period is long)."""
    order = np.argsort(one, kind="stable")
    x, y = one[order], two[order]
    new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    n = np.diff(np.append(np.flatnonzero(new), len(order)))
    again = np.zeros(len(order) + 2, np.int8)
    again[1 + order] = np.repeat(n > 1, n)
    edge = np.diff(again)
    return order[new], (np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal intervals."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def row_key(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


_SPANS = "rid long, doc_id {id}, a long, z long, k1 long, k2 long, state int"


def repeated_spans(docs: DataFrame, alphabet: Callable[[], Alphabet], m: int, k: int, sort: Callable, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` (rid, doc_id, text) to (rid, spans): for each row with a repeated
    window, spans (doc_id, a, z) whose union is what its repeated windows cover.

    ``sort(contexts, windows, groups)`` gets the contexts of whole groups and
    says of every window (context by context) whether its symbols begin another
    suffix of the group as well."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def signatures(batches):
        alpha = alphabet()
        for part in row_slices(batches):
            v, r, o = [], [], []
            for rid, text in zip(part.column(0).to_numpy(), part.column(1).to_pylist()):
                codes = alpha.codes(alpha.split((text or "").encode()), 0)
                for sig, _, _, places in runs(codes, m, k):
                    v.append(sig)
                    o.append(places)
                    r.append(np.full(len(sig), rid))
            if v:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (v, r, o)], ["v", "rid", "o"])

    found = docs.select("rid", "text").mapInArrow(signatures, "v long, rid long, o long")
    # counted in a job of its own: the join below then knows its size and can
    # split a signature that very many rows hold
    frequent = staged(found.groupBy("v").agg(F.sum("o").alias("n")).where("n > 1"))
    per_row = found.select("v", "rid").distinct().join(frequent, "v").groupBy("rid").agg(F.collect_list(F.struct("v", "n")).alias("sigs"))

    def contexts(batches):
        alpha = alphabet()
        names = ["k1", "k2", "part", "rid", "doc_id", "a", "n", "content"]
        seen: dict = {}  # a context to where it was met first, None once that is reported

        def repeated(rid, doc_id, a, c):  # part -1: known to repeat
            return rid ^ a, a, -1, rid, doc_id, a, c, None

        for part in row_slices(batches, 64):
            out = [[] for _ in range(8)]
            id_values = part.column(1).to_pylist()
            for i, doc_id in enumerate(id_values):
                rid = part.column(0)[i].as_py()
                sigs = part.column(3)[i].values
                v, count = sigs.field("v").to_numpy(), sigs.field("n").to_numpy()
                order = np.argsort(v)
                v, count = v[order], count[order]
                units = alpha.split((part.column(2)[i].as_py() or "").encode())
                codes = alpha.codes(units, 0)
                for sig, first, n, _ in runs(codes, m, k):
                    at = np.minimum(np.searchsorted(v, sig), len(v) - 1)
                    hit = np.flatnonzero(v[at] == sig)
                    for s, a, c, many in zip(sig[hit].tolist(), first[hit].tolist(), n[hit].tolist(), count[at[hit]].tolist()):
                        content = alpha.pack(units, a, a + c + m - 1)
                        known = s, xxhash.xxh3_128_digest(content)
                        if known in seen:
                            rows = [repeated(*x) for x in (seen[known], (rid, doc_id, a, c)) if x]
                            seen[known] = None
                        else:
                            if len(seen) >= REMEMBERED:
                                seen.clear()
                            seen[known] = rid, doc_id, a, c
                            if many <= group_rows:
                                rows = [(s, 0, 0, rid, doc_id, a, c, content)]
                            else:
                                one, two = window_keys(codes[a : a + c + m - 1], alpha.codes(units[a : a + c + m - 1], 1), m)
                                share = (rid ^ a) % -(-many * 2 // group_rows)
                                once, (x, z) = own_copies(one, two)
                                rows = [repeated(rid, doc_id, a + i, j - i) for i, j in zip(x.tolist(), z.tolist())]
                                rows += [(one[j].item(), two[j].item(), share, rid, doc_id, a + j, 1, None) for j in once.tolist()]
                        for row in rows:
                            for column, value in zip(out, row):
                                column.append(value)
            if out[0]:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), part.column(1).type, pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    shipped = docs.join(per_row, "rid").select("rid", "doc_id", "text", "sigs")
    shipped = shipped.mapInArrow(contexts, f"k1 long, k2 long, part long, rid long, doc_id {id_type}, a long, n long, content binary")
    grouped = shipped.repartition("k1", "k2", "part").sortWithinPartitions("k1", "k2", "part")

    def search(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BYTES_AT_ONCE:
                rows = pa.Table.from_batches(held).combine_chunks()
                keys = np.stack([rows[c].to_numpy() for c in ("k1", "k2", "part")])
                cut = int(np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(0))))[-1])
                if cut:
                    yield resolved(rows.slice(0, cut))
                held, size = rows.slice(cut).to_batches(), rows.slice(cut).nbytes
                if size >= BYTES_AT_ONCE // 2:
                    size = 0  # a large group: wait for as much again
        if held:
            yield resolved(pa.Table.from_batches(held).combine_chunks())

    def resolved(rows: pa.Table) -> pa.RecordBatch:
        keys = np.stack([rows[c].to_numpy() for c in ("k1", "k2", "part")])
        new = np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(0)))
        group, start, n = np.cumsum(new) - 1, rows["a"].to_numpy(), rows["n"].to_numpy()
        light = rows["content"].is_valid().to_numpy()
        size = np.bincount(group)
        a, z, who, state = [], [], [], []
        known = np.flatnonzero(keys[2] < 0)
        a.append(start[known]), z.append(start[known] + n[known] - 1 + m), who.append(known), state.append(np.zeros(len(known), np.int64))
        # single windows: two in a part are a repeat, one may have its copy in another part
        single = np.flatnonzero(~light & (keys[2] >= 0))
        sure = size[group[single]] > 1
        head = single[sure & new[single]]
        for index, kind in ((single[sure], 0), (single[~sure], 1), (head, 2)):
            a.append(start[index]), z.append(start[index] + m), who.append(index), state.append(np.full(len(index), kind))
        at = np.flatnonzero(light)
        if len(at):
            again = sort(rows["content"].take(pa.array(at)).to_pylist(), n[at], group[at])
            context = np.repeat(np.arange(len(at)), n[at])
            place = np.arange(len(context)) - np.repeat(np.cumsum(n[at]) - n[at], n[at]) + start[at][context]
            context, place = context[again], place[again]
            # windows that follow each other become one span
            edge = np.concatenate(([True], (context[1:] != context[:-1]) | (place[1:] != place[:-1] + 1))) if len(place) else np.zeros(0, bool)
            first = np.flatnonzero(edge)
            last = np.append(first[1:], len(place)) - 1 if len(first) else first
            a.append(place[first]), z.append(place[last] + m), who.append(at[context[first]]), state.append(np.zeros(len(first), np.int64))
        who, state, a, z = (np.concatenate(x) for x in (who, state, a, z))
        took = pa.array(who)
        spread = (rows["rid"].take(took).to_numpy() ^ a) * 0x9E3779B1
        k1 = np.where(state > 0, keys[0][who], spread)
        k2 = np.where(state > 0, keys[1][who], a)
        return pa.Table.from_arrays(
            [rows["rid"].take(took), rows["doc_id"].take(took), pa.array(a), pa.array(z), pa.array(k1), pa.array(k2), pa.array(state.astype(np.int32))],
            ["rid", "doc_id", "a", "z", "k1", "k2", "state"],
        ).combine_chunks().to_batches()[0] if len(who) else pa.RecordBatch.from_pylist([], schema=_schema(rows))

    def _schema(rows):
        return pa.schema([("rid", pa.int64()), ("doc_id", rows.schema.field("doc_id").type), ("a", pa.int64()), ("z", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("state", pa.int32())])

    spans = grouped.mapInArrow(search, _SPANS.format(id=id_type))
    # a window that was single in its part repeats if another part holds it too
    across = F.sum(F.when(F.col("state") > 0, 1).otherwise(0)).over(Window.partitionBy("k1", "k2"))
    sure = spans.withColumn("across", across).where("state = 0 or (state = 1 and across > 1)")
    # as a set: rows equal in id and text report the same spans, merged before the shuffle
    return sure.groupBy("rid").agg(F.collect_set(F.struct("doc_id", "a", "z")).alias("spans"))


def with_spans(docs: DataFrame, key: str, text: str, alphabet, m: int, k: int, sort, finish, schema: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``finish(text, a, z)`` of every row, given the maximal spans that its
    repeated windows cover; ``schema`` names what it returns after ``doc_id``.
    The texts are dealt by row key once, for contexts and for results."""
    rows = docs.select(row_key(key, text).alias("rid"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    spans = repeated_spans(rows, alphabet, m, k, sort, group_rows)
    joined = rows.join(spans, "rid", "left").select("rid", "doc_id", "text", "spans")
    names = [f.split()[0] for f in schema.split(",")]

    def apply(batches):
        for part in row_slices(batches, 64):
            out = []
            ids = part.column(1).to_pylist()
            for i, (doc_id, text_) in enumerate(zip(ids, part.column(2).to_pylist())):
                a = z = np.zeros(0, np.int64)
                cell = part.column(3)[i]
                if cell.is_valid:
                    own = [j for j, x in enumerate(cell.values.field("doc_id").to_pylist()) if x == doc_id]
                    a, z = merged(*(cell.values.field(c).to_numpy()[own] for c in ("a", "z")))
                out.append(finish((text_ or "").encode(), a, z))
            yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(c) for c in zip(*out))], ["doc_id", *names])

    return joined.mapInArrow(apply, f"doc_id {docs.schema[key].dataType.simpleString()}, {schema}")
