"""Removal of repeated byte strings by sorting suffixes, shallow then deep.

A byte is removed if a string of ``min_bytes`` bytes that covers it also starts
anywhere else in the corpus. Suffixes are sorted within groups of one signature
(see ``repeats``), eight bytes at a time and all groups of a task at once; single
suffixes drop out as soon as they are told apart. Beyond a shallow depth the
bytes that all members of a group share are skipped unsorted, as a blind trie
skips them. Neighbours with a common prefix of ``min_bytes`` are the repeats.

Defined cases: a null text is empty; matches never cross documents and overlaps
count; texts shorter than ``min_bytes`` lose nothing; long texts are read whole;
two equal rows repeat each other; an empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .repeats import GROUP_ROWS, byte_alphabet, with_spans

MIN_BYTES = 200
GRAM = 64
#: Bytes that are sorted before shared bytes are skipped.
SHALLOW = 16


def sort_suffixes(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``data`` from ``starts``, each sorted within its group by the
    first ``depth`` bytes: the order, and for each place the common prefix with
    the one before (0 at the first of a group, at most ``depth``). ``group`` is
    ascending; every suffix has ``depth`` bytes."""
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    eight = np.ndarray((len(data) + 8,), ">u8", padded.data, 0, (1,))
    order, lcp = np.arange(len(starts)), np.full(len(starts), depth, np.int64)
    new = np.concatenate(([True], group[1:] != group[:-1])) if len(starts) else np.zeros(0, bool)
    lcp[new] = 0
    active = np.arange(len(starts))  # places in groups of two or more
    for d in range(0, depth, 8):
        # single suffixes are in their final place
        alone = new & np.append(new[1:], True)
        active, new = active[~alone], new[~alone]
        if not len(active):
            break
        width = min(8, depth - d)
        key = eight[starts[order[active]] + d].astype(np.uint64) >> np.uint64(8 * (8 - width))
        segment = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        if d < SHALLOW:
            todo = np.arange(len(active))
        else:  # bytes that all members share are skipped unsorted
            branch = np.logical_or.reduceat(key != key[heads][segment], heads)
            todo = np.flatnonzero(branch[segment])
            if not len(todo):
                continue
        by = todo[np.lexsort((key[todo], segment[todo]))]
        order[active[todo]] = order[active[by]]
        key[todo] = key[by]
        split = todo[1:][(segment[todo[1:]] == segment[todo[:-1]]) & (key[todo[1:]] != key[todo[:-1]])]
        differ = key[split] ^ key[split - 1]
        same = np.zeros(len(split), np.int64)
        for b in range(1, width):
            same += differ < np.uint64(1) << np.uint64(8 * (width - b))
        lcp[active[split]] = d + same
        new[split] = True
    return order, lcp


def repeated_windows(contexts: list[bytes], windows: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Whether each window of each context begins another suffix of its group."""
    # equal contexts of a group are sorted once
    seen: dict = {}
    same = np.array([seen.setdefault((g, c), i) for i, (g, c) in enumerate(zip(group.tolist(), contexts))])
    first = np.flatnonzero(same == np.arange(len(same)))
    copies = np.bincount(same, minlength=len(same))
    data = np.frombuffer(b"".join(contexts[i] for i in first), np.uint8)
    lengths = np.array([len(contexts[i]) for i in first])
    n = windows[first]
    base = np.repeat(np.cumsum(lengths) - lengths, n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    order, lcp = sort_suffixes(data, base + inner, np.repeat(group[first], n), depth)
    near = (lcp >= depth) | np.append(lcp[1:] >= depth, False)
    again = np.zeros(len(order), bool)
    again[order] = near
    again |= np.repeat(copies[first] > 1, n)
    # back to all contexts
    offset = np.zeros(len(contexts), np.int64)
    offset[first] = np.cumsum(n) - n
    return again[np.repeat(offset[same], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)]


def strip_repeats(docs: DataFrame, finish, schema: str, key: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id`` and ``finish(text bytes, a, z)`` of every row, where
    ``[a[i], z[i])`` are the maximal runs of bytes to remove."""

    def sort(contexts, windows, group):
        return repeated_windows(contexts, windows, group, min_bytes)

    return with_spans(docs, key, text, byte_alphabet, min_bytes, min(GRAM, min_bytes), sort, finish, schema, group_rows)


def kept_bytes(raw: bytes, a: np.ndarray, z: np.ndarray) -> bytes:
    return b"".join(raw[x:y] for x, y in zip([0, *z.tolist()], [*a.tolist(), len(raw)]))


def digest(raw: bytes, a: np.ndarray, z: np.ndarray) -> tuple[int, int, int, str]:
    return len(raw), int((z - a).sum()), len(a), hashlib.sha256(kept_bytes(raw, a, z)).hexdigest()


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 200-byte strings."""
    from .common import table

    return strip_repeats(table(spark, sf_dir, "documents"), digest, DIGEST)
