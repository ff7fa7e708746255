"""Removal of repeated word strings by suffix subtrees.

A word is removed if a window of ``min_words`` words that covers it also starts
anywhere else in the corpus. Suffixes are split into memory-sized groups by
signature (see ``repeats``); for each group a subtree of the suffix tree is built
top down, and the leaves below its internal nodes of depth ``min_words`` are the
repeats.

Words are compared by 64-bit hashes. Defined cases: a null text has no words;
windows lie within one document; texts with fewer words than a window lose
nothing; long texts are read whole; two equal rows repeat each other; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .repeats import GROUP_ROWS, Alphabet, mix, with_spans

MIN_WORDS = 35
GRAM = 12


def word_alphabet() -> Alphabet:
    digest = xxhash.xxh64_intdigest

    def codes(units, which):
        out = np.fromiter(map(digest, units), np.uint64, len(units))
        return mix(out + np.uint64(0x632BE59BD9B4E019)) if which else out

    return Alphabet(lambda raw: raw.split(), codes, lambda units, a, b: b" ".join(units[a:b]))


@dataclass
class Subtree:
    """Internal nodes of the suffix trees of some groups, down to a depth limit:
    node ``i`` has the leaves ``order[first[i]:last[i]]``, string depth
    ``depth[i]`` and parent ``parent[i]`` (-1: a group's root)."""

    order: np.ndarray
    first: np.ndarray
    last: np.ndarray
    depth: np.ndarray
    parent: np.ndarray


def subtree(codes: np.ndarray, starts: np.ndarray, group: np.ndarray, limit: int) -> Subtree:
    """Built top down, all nodes of a string depth at once: a node whose leaves
    agree on the next symbol grows its edge by it, another branches into one
    child per symbol. Single leaves need no node. Depth ends at ``limit``."""
    order = np.arange(len(starts))
    bounds = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(starts) else np.zeros(0, np.int64)
    first, last = bounds, np.append(bounds[1:], len(starts))[: len(bounds)]
    parent = np.full(len(first), -1)
    done: list[tuple] = []
    made = 0
    for d in range(limit + 1):
        keep = last - first > 1
        first, last, parent = first[keep], last[keep], parent[keep]
        if not len(first):
            break
        if d == limit:
            done.append((first, last, np.full(len(first), d), parent))
            break
        size = last - first
        node = np.repeat(np.arange(len(first)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[node]
        symbol = codes[starts[order[place]] + d]
        heads = np.cumsum(size) - size
        branches = np.logical_or.reduceat(symbol != symbol[heads][node], heads)
        if not branches.any():
            continue
        at = np.flatnonzero(branches[node])
        by = at[np.lexsort((symbol[at], node[at]))]
        order[place[at]] = order[place[by]]
        symbol, inner = symbol[by], node[at]
        new = np.flatnonzero(np.concatenate(([True], (inner[1:] != inner[:-1]) | (symbol[1:] != symbol[:-1]))))
        end = np.append(new[1:], len(inner))
        # the branching nodes are final; their children go on
        done.append((first[branches], last[branches], np.full(branches.sum(), d), parent[branches]))
        number = np.cumsum(branches) - 1 + made
        made += int(branches.sum())
        child_first, child_parent = place[at][new], number[inner[new]]
        first = np.concatenate((first[~branches], child_first))
        last = np.concatenate((last[~branches], child_first + end - new))
        parent = np.concatenate((parent[~branches], child_parent))
    parts = [np.concatenate(x) for x in zip(*done)] if done else [np.zeros(0, np.int64)] * 4
    return Subtree(order, *parts)


def repeated_windows(contexts: list[bytes], windows: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """Whether each window of each context begins another suffix of its group."""
    seen: dict = {}
    same = np.array([seen.setdefault((g, c), i) for i, (g, c) in enumerate(zip(group.tolist(), contexts))])
    unique = np.flatnonzero(same == np.arange(len(same)))
    copies = np.bincount(same, minlength=len(same))
    split = [contexts[i].split() for i in unique]
    digest = xxhash.xxh64_intdigest
    codes = np.array([digest(w) for words in split for w in words], np.uint64)
    lengths, n = np.array([len(w) for w in split]), windows[unique]
    starts = np.repeat(np.cumsum(lengths) - lengths, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    tree = subtree(codes, starts, np.repeat(group[unique], n), limit)
    again = np.repeat(copies[unique] > 1, n)
    deep = np.flatnonzero(tree.depth == limit)
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, tree.first[deep], 1)
    np.add.at(edge, tree.last[deep], -1)
    again[tree.order[np.cumsum(edge[:-1]) > 0]] = True
    offset = np.zeros(len(contexts), np.int64)
    offset[unique] = np.cumsum(n) - n
    return again[np.repeat(offset[same], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)]


def strip_repeats(docs: DataFrame, finish, schema: str, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id`` and ``finish(text bytes, a, z)`` of every row, where
    ``[a[i], z[i])`` are the maximal runs of words to remove."""

    def sort(contexts, windows, group):
        return repeated_windows(contexts, windows, group, min_words)

    return with_spans(docs, key, text, word_alphabet, min_words, min(GRAM, min_words), sort, finish, schema, group_rows)


def kept_words(raw: bytes, a: np.ndarray, z: np.ndarray) -> list[bytes]:
    w = raw.split()
    return [x for i, j in zip([0, *z.tolist()], [*a.tolist(), len(w)]) for x in w[i:j]]


def digest(raw: bytes, a: np.ndarray, z: np.ndarray) -> tuple[int, int, str]:
    kept, gone = kept_words(raw, a, z), int((z - a).sum())
    return len(kept) + gone, gone, hashlib.sha256(b" ".join(kept)).hexdigest()


DIGEST = "n_words long, n_removed long, kept_sha256 string"


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 35-word windows."""
    from .common import table

    return strip_repeats(table(spark, sf_dir, "documents"), digest, DIGEST)
