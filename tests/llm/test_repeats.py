import hashlib
from collections import Counter

import numpy as np
import pytest

from hubflow.llm import bytesuffix, wordtree
from hubflow.llm.queries import LLM_QUERIES
from hubflow.llm.repeats import merged, own_copies, runs, window_minimum

DOCS = "doc_id long, text string, rid string, spans int, a string"


def brute(texts, m, split):
    """Covered positions of every text, by counting all windows."""
    units = [split((t or "").encode()) for t in texts]
    seen = Counter(bytes(u[i : i + m]) if isinstance(u, bytes) else tuple(u[i : i + m]) for u in units for i in range(len(u) - m + 1))
    out = []
    for u in units:
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - m + 1):
            if seen[bytes(u[i : i + m]) if isinstance(u, bytes) else tuple(u[i : i + m])] > 1:
                gone[i : i + m] = True
        out.append((u, gone))
    return out


def plain_bytes(texts, m=200):
    out = []
    for u, gone in brute(texts, m, bytes):
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(u), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(u, gone) if not g)).hexdigest()))
    return out


def plain_words(texts, m=35):
    return [(len(u), int(gone.sum()), hashlib.sha256(b" ".join(w for w, g in zip(u, gone) if not g)).hexdigest()) for u, gone in brute(texts, m, bytes.split)]


@pytest.mark.parametrize("name, plain", [("op5_suffix_dedup", plain_bytes), ("op10_substring_dedup", plain_words)])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_counting_all_windows(spark, name, plain, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in LLM_QUERIES[name](spark, f"/root/testdata/{sf}").collect()}
    assert got == {d.doc_id: p for d, p in zip(docs, plain([d.text for d in docs]))}


def odd_texts():
    rng = np.random.default_rng(3)
    vocab = ["a", "bb", "é", "dd\x00", "the"]
    passage = " ".join(rng.choice(vocab, 60))
    texts = [None, "", " \n ", "short", "x" * 900, "y " * 400, "ab" * 300]
    texts += [" ".join(rng.choice(vocab, 30)) + " " + passage + f" {i} " + " ".join(map(str, rng.integers(0, 10**6, 50))) for i in range(60)]
    texts += [passage, passage, "\t".join(passage.split()), passage[:150], passage[7:190]]
    texts += [" ".join(map(str, rng.integers(0, 10**6, 30_000)))]
    return texts


@pytest.mark.parametrize("rows", [400, 4])
def test_odd_texts_hot_passages_and_split_groups(spark, rows):
    texts = odd_texts()
    table = [(i if i % 7 else None, t, "x", 1, "y") for i, t in enumerate(texts)] + [(3, texts[3], "x", 1, "y")] * 2
    df = spark.createDataFrame(table, DOCS)
    all_texts = [t[1] for t in table]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = bytesuffix.strip_repeats(df, bytesuffix.digest, bytesuffix.DIGEST, group_rows=rows).collect()
    assert sorted(map(key, map(tuple, got))) == sorted(key((t[0], *p)) for t, p in zip(table, plain_bytes(all_texts)))
    got = wordtree.strip_repeats(df, wordtree.digest, wordtree.DIGEST, group_rows=rows).collect()
    assert sorted(map(key, map(tuple, got))) == sorted(key((t[0], *p)) for t, p in zip(table, plain_words(all_texts)))


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert bytesuffix.strip_repeats(df, bytesuffix.digest, bytesuffix.DIGEST).count() == 0
    assert wordtree.strip_repeats(df, wordtree.digest, wordtree.DIGEST).count() == 0


def test_suffixes_are_sorted_with_their_common_prefixes():
    rng = np.random.default_rng(5)
    for depth in (5, 16, 29, 40):
        data = rng.integers(97, 99, 600).astype(np.uint8)
        data[200:300] = data[:100]
        starts = np.sort(rng.choice(600 - depth, 250, replace=False))
        group = np.sort(rng.integers(0, 3, 250))
        order, lcp = bytesuffix.sort_suffixes(data, starts, group, depth)
        raw = [data[s : s + depth].tobytes() for s in starts]
        assert sorted(order.tolist()) == list(range(250))
        for i in range(250):
            if i == 0 or group[i] != group[i - 1]:
                assert lcp[i] == 0
                continue
            x, y = raw[order[i - 1]], raw[order[i]]
            assert group[order[i]] == group[i] and x <= y
            assert lcp[i] == next((j for j in range(depth) if x[j] != y[j]), depth)


def test_tree_nodes_hold_what_shares_their_prefix():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 2, 400).astype(np.uint64)
    starts, limit = np.arange(0, 380), 12
    tree = wordtree.subtree(codes, starts, np.zeros(380, np.int64), limit)
    for a, z, d, p in zip(tree.first, tree.last, tree.depth, tree.parent):
        leaves = {tuple(codes[s : s + d]) for s in starts[tree.order[a:z]]}
        assert len(leaves) == 1 and z - a > 1
        if p >= 0:
            assert tree.depth[p] < d and tree.first[p] <= a and z <= tree.last[p]
    deep = sum(int(z - a) for a, z, d in zip(tree.first, tree.last, tree.depth) if d == limit)
    count = Counter(tuple(codes[s : s + limit]) for s in starts)
    assert deep == sum(n for n in count.values() if n > 1)


def test_signatures_and_intervals():
    rng = np.random.default_rng(7)
    v = rng.integers(0, 5, 100).astype(np.uint64)
    for w in (1, 2, 3, 7, 16, 24):
        low, tied = window_minimum(v, w)
        for i in range(100 - w + 1):
            part = v[i : i + w].tolist()
            assert low[i] == min(part) and tied[i] == (part.count(min(part)) > 1)
    got = [x for x in runs(np.arange(50, dtype=np.uint64), 20, 8)]
    assert sum(int(n.sum()) for _, _, n, _ in got) == 31
    a, z = merged(np.array([5, 0, 9, 20]), np.array([8, 6, 12, 21]))
    assert a.tolist() == [0, 9, 20] and z.tolist() == [8, 12, 21]


def test_copies_of_windows_within_a_context():
    once, (a, z) = own_copies(np.array([5, 7, 5, 7, 9, 7, 4, 4]), np.array([0, 1, 0, 1, 0, 2, 0, 0]))
    assert sorted(once.tolist()) == [0, 1, 4, 5, 6]
    assert (a.tolist(), z.tolist()) == ([0, 6], [4, 8])


@pytest.mark.parametrize("rows", [20_000, 300])
def test_long_rules_and_a_third_of_all_rows_equal(spark, rows):
    """Rules of one character and repeated phrases, as long contexts and split;
    equal rows report each span once."""
    own = [f"{i * 7919 % 1000:03d} own words of document {i} {chr(65 + i)}" for i in range(12)]  # borders differ
    texts = [own[i] + "-" * (50_000 + 1000 * i) + chr(97 + i) for i in range(6)] + [own[6 + i] + " ab cd" * 8000 for i in range(6)]
    table = [(i, t, "x", 1, "y") for i, t in enumerate(texts)]
    alike = " ".join(f"w{i}" for i in range(600))
    table += [(50, alike, "x", 1, "y")] * 90
    got = bytesuffix.strip_repeats(spark.createDataFrame(table, DOCS), bytesuffix.digest, bytesuffix.DIGEST, group_rows=rows).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(table) and {(r.n_removed, r.n_spans) for r in got if r.doc_id == 50} == {(len(alike), 1)}
    assert [(by[i].n_removed, by[i].n_spans) for i in range(12)] == [(50_000 + 1000 * i, 1) for i in range(6)] + [(48_000, 1)] * 6
    got = wordtree.strip_repeats(spark.createDataFrame(table, DOCS), wordtree.digest, wordtree.DIGEST, group_rows=rows).collect()
    by = {r.doc_id: r for r in got}
    assert {r.n_removed for r in got if r.doc_id == 50} == {600}
    assert [by[i].n_removed for i in range(12)] == [0] * 6 + [16_000] * 6
