import random

import numpy as np
import pytest

from hubflow.llm import decontaminate as dc
from hubflow.llm.queries import LLM_QUERIES

DOCS = "doc_id long, text string, rid int, item_id int, c int"
ITEMS = "item_id long, text string, words int"


def plain_distance(item, text):
    """Fewest edits of ``item`` into a stretch of ``text``, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        now = [i + 1]
        for j, y in enumerate(text):
            now.append(min(row[j] + (x != y), row[j + 1] + 1, now[j] + 1))
        row = now
    return min(row)


def plain_leaks(docs, items):
    out = set()
    for d, text, *_ in docs:
        words = dc.tokens(text)
        vocab = set(words)
        for i, t, *_ in items:
            item = dc.tokens(t)
            n = dc.edits_allowed(len(item))
            if item and sum(w in vocab for w in item) >= len(item) - n and plain_distance(item, words) <= n:
                out.add((d, i))
    return out


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = LLM_QUERIES["op3_decontaminate"](spark, sf).collect()
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    want = plain_leaks(docs, items)
    assert len(want) > 10 and {(r.doc_id, r.item_id) for r in got} == want


def planted(n, seed, similarity=0.8):
    """Items, and documents that hold them with as many edits as allowed."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of"] * 60
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(10, 60))), 0) for i in range(n)]
    docs = []
    for i, text, _ in items:
        words = text.split()
        for _ in range(dc.edits_allowed(len(words), similarity)):
            at, kind = rng.randrange(len(words)), rng.random()
            if kind < 0.4:
                words[at] = rng.choice(vocab)
            elif kind < 0.7:
                del words[at]
            else:
                words.insert(at, rng.choice(vocab))
        around = [" ".join(rng.choices(vocab, k=rng.randint(0, 200))) for _ in range(2)]
        docs.append((i, f"{around[0]} {' '.join(words)} {around[1]}", 0, 0, 0))
    return docs, items


@pytest.mark.parametrize("similarity, recall", [(0.8, 0.9), (0.9, 0.98), (1.0, 1.0)])
def test_recall_of_edited_passages(spark, similarity, recall):
    docs, items = planted(300, 4, similarity)
    got = dc.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert sum((i, i) in found for i, *_ in items) / len(items) >= recall
    text = dict((d[0], d[1]) for d in docs)
    by_id = dict((i[0], i[1]) for i in items)
    for r in got:
        assert r.edits == plain_distance(dc.tokens(by_id[r.item_id]), dc.tokens(text[r.doc_id])) <= dc.edits_allowed(r.item_words)


def at_the_bound(kind, lengths, n, seed):
    """Items of distinct words, and documents that hold them with all edits
    allowed: spread evenly, substituted at random, or in one block of lost words."""
    rng, docs, items = random.Random(seed), [], []
    for i in range(n):
        words = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(*lengths))]
        items.append((i, " ".join(words), 0))
        size, e = len(words), dc.edits_allowed(len(words))
        if kind == "block":
            at = rng.randint(0, size - e)
            del words[at : at + e]
        else:
            for at in [size * k // e for k in range(e)] if kind == "spread" else rng.sample(range(size), e):
                words[at] = f"x{rng.randrange(10**9)}"
        around = [" ".join(f"y{rng.randrange(500)}" for _ in range(rng.randint(0, 100))) for _ in range(2)]
        docs.append((i, f"{around[0]} {' '.join(words)} {around[1]}", 0, 0, 0))
    return docs, items


@pytest.mark.parametrize("kind, lengths", [("block", (20, 60)), ("block", (100, 300)), ("spread", (20, 60)), ("spread", (100, 300)), ("random", (100, 300))])
def test_recall_at_the_bound_for_every_length(spark, kind, lengths):
    docs, items = at_the_bound(kind, lengths, 150, 7)
    got = dc.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert len(got) >= dc.TARGET_RECALL * len(items)
    for r in got:
        assert r.doc_id == r.item_id and r.edits <= dc.edits_allowed(r.item_words)


def test_some_part_has_one_edit_at_most():
    for similarity in (0.5, 0.8, 0.9, 1.0):
        for n in range(5, 400):
            parts = dc.cut(n, similarity)
            assert [a for a, _ in parts] + [n] == [0] + [b for _, b in parts] and all(a < b for a, b in parts)
            assert dc.edits_allowed(n, similarity) < len(parts) * (dc.PART_EDITS + 1)


@pytest.mark.parametrize("m", range(5, 11))
def test_tables_find_a_part_with_an_edit_at_any_word(m):
    assert {b - a for n in range(5, 1000) for a, b in dc.cut(n)} == set(range(5, 11))
    rng, c, k = np.random.default_rng(m), dc.length_class(m), 400
    span = dc.class_shape(c, edits=dc.PART_EDITS)[1]
    item = rng.integers(1, 1 << 62, (k, m), dtype=np.uint64)
    want = dc.signatures(np.concatenate((item, np.zeros((k, span - m), np.uint64)), axis=1), c)
    for kind in ("substitute", "delete", "insert"):
        for at in range(m) if kind != "insert" else range(1, m):
            new = rng.integers(1, 1 << 62, (k, 0 if kind == "delete" else 1), dtype=np.uint64)
            around = rng.integers(1, 1 << 62, (2, k, span + 2), dtype=np.uint64)
            doc = np.concatenate((around[0], item[:, :at], new, item[:, at + (kind != "insert") :], around[1]), axis=1)
            hit = [(dc.signatures(doc[:, s : s + span], c) == want).any(1) for s in range(span, span + 5)]
            assert np.any(hit, axis=0).mean() >= dc.TARGET_RECALL, (kind, at)


def test_case_symbols_nulls_repeats_and_short_items(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, f"x\n### {item.upper()}!! y"), (2, item.replace("five", "5")), (3, None), (4, ""), (None, item), (6, "one two three"), (7, "q " * 50_000 + item), (7, "q " * 50_000 + item), (8, item[:20])]
    items = [(10, item), (11, item), (12, None), (13, ""), (14, "one two"), (None, "q q q q q q")]
    df = spark.createDataFrame([(*d, 0, 0, 0) for d in docs], DOCS)
    bench = spark.createDataFrame([(*i, 0) for i in items], ITEMS)
    got = dc.leaks(df, bench).collect()
    assert sorted(((r.doc_id or -1), (r.item_id or -1), r.edits) for r in got) == [
        (-1, 10, 0), (-1, 11, 0), (-1, 14, 0), (1, 10, 0), (1, 11, 0), (1, 14, 0), (2, 10, 1), (2, 11, 1), (2, 14, 0),
        (6, 14, 0), (7, -1, 0), (7, 10, 0), (7, 11, 0), (7, 14, 0), (8, 14, 0),
    ]
    clean = dc.drop_leaks(df, bench)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 6, 8]
    assert dc.leaks(df.limit(0), bench).count() == 0 and dc.leaks(df, bench.limit(0)).count() == 0


def test_embedding_falls_into_step_again():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 1 << 62, (400, 40), dtype=np.uint64)
    b = a.copy()
    b[:, 10:-1] = a[:, 11:]  # one word lost
    c = dc.length_class(33)
    share = (dc.signatures(a, c) == dc.signatures(b, c)).mean()
    other = (dc.signatures(a, c) == dc.signatures(a[::-1], c)).mean()
    assert share > 0.25 and other < 0.01
    assert dc.tables_for(0.98, 0.55, 3) == 22


def test_classes_cover_every_length():
    for n in range(5, 2000):
        c = dc.length_class(n)
        assert n in dc.class_lengths(c)
        steps, span, keep, edits = dc.class_shape(c)
        assert span >= n + dc.edits_allowed(n) and all(keep[g] <= n - g + 1 - g * dc.edits_allowed(n) for g in (2, 3)) and edits >= dc.edits_allowed(n)


def test_both_ways_to_words_agree():
    for text in ["A_b c-d É1 ñ ß", "“x” – y_z… ´´ É2é", "", None, "### A&&& 1.5", "İstanbul ŉ ǆ"]:
        assert dc.tokens(text) == [w.encode() for w in dc._WORD.findall((text or "").lower())]


def test_items_of_one_to_four_words_are_matched_by_equality(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 40))), 0, 0, 0) for i in range(200)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 4))), 0) for i in range(60)]
    got = dc.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert {(r.doc_id, r.item_id) for r in got} == plain_leaks(docs, items) and {r.edits for r in got} == {0}
    text = {d[0]: dc.tokens(d[1]) for d in docs}
    by_id = {i[0]: dc.tokens(i[1]) for i in items}
    assert all(text[r.doc_id][r.word_at - r.item_words : r.word_at] == by_id[r.item_id] for r in got)
    clean = dc.drop_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert clean.count() == len(docs)


def templated(n_items, n_docs, seed=3):
    """Items that share a question template, documents that hold it alone, and
    documents that hold an item with edits."""
    rng = random.Random(seed)
    stem = "which of the following statements is true about the"
    items = [(i, f"{stem} {' '.join(f'a{rng.randrange(10**6)}' for _ in range(rng.randint(9, 20)))}", 0) for i in range(n_items)]
    docs = [(i, f"{' '.join(f'y{rng.randrange(500)}' for _ in range(40))} {stem} {' '.join(f'y{rng.randrange(500)}' for _ in range(40))}", 0, 0, 0) for i in range(n_docs)]
    for i in range(0, n_items, 4):
        words = items[i][1].split()
        for at in rng.sample(range(len(words)), dc.edits_allowed(len(words))):
            words[at] = "z"
        docs.append((n_docs + i, " ".join(words), 0, 0, 0))
    return docs, items


def test_a_shared_template_ships_a_few_rows_per_document(spark, monkeypatch):
    docs, items = templated(200, 800)
    counts = []
    monkeypatch.setattr(dc, "staged", lambda df, real=dc.staged: counts.append(real(df)) or counts[-1])
    got = dc.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(800 + i, i) for i in range(0, 200, 4)}
    sizes = {tuple(df.columns): df.count() for df in counts if "rid" in df.columns}
    assert all(n <= 30 * len(docs) for n in sizes.values()), sizes  # windows and tables, whatever the number of items
    assert sizes["rid", "doc_id", "pid", "place"] <= 8 * len(docs)
    assert sizes["rid", "doc_id", "iid", "item_id", "place", "low", "high"] <= len(docs)


@pytest.mark.parametrize("m", range(5, 11))
def test_the_window_filter_keeps_a_part_with_an_edit_at_any_word(m):
    rng, c = np.random.default_rng(m), dc.length_class(m)
    shape = dc.class_shape(c, edits=dc.PART_EDITS)
    item = rng.integers(1, 1 << 62, m, dtype=np.uint64)
    known = np.zeros(dc.BITMAP_BITS, bool)
    known[dc.part_bits(item, c)] = True
    for kind in ("substitute", "delete", "insert"):
        for at in range(m):
            new = rng.integers(1, 1 << 62, 0 if kind == "delete" else 1, dtype=np.uint64)
            around = rng.integers(1, 1 << 62, (2, 30), dtype=np.uint64)
            line = np.concatenate((around[0], item[:at], new, item[at + (kind != "insert") :], around[1]))
            pair = known[dc.gram_bits(line, 2)]
            assert 30 in dc.near_starts(line, pair, known, c, shape), (kind, at)
