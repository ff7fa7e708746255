from itertools import permutations

import duckdb
import pytest

from hubflow.llm import filteraudit
from hubflow.llm.queries import LLM_QUERIES


def plain(rows, labels):
    """Every order applied to every document, one filter after the other."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = []
    for i, t, p in rows:
        t = t or ""
        w = t.encode().split()
        failed = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and i > first[t],
        }
        told = labels.get(i, []) if i is not None else []
        docs.append((p or "", failed, any(q == 1 for q, _ in told), any(x == 1 for _, x in told)))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for s, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                redundant = sum(d[1][f] for d in own) - len(gone)
                unique = sum(d[1][f] and sum(d[1].values()) == 1 for d in own)
                left = [d for d in left if not d[1][f]]
                share[f] += len(gone)
                out[part, "".join(order), s] = [len(left), len(gone), redundant, unique, sum(d[2] for d in gone), sum(d[3] for d in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v.insert(6, share[v[-1]])
    return out


def run(spark, folder, rows, labels):
    spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, source string, hash string, mask int").write.parquet(f"{folder}/documents.parquet")
    told = [(i, q, x, "y") for i, v in labels.items() for q, x in v]
    spark.createDataFrame(told, "doc_id long, quality int, toxic int, part string").write.parquet(f"{folder}/labels.parquet")
    df = LLM_QUERIES["op13_filter_audit"](spark, str(folder))
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley", "filter"]
    got = df.collect()
    assert len({r[:3] for r in got}) == len(got)
    return {tuple(r[:3]): list(r[3:]) for r in got}


def test_against_every_order_by_hand(spark, tmp_path):
    clean = " ".join(f"w{i}" for i in range(60))
    texts = [clean, clean + " #", clean.upper(), "a b", None, "", "É" * 3 + " A", "a " * 60, "a b " * 40, "X\x0bY|", clean + " " + " ".join("ab" * 40), "lang " * 50_000]
    rows = [(i, t, ["s", "t", None, ""][i % 4]) for i, t in enumerate(texts * 4)]
    rows += [(None, clean, "s"), (None, None, None), (3, "a b", "s"), (3, "a b", "s"), (7, None, "only"), (-1, "a b", "t")]
    labels = {0: [(1, 0)], 1: [(0, 1), (1, None)], 2: [(None, None)], 3: [(1, 1)], 12: [(1, 0)], 900: [(1, 1)], None: [(1, 1)]}
    assert run(spark, tmp_path, rows, labels) == plain(rows, labels)


def test_a_third_of_all_rows_are_copies(spark, tmp_path):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", "hot" if i % 3 else f"p{i % 5}") for i in range(3000)]
    assert run(spark, tmp_path, rows, {}) == plain(rows, {})


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, [], {}) == {}


def test_ranks_are_the_first_failing_step():
    orders, position, rank = filteraudit.removal_ranks(4)
    for o, order in enumerate(orders):
        assert [position[f, o] for f in order] == [1, 2, 3, 4]
        for mask in range(16):
            assert rank[mask, o] == next((s for s, f in enumerate(order, 1) if mask >> f & 1), 5)


def test_other_numbers_of_filters(spark):
    masks = spark.createDataFrame([("p", 1, 2, 1, 0), ("p", 3, 5, 0, 1), ("p", 0, 7, 0, 0), ("p", 3, 1, 0, 0)], "part string, mask int, docs long, good long, toxic long")
    got = {r[1:3]: tuple(r[3:10]) for r in filteraudit.audit(masks, "xy").collect()}
    assert got == {("xy", 1): (7, 8, 0, 2, 1, 1, 10), ("xy", 2): (7, 0, 6, 0, 0, 0, 6), ("yx", 1): (9, 6, 0, 0, 0, 1, 6), ("yx", 2): (7, 2, 6, 2, 1, 0, 10)}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = LLM_QUERIES["op13_filter_audit"](spark, folder)
    rel = con.sql(filteraudit.OP13_SQL)
    assert rel.columns == df.columns
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(rel.fetchall()) and sum(r[4] for r in got) > 0
