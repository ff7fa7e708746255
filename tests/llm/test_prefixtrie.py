import random
import zlib
from hashlib import sha256

import duckdb
import pytest

from hubflow.llm import prefixtrie
from hubflow.llm.queries import LLM_QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def tie(turn):
    return sha256(f"{len(turn[0])}:{turn[0]}{turn[1]}".encode()).hexdigest()


def plain(rows):
    """All prefixes of all rebuilt conversations."""
    original = {}
    for c, turn, role, text in rows:
        if c is not None:
            original.setdefault(c, []).append((turn is not None, turn or 0, (role or "", text or "")))
    for c, turns in original.items():
        original[c] = [t[2] for t in sorted(turns, key=lambda t: (*t[:2], tie(t[2])))]
    whole = {}
    for c, turns in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(original.get(base, [])[:h] + turns[h:])
    members = {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = []
    below = {p: [] for p in members}
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    childless = {p: not any(len(q) == len(p) + 1 for q in below[p]) for p in members}
    for p, convs in members.items():
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode().split()) for q in below[p] if q)
        ends = ",".join(map(str, sorted(c for c in convs if len(whole[c]) == len(p))))
        out.append((
            min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), sum(len(q) == len(p) + 1 for q in below[p]),
            sum(childless[q] for q in below[p]), saved, sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def run(spark, folder, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, tok string, pos int").write.parquet(f"{folder}/conversations.parquet")
    df = LLM_QUERIES["op11_prefix_trie"](spark, str(folder))
    assert df.columns == COLUMNS and all(t == "bigint" for _, t in df.dtypes[:-1])
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_shared_prefixes_of_many_lengths(spark, tmp_path):
    draw = random.Random(1)
    rows = []
    for c in range(120):
        if c % 20 or c % 40 == 0:  # every second base is absent
            for turn in range(draw.choice([1, 1, 2, 3, 4, 5, 8, 9, 13])):
                rows.append((c, turn, "ua"[turn % 2], f"t{draw.choice([0, 0, 0, 1])} b"))
    draw.shuffle(rows)
    assert run(spark, tmp_path, rows) == plain(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(1, 0, "u", "a b"), (1, None, "u", None), (1, 2, None, " a\x0b b "), (0, 5, "u", "a"), (-5, 0, "u", "a"), (-20, 1, "x", "y"), (-25, 0, "u", "")]
    rows += [(41, 1, "s", "same")] * 5 + [(42, 1, "s", "same"), (42, 1, "s", "other"), (42, 1, "a", "same")]
    rows += [(None, 0, "u", "a"), (None, None, None, None), (43, 0, "", "x"), (43, 0, "x", ""), (2**62, 0, "u", "a")]
    # turns of its own that are all lent by an absent base: turnless
    rows += [(c, 0, "u", "gone") for c in range(1000, 1010)] + [(70, 0, "u", "long " * 100_000)]
    got = run(spark, tmp_path, rows)
    assert got == plain(rows)
    assert [r for r in got if r[1] == 0][0][7] != sha256(b"").hexdigest()


def test_one_turn_only_and_none(spark, tmp_path):
    rows = [(c, 0, "u", f"t {c % 3}") for c in range(0, 100, 20)]
    assert run(spark, tmp_path / "a", rows) == plain(rows)
    assert run(spark, tmp_path / "b", []) == []
    gone = [(c, 0, "u", "gone") for c in range(1000, 1010) if zlib.crc32(str(c).encode()) % 4]
    gone = [r for r in gone if r[0] % 20]
    assert run(spark, tmp_path / "c", gone) == plain(gone)


def test_a_third_of_all_rows_in_one_conversation_and_in_copies(spark, tmp_path):
    rows = [(0, i, "u", f"w{i % 7} x") for i in range(300)]
    rows += [(3 + 20 * c, i, "u", f"copy {i} y") for c in range(100) for i in range(3)]
    draw = random.Random(2)
    rows += [(7 + 20 * c, i, "a", f"{draw.random():.1f}") for c in range(80) for i in range(4)]
    # places: the long conversation is spread over tasks
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    places = prefixtrie.placed(df).where("conv = 0").select("pos", "turns").collect()
    assert sorted(r.pos for r in places) == list(range(300)) and {r.turns for r in places} == {300}
    assert run(spark, tmp_path, rows) == plain(rows)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{folder}/conversations.parquet'")
    got = sorted((tuple(r) for r in LLM_QUERIES["op11_prefix_trie"](spark, folder).collect()), key=repr)
    assert got == sorted(con.sql(prefixtrie.OP11_SQL).fetchall(), key=repr)
    assert max(r[3] for r in got if r[1]) > 1
