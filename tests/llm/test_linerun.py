import duckdb
import pytest

from hubflow.llm import linerun
from hubflow.llm.queries import LLM_QUERIES

DOCS = "doc_id long, text string, rid int, row string, out string"


def plain(rows, m):
    """Deleted lines and kept text of each row; equal rows are one document."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, out = set(), {}
    for row in order:
        lines = (row[1] or "").split("\n")
        written = [i for i, x in enumerate(lines) if x.encode().split()]
        gone = set()
        for i in range(len(written) - m + 1):
            run = tuple(lines[j] for j in written[i : i + m])
            if run in seen:
                gone |= set(range(i, i + m))
            seen.add(run)
        drop = {written[g] for g in gone}
        out[row] = (len(written), len(gone), sum(g - 1 not in gone for g in gone), "\n".join(x for i, x in enumerate(lines) if i not in drop))
    return out


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_runs_of_any_length(spark, m):
    texts = ["a\nb\nc\nd\ne\nf", "x\nb\nc\n\nd\ny", "b\nc\nd\ne\nf", "a\na\na\na\na\na\na", None, "", "\n\n", "a", " \n a\nb\x0b\nc", "z\n" * 300]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2])]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS)
    got = linerun.drop_repeated_runs(df, min_lines=m).collect()
    assert got[0].row.asDict().keys() == set(df.columns) and len(got) == len(rows)
    want = plain(rows, m)
    for r in got:
        assert tuple(r.out) == want[(r.row.doc_id, r.row.text)]


def test_null_id_comes_last(spark):
    df = spark.createDataFrame([(None, "a\nb\nc", 1, "", ""), (5, "a\nb", 1, "", "")], DOCS)
    assert {r.row.doc_id: r.out.kept for r in linerun.drop_repeated_runs(df).collect()} == {5: "a\nb", None: "c"}
    assert linerun.drop_repeated_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.sql(f"select doc_id, n_lines, n_removed, n_runs, kept_sha256 from ({linerun.OP7_SQL})").fetchall())
    got = sorted(tuple(r) for r in LLM_QUERIES["op7_line_runs"](spark, sf).collect())
    assert got == want and sum(r[2] for r in got) > 0
