"""The queries over whole tables, on odd rows, against their SQL and plain versions."""

import duckdb
import pytest
from conftest import canonical

from loomspark.plans import catalog

LONG = "it's a {brace} and a \\ slash — naïve 漢字　wide " * 400
ODD = [LONG, LONG + 'says "so"', "one", "", " \n ", "A\r\nB\rC\x0bD", "1. a 2. b 3. c 4. d 5. e 6. f 7. g 8. h", " Ünï ٣ CODE 12\nx ", "\n".join(f"- p{i}" for i in range(9)), "• a • b"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    rows = [(i, ODD[i % len(ODD)], "en", f"src{i % 4}", 0) for i in range(60)]
    # src4 has nothing in the trimmed lane
    rows += [(60 + i, "text", "en", "src4", 0) for i in (1, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, f"name{i}", "T", "B", 1) for i in range(20)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{path}/part.parquet")
    turns = [(1, 1, "user", "a\n\nb\n 　\nc"), (1, 2, "user", "one"), (2, 1, "user", "\n\n x \n\n"), (2, 2, "user", "")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def both(spark, odd, name):
    """The rows of a query, after they were held against its SQL."""
    con = duckdb.connect()
    for table in ("documents", "labels", "part", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{odd}/{table}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, odd)
    rows = df.collect()
    cur = con.execute(catalog.ORACLE[name])
    assert canonical([tuple(r) for r in rows], df.columns) == canonical(cur.fetchall(), [d[0] for d in cur.description])
    return rows


def test_cloze_replies_hold_whole_texts(spark, odd):
    rows = {r.doc_id: r.cloze for r in both(spark, odd, "cloze_repair")}
    assert len(rows) == 62 and len(rows[20]) > len(LONG) and rows[20].count("{{c") == rows[20].count("}}") > 400
    reasons = {r.doc_id: r.reason for r in both(spark, odd, "cloze_budget")}
    assert "::\\\\ slash — naïve 漢字 wide}}' has 6 words" in reasons[20] and reasons[21] is None


@pytest.mark.parametrize("name, rows", [("scalar_keys", 62), ("list_budget", 62), ("term_table_faults", 20), ("overflow_render", 5), ("ledger_latest", None), ("ledger_size", 1)])
def test_whole_tables(spark, odd, name, rows):
    got = both(spark, odd, name)
    assert rows is None or len(got) == rows
    if name == "overflow_render":
        bodies = {r.source: r.body for r in got}
        assert "no overflow here" in bodies["src4"] and "## 1. From src0" in bodies["src0"]
    if name == "ledger_latest":
        assert "g62" in {r.stable_guid for r in got}


def test_turns_are_split_into_chunks(spark, odd):
    got = sorted((r.conv_id, r.turn, r.chunk_ord, r.text) for r in both(spark, odd, "transcript_chunks"))
    assert got == [(1, 1, 0, "a"), (1, 1, 1, "b"), (1, 1, 2, "c"), (1, 2, 0, "one"), (2, 1, 0, "x")]
