"""Queries against their SQL on texts that the small tables don't have."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry


def differences(spark, folder, name, **tables):
    """Rows that only the query gives, and those that only its SQL gives, over tables of columns."""
    con = duckdb.connect()
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = ({tuple(r) for r in rows} for rows in (entry.queries()[name](spark, str(folder)).collect(), con.execute(entry.oracle_sql()[name]).fetchall()))
    return got - want, want - got


def test_printed_zeros(spark, tmp_path):
    texts = ["call (578) 555-0141 vi now", "0007 v. text", "a 00 v b", "100 v c", "12 v d, 012 v e"]
    assert differences(spark, tmp_path, "clean_text", documents={"doc_id": list(range(len(texts))), "text": texts}) == (set(), set())


def test_short_and_shared_titles(spark, tmp_path):
    """Equal texts under the least length; ids that two texts share; a text without an id."""
    short, a, b, c = "abcdefghij" * 6, "Some words, that go on. " * 6, "Other things (said once) here; " * 5, "What has no number of its own! " * 5
    items = {"item_id": [1, 2, 2, 3], "text": [short, a, b, c]}
    docs = {"doc_id": [7, 8, 8, None, 9], "text": [short, "x " + a, "y " + b + " z", c, short + " and more of it than eighty characters, all told"]}
    assert differences(spark, tmp_path, "title_duplicates", benchmark=items, documents=docs) == (set(), set())
    assert differences(spark, tmp_path, "title_duplicates", benchmark=items, documents={"doc_id": [8, 9], "text": ["y " + b, "nothing"]}) == (set(), set())
