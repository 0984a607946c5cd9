"""Every query with SQL gives that SQL's rows; those without give rows."""

import duckdb
import pytest

from versewright.plans import catalog

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((str([r[c] for c in cols]) for r in df.collect()))
    if name not in catalog.oracle_sql():
        assert got
        return
    r = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted(str([x[names.index(c)] for c in cols]) for x in r.fetchall())
    norm = lambda rows: [x.replace("Decimal('", "").replace("')", "") for x in rows]
    assert norm(got) == norm(want)


def test_integrity_counts(spark):
    found = {r["code"]: r["n"] for r in catalog.queries()["sequence_integrity"](spark, SF).collect()}
    assert found == {"VERSE_DUPLICATE": 1401, "VERSE_OUT_OF_ORDER": 1958, "VERSE_START_NOT_ONE": 814, "VERSE_SEQUENCE_GAP": 2388}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
