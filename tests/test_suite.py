"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from dishlens.plans import oracle, suite

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings benchmark conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def test_every_query_is_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(suite.REGISTRY) - set(entry.oracle_sql()) == {"cell_recall"}  # rows scored follow fitted centroids


def test_the_cell_index_finds_all_that_a_search_over_all_rows_finds(spark):
    got = entry.queries()["cell_recall"](spark, DIR).collect()
    assert got and all(r.query_id % 20 == 0 and r.recall == 1 and r.n_found == r.n_exact for r in got)
    assert all(0 < r.share_scored <= 1 for r in got)


@pytest.mark.parametrize("name", sorted(oracle.sql()))
def test_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    cur = db.execute(entry.oracle_sql()[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    assert got == sorted(str(tuple(r[have.index(c)] for c in cols)) for r in cur.fetchall())


def test_processed_reviews_hold_each_text_once(spark):
    """The search text is put together from what is written, and is the one that processing makes."""
    from dishlens.plans import preprocess as pp

    t = suite.Tables(spark, DIR)
    done = t.processed()
    assert done.columns == pp.PROCESSED
    folder = os.path.dirname(done.inputFiles()[0])
    assert "search_text" not in spark.read.parquet(folder).columns
    want = pp.process_reviews(t.reviews(), t.dictionary()).select("review_id", "search_text")
    assert done.select("review_id", "search_text").exceptAll(want).count() == 0 and done.count() == want.count()
