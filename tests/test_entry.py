"""The registered queries on the smallest tables, against their SQL."""

import os

import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Of each plan module some; the driver runs them all.
SOME = ["ngram_termfreq", "tfidf", "treebank_tokens", "message_blocks", "morris_count", "bloom_membership", "doc_signature", "near_duplicates", "beam_kbest", "running_classification", "multi_model", "gray_code"]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(SOME) <= set(o)


@pytest.mark.skipif(not os.path.exists(DIR), reason="no tables here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    import duckdb

    df = entry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    r = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(plain(row[names.index(c_)]) for c_ in columns)) for row in r.fetchall())


@pytest.mark.skipif(not os.path.exists(DIR), reason="no tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
