import os

import duckdb
import pytest

from lorestone.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    flat = lambda x: round(x, 9) if isinstance(x, float) else x
    ours = sorted([tuple(flat(r[c]) for c in cols) for r in df.collect()], key=repr)
    theirs = sorted([tuple(flat(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()], key=repr)
    assert ours == theirs
