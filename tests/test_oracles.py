"""Every query of the reference's operators against its oracle at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from loomspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, float):
        return round(x, 6)
    return int(x) if hasattr(x, "__index__") and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_oracle(spark, db, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), db.sql(registry.oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[order].astype(object).itertuples(index=False)), key=str)
    assert rows(got) == rows(want)


def test_every_query_has_an_oracle():
    # ids of a tokenizer are not SQL's: test_loaders holds the operator against the tokenizer
    assert set(registry.queries()) == set(registry.oracles()) | {"chunk_tokens"}
