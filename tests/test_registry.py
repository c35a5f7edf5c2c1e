"""Every registered query with SQL gives DuckDB's rows; those without run."""

from numbers import Number

import duckdb
import numpy as np
import pandas as pd
import pytest

from tactus.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(df):
    def cell(v):
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str(list(v))
        if v is None or pd.isna(v):
            return "null"
        return repr(round(float(v), 6) + 0.0) if isinstance(v, Number) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted(str([cell(v) for v in row]) for row in df[sorted(df.columns)].values.tolist())


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    ours = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name not in registry.ORACLES:
        assert len(ours)
        return
    theirs = duck.execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert shown(ours) == shown(theirs)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and e.entry(spark).count() > 0
