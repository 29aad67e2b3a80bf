"""Every query against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from cinderline.plans import answers, catalogue, files, pages, records, rules, runs, shapes, views  # noqa: F401 - they register their queries
from tests.conftest import SMALL


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    return round(float(v), 6) + 0.0 if isinstance(v, (float, np.floating)) else v


def rows(df: pd.DataFrame) -> list[str]:
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in catalogue.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL).toPandas()
    if name in catalogue.SQL:
        want = duck.sql(catalogue.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
