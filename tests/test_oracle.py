"""Every query with SQL agrees with DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from driftline.plans.oracle import ORACLE_SQL
from driftline.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame:
        if pd.api.types.is_bool_dtype(frame[c]) or not pd.api.types.is_numeric_dtype(frame[c]):
            frame[c] = frame[c].astype(object).where(frame[c].notna(), None).map(str)
        else:
            frame[c] = frame[c].astype(float)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def duck(sql):
    con = duckdb.connect()
    for t in ("nation", "supplier", "customer", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.execute(sql).df()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    ours, theirs = plain(QUERIES[name](spark, SF).toPandas()), plain(duck(ORACLE_SQL[name]))
    assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs)
    for c in ours:
        if ours[c].dtype == object:
            assert ours[c].tolist() == theirs[c].tolist()
        else:
            assert np.allclose(ours[c], theirs[c], atol=1.1e-4, rtol=0, equal_nan=True)
