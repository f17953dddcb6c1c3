"""Every query against its DuckDB SQL, on the smallest tables."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL

from tallyloom import queries


def plain(value):
    if value is None or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in value)
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, float, np.integer, np.floating)):
        return round(float(value), 5)
    return str(value)


def rows(frame, columns):
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_oracle(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0
