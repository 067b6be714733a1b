"""Every registered query of the library against its SQL in DuckDB, on the smallest dataset."""

import os

import duckdb
import pandas as pd
import pytest

from eventgraph.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(folder):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        con.execute(f"create view {name} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def value(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return None
        v = v.item() if hasattr(v, "item") else v
        if isinstance(v, float):
            v = float(f"{v:.9g}")
            return int(v) if v.is_integer() else v  # whole numbers of a column with nulls come as floating point
        return v.isoformat() if hasattr(v, "isoformat") else v

    return sorted((tuple(value(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_same_rows(spark, oracle, folder, name):
    got, want = registry.QUERIES[name](spark, folder).toPandas(), oracle.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
