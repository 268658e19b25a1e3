"""Order-free comparison of a Spark result with a DuckDB result."""

from decimal import Decimal

import pandas as pd


def canon(df):
    df = df[sorted(df.columns)].copy()
    for k in df:
        if str(df[k].dtype).startswith(("float", "Float")):
            df[k] = df[k].astype(float).round(6)
        elif df[k].dtype == object:
            df[k] = df[k].map(lambda x: round(float(x), 6) if isinstance(x, Decimal) else x)
    return sorted(tuple("NULL" if pd.isna(v) else str(v) for v in r) for r in df.itertuples(index=False))


def assert_same(spark_df, duck_df):
    a, b = spark_df.toPandas(), duck_df.df()
    assert sorted(a.columns) == sorted(b.columns)
    assert canon(a) == canon(b)
