"""Order-free comparison of two result tables, column names sorted."""

import pandas as pd


def canon(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "∅"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int,)) or type(v).__name__.startswith(("int", "uint")):
        return f"{float(v):.6f}"
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return f"{float(v) + 0.0:.6f}"
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(canon(x) for x in r) for r in df.itertuples(index=False, name=None))
