import os

import duckdb
import pytest

from parchment.plans import catalogue, checks, runs, scans  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or str(v) in ("<NA>", "NaT", "nan"):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    return round(float(v), 4) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)


def rows(pdf):
    return sorted(repr([plain(v) for v in r]) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, sf, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    if name not in catalogue.ORACLE_SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{os.path.join(sf, t)}.parquet'")
    want = con.sql(catalogue.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
