"""Every registered query against its DuckDB oracle on the smallest tables (the driver's check, locally)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from citesift.catalog import ORACLES as CATALOG_SQL
from citesift.catalog import QUERIES as CATALOG
from citesift.sources.tables import TABLES, table_path
from tests.conftest import SF_SMALL

QUERIES = CATALOG
ORACLES = CATALOG_SQL


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return str(v) if math.isinf(v) or math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return con


def test_the_entry_point_registers_the_catalogue():
    assert set(CATALOG) <= set(E.queries()) and set(CATALOG_SQL) <= set(E.oracle_sql())


def test_every_query_has_an_oracle_or_is_rows_only():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"skewed_keys", "knn_lsh_recall"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    pdf = QUERIES[name](spark, SF_SMALL).toPandas()
    if name not in ORACLES:
        assert len(pdf) > 0
        return
    want = duck.execute(ORACLES[name]).df()
    assert _rows(pdf) == _rows(want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["claim_id", "id", "score", "fused_rank"]
