"""Every query against its SQL twin, at two scales, as the driver compares them."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from loomgraph.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 5)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def same(spark, name, sf):
    base = f"/root/testdata/{sf}"
    made = catalog.QUERIES[name](spark, base)
    columns = sorted(made.columns)
    got = sorted((tuple(plain(v) for v in r) for r in made.select(*columns).collect()), key=repr)
    with duckdb.connect() as db:
        for t in TABLES:
            db.sql(f"create view {t} as select * from '{base}/{t}.parquet'")
        found = db.sql(catalog.ORACLES[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        wanted = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert len(got) == len(wanted)
    assert got == wanted
    return len(got)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    assert same(spark, name, "sf0.01") > 0


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
