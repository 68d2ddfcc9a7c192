"""Every registered query against its SQL in DuckDB, on the smallest tables that give rows; those without SQL must run and give rows with a fixed schema."""

import math
import os

import duckdb
import pytest

from kairoscope.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
MIDDLE = "/root/testdata/sf0.01"
#: Without rows on the smallest tables, which have ten genes: run on the middle ones.
NEED_MORE = {"large_modules", "connected_components", "induced_slice_edges", "factor_coexpression", "factor_sets", "unique_factors", "balanced_factors", "cluster_significance", "over_representation_cutoff", "low_abundance", "majiq_filter", "merge_candidates", "affected_edges", "slice_enrichment", "diffusion_layers", "shortest_paths"}
#: No SQL, and minutes of work on the middle tables: ``test_statistics`` tests them.
MAY_BE_EMPTY = {"active_modules", "network_slices"}


@pytest.fixture(scope="module")
def duck():
    found = {}
    for folder in (DATA, MIDDLE):
        con = found[folder] = duckdb.connect()
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return found


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    folder = MIDDLE if name in NEED_MORE else DATA
    frame = QUERIES[name](spark, folder)
    rows = frame.collect()
    if name not in ORACLE_SQL:
        assert rows or name in MAY_BE_EMPTY
        assert all(not any(isinstance(v, float) and math.isnan(v) for v in r) for r in rows)
        return
    found = duck[folder].execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows
    keys = sorted(names)
    want = sorted(tuple(norm(r[names.index(k)]) for k in keys) for r in found.fetchall())
    assert sorted(tuple(norm(r[k]) for k in keys) for r in rows) == want
