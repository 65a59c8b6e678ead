"""The driver contract: entry(), queries() and oracle_sql() on sf0.001."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_mod

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"time", "pop", "abundance", "n_count"}


def test_every_query_has_an_oracle():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    own = {name for name in q if not re.match(r"op\d+_|pipeline$", name)}
    assert own and own <= set(o) <= set(q)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", ["hourly_stat", "filter_params_at_points", "bead_hex_evt", "gating_cytograms",
                                  "ridgeline", "catalog", "vct_file_hour", "guide_segments"])
def test_query_matches_oracle_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = entry_mod.queries()[name](spark, SF)
    rel = con.execute(entry_mod.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(sdf.columns)
    orows = rel.fetchall()
    srows = sdf.select(*cols).collect()
    assert len(orows) == len(srows)

    def norm(r):
        return tuple("" if v is None else (round(v, 6) if isinstance(v, float) else str(v)) for v in r)
    assert sorted(map(norm, orows)) == sorted(norm(tuple(r)) for r in srows)


def test_library_queries_do_without_the_training_data_subpackage(monkeypatch):
    import sys

    import workload
    monkeypatch.setitem(sys.modules, "cytotide.llm", None)  # importing it fails, as without a package that it needs
    assert set(entry_mod.queries()) == set(workload.load()[0]) and set(entry_mod.oracle_sql()) == set(workload.load()[1])
