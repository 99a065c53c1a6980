"""Queries against their SQL twins, and the contract of the entry module."""

import duckdb
import pytest

import __spark_entry__
from profilum.plans.queries import ORACLES, QUERIES
from profilum.schema import RESULT

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["digitize_residues", "flat_result", "cascade", "cut_nc", "role_swap_scan", "regroup_hits", "best_domain", "top_hits", "format_sci", "registry_merge", "inject_thresholds", "fasta_files", "sequence_rows", "profile_files", "result_tsv"])
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), connection.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    sort = lambda f: f[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert sort(got).equals(sort(want))


def test_entry_module(spark):
    assert set(ORACLES) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    frame = __spark_entry__.entry(spark)
    assert set(frame.columns) >= {"sequence_id", "hmm_name", "bitscore", "env_from"} and len(frame.columns) == len(RESULT)
    assert not frame.isEmpty()
