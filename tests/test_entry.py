"""The registry, with and without the training-data subpackage, and a sample of queries against their SQL."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from loomgraph.plans import catalogue

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and catalogue.FLAGSHIP in catalogue.QUERIES
    assert all(isinstance(q, str) for q in entry.oracle_sql().values())


def test_works_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import sys; sys.modules['loomgraph.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and '_' in n and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=120).returncode == 0


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", ["motif_census", "motif_m33", "graph_stance", "net_boolean_do", "contributions", "reason_w1", "nearest_cells", "similar_labels", "participant_summary", "json_edges_by_id", "json_motifs", "net_do_against_see", "net_given_parents", "dialogue_growth", "overlap_polygons", "transcripts_parsed", "survey_agents", "runs_read", "customers_sampled_by_nation", "agents_drawn"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    a, b = catalogue.QUERIES[name](spark, DATA).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda df: sorted(tuple("" if v is None or v != v else round(float(v), 5) if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))
    assert rows(a) == rows(b)
