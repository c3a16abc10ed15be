import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from epitrail.plans import catalog

REPO = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Quick ones; the driver compares all at a larger scale.
COMPARED = (
    "kmer_scan kmer_flanks cleavage_profile_long score_cterm_mean_internal score_nterm_cterm_max_internal proteasome_predictions top_cleavage_per_source "
    "protein_predictions legacy_view completeness_missing best_by_score best_by_rank best_table null_tolerant_filters validate_peptides multi_sample_union "
    "multi_predictor_union parse_layout_rows parse_header_rows allele_names kmer_counts cleavage_summary peptides_with_flanks described_rows "
    "completeness_unexpected netchop_output iedb_output mixmhcpred_table fasta_records unsupported_alleles one_length_groups output_lines "
    "document_flanks document_nterm_cterm_max_internal quarantined_peptides "
    "first_of_equals nested_json spelled_alleles spelled_alleles_once part_ranges part_versions legacy_netmhcpan41_ba legacy_netmhcpan41_el header_preferred_kinds parse_netmhc3 parse_netmhciipan4_ba parse_netmhciipan43_el_old_columns"
).split()


@pytest.fixture(scope="module")
def data():
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test tables here")
    return folder


def test_names():
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries) and set(catalog.QUERIES) <= set(queries)


def test_entry(spark, data):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["source_sequence_name", "offset", "peptide", "score"] and df.count() > 0


@pytest.mark.parametrize("name", COMPARED)
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = lambda found: sorted(map(str, found))
    assert rows(tuple(r[c] for c in order) for r in got.collect()) == rows(want.select(*(f'"{c}"' for c in order)).fetchall())


def test_stands_without_the_llm_subpackage(tmp_path):
    """Everything else imports when the subpackage and its pipeline are gone."""
    import shutil

    shutil.copytree(REPO / "epitrail", tmp_path / "epitrail", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e, pkgutil, importlib, epitrail; [importlib.import_module(m.name) for m in pkgutil.walk_packages(epitrail.__path__, 'epitrail.')]; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
