"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from discern.plans.catalog import QUERIES
from discern.plans.oracle import ORACLE
from tests.compare import duck, spark_side, sql_side

# Long fits, on the middle tables: with fewer rows a majority is not always learnt.
SLOW = {
    "cv_deep_mlp", "dense_job_lines", "mlp_folded", "sparse_job_urls", "second_stage_lines", "deep_lines", "tuned_refit", "cv_grid_dt", "cv_grid_lr", "cv_grid_lr_sparse", "cv_grid_rf", "cv_grid_rf_sparse", "cv_grid_svm",
    "deep_mlp", "cv_reference_rf", "deep_rounds", "deep_rounds_log", "deep_validated", "dense_pca_lr", "lr_documents", "lr_multinomial", "mlp_hashed", "mlp_multiclass",
    "rf_multiclass", "rf_sparse", "second_stage_mlp", "svm_linear", "svm_quantity", "dt_selected", "mlp_selected",
}


SLOW_DIR = "/root/testdata/sf0.01"
# Of these, run by default: every kind of grid search and the choice of its winner.
ALWAYS = {"cv_reference_rf", "cv_grid_dt", "cv_grid_lr", "cv_grid_rf", "cv_grid_svm", "tuned_refit", "sparse_job_urls", "dt_selected", "mlp_selected"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return {directory: duck(directory) for directory in (sf_dir, SLOW_DIR)}


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    if name in SLOW - ALWAYS and not os.environ.get("DISCERN_SLOW"):
        pytest.skip("long fit")
    directory = SLOW_DIR if name in SLOW else sf_dir
    columns, rows, types = spark_side(spark, name, directory)
    assert rows and not any("vector" in t for t in types.values())
    if name in ORACLE:
        columns2, rows2, _ = sql_side(con[directory], name)
        assert columns == columns2
        assert rows == rows2
