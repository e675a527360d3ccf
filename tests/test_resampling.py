"""Resampling queries at the reference's number of replicates."""

import os

import pytest

from panelweave.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
FULL = {"spearman_bootstrap_full": ("n_boot", 3000), "permutation_test_full": ("n_permutations", 5000), "subsample_sign_full": ("n_trials", 3000), "n_curve_full": ("n_trials", 3000), "ols_bootstrap_full": ("n_boot", 1000)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", FULL)
def test_full_counts(spark, name):
    column, n = FULL[name]
    assert {r[column] for r in QUERIES[name](spark, SF).collect()} == {n}
    assert f"range({n})" in SQL[name] and SQL[name].replace(f"range({n})", "range(60)") == SQL[name.removesuffix("_full")]
