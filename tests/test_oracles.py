"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

from harrow.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql_agree(agree, name):
    agree(name, registry.queries()[name], SQL[name])


#: Iterative or spectral solves and trees: held against dense solves, numpy, planted effects and file digests in test_blocks.py and test_stages.py.
NO_SQL = {
    "a16_manifest", "f5_principal_components", "f6_truncated_svd", "f16_mahalanobis", "j5_forest_and_boosting", "j8_interaction_ridge", "j9_backfitted_effects", "j14_location_effects", "j15_group_effects",
    "j20_residual_boosting", "j24_kernel_cells", "j26_reaction_norm_variants", "j27_penalty_on_validation", "j28_boosting_with_lags", "k25_external_folds",
}


def test_all_other_queries_have_sql():
    assert set(registry.queries()) - set(SQL) == NO_SQL
