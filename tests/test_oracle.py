"""Every registered query against its SQL, on the smallest tables."""

import pytest

from battery import ORACLE, QUERIES
from battery.compare import duck, run

SF_DIR = "/root/testdata/sf0.001"
SLOW = {"v9_parameter_search", "v11_fold_ensemble", "b10_selection_rounds", "v9_search_by_stability"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, name):
    verdict, _, rows = run(spark, con, SF_DIR, name)
    assert rows > 0 or name == "j12_missing_keys"
    assert verdict in ("", "no sql") or verdict.startswith("~"), verdict


def test_every_query_has_sql_but_fitted_ones():
    bare = set(QUERIES) - set(ORACLE)
    assert bare == {
        "e10_bin_encoder", "v7_batch_score", "v7_score_report", "v9_parameter_search",
        "v9_search_by_stability", "v11_fold_ensemble", "b8_importance_selection",
        "b9_mean_threshold_selection", "b10_selection_rounds",
    }
