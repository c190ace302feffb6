"""Registered queries against their SQL at the smallest scale. The whole list at sf0.01: tests/check_oracle.py 0.01"""

import duckdb
import pytest
from tests.check_oracle import TABLES, compare

import __spark_entry__ as entry
from tests.conftest import SF

KEYS = (
    "fn_haversine_km fn_rings fn_xmp_coord fn_parse_taken fn_lead join_reverse_geocode join_nearest_leaf join_obs_leaf "
    "agg_fuse_posterior agg_hierarchy_decision agg_candidates agg_attribution agg_radius join_text_words join_kana_han join_knn agg_retrieval_vote "
    "join_same_day join_group_best set_patch_photos join_nearby agg_street_verdict agg_calibration agg_accuracy join_horizon "
    "join_skyline_match src_street_stac st_token_bucket prj_coarsen"
).split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_same_rows_as_sql(spark, con, key):
    state, message, _ = compare(spark, con, key, entry.queries()[key], entry.oracle_sql()[key], SF)
    assert state == "ok", message


def test_every_query_has_a_known_key():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 173
