"""Named queries against their SQL twins.  TALLYGRAIN_ALL=1 runs every one."""

import os

import pytest
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = """flt1_intake_validation flt4_history_filter flt10_transition_guard jn1_history_join jn2_near_duplicates
jn2_hash_neighbours jn5_nearest_district jn6_knn_vote jn10_reflectance_window agg1_agg2_kpi_strip agg13_merkle_roots
agg17_ndvi_drop win1_trail_verification win2_trail_sealing win9_transition_audit mnt1_claim_upsert mnt3_assignment_sync
str2a_identity_card str4_name_match top5_str1_classify rul1_exif_integrity rul7_geography st2_sealing
st3_transition_guard""".split()


def _names():
    from __spark_entry__ import queries

    return list(queries()) if os.environ.get("TALLYGRAIN_ALL") else SAMPLE


@pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")
@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), SF, name) is None


def test_every_sql_twin_has_a_query():
    from __spark_entry__ import queries
    from tallygrain.plans.oracle import ORACLES

    assert set(ORACLES) <= set(queries())
