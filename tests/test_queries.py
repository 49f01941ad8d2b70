"""A query of each kind against its SQL; the others are of the same make."""

import pathlib

import pytest
from compare import compare

SOURCE = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SOURCE.exists(), reason="no test tables")
NAMES = """p3_found p3_rolling p4_found p6_found p7_found agg_median agg_last agg_values agg_argmax agg_avg_days_between agg_max_consecutive_true agg_mode having_max group_by_map nested_aggregate
bool_prec from_type interval_last_month interval_between interval_next_work_day include_obs_date exclude_obs_date rolling_frames variables select_query context_event obs_interval obs_by_entity
obs_event_specific all_scope_link all_scope_time experiment_scope global_events weather_features ingest_json schema entities fn_rem_euclid fn_ln_edge fn_week fn_format_date fn_regex_split fn_substr""".split()


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    compare(spark, SOURCE, name)
