"""Registered queries against their SQL on the smallest data folder."""

import pytest

import __spark_entry__ as entry_module
from check_oracle import compare, connect
from gridcast import queries

# A spread over all groups; check_oracle.py runs every query.
CHECKED = """
flagship_top_missing_stations a01_overall_missing a05_date_summary a06_station_summary a08_date_coverage
a12_incomplete_stations a14_train_scale a17_numeric_profile a18_median_fallback a19_time_axis a22_masked_mean
a24_mark_stats p02_compose_datetime p07_column_roles p16_fully_missing_dates p20_strip_missing
curation_clean_table curation_filtered_readings j02_weather_station_id j04_duplicate_keys j05_axis_grid j08_time_marks
j09_time_and_weather_marks w06_carried_fill w09_contiguous_windows w11_lookback_split w13_per_series_windows
w16_windows w25_prompt_window w26_point_adjust s05_format_dispatch s07_tsf_scan s09_matrix_scan s19_metric_log
m07_step_correlation m13_masked_mase t03_many_horizons t05_in_context_task t11_supervision_pairs t12_token_losses
t07_linear_forecaster t04_zero_shot_task j11_target_domain_swap o06_shuffled_batches w23_random_cut_windows w14_contiguous_sample_split
multistation_windows curation_end_to_end m15_weighted_average t03_fed_back_horizons
""".split()


def test_registry():
    names, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(names) and set(CHECKED) <= set(sql)
    # Every query of the library itself has SQL; those of the optional subpackage are counted in its own tests.
    assert set(queries.QUERIES) == set(queries.SQL)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, data, name):
    ours = entry_module.queries()[name](spark, data).toPandas()
    theirs = connect(data).execute(entry_module.oracle_sql()[name]).df()
    assert compare(ours, theirs) == "ok"


