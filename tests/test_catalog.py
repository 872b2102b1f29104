"""Registered queries against their SQL twins on the smallest tables, one or more of each family."""

import numpy as np
import pytest

from quantide import catalog

from twins import assert_same

CHOSEN = """S01_level1_loader S12_csv_parameters S14_json_sink P05_clip P12_stale_substitution P20_zscore_by_train J01_asof_join J02_full_outer_merge
J04_dense_domain_join J11_nearest_parameters J13_prefix_difference_join A01_last_tick_per_second A03_period_variance A14_brier_by_minute A24_r2_by_horizon A28_percentiles
A30_routing_table W03_rolling_std W05_rolling_max W08_rolling_autocorr W11_ewma W15_fill_forward_backward W17_forward_sum W22_decimated_carry B06_availability
T04_basis_zscore T10_signed_jump T31_wavelet_detail T34_two_scale_variance T36_realized_kernel T39_roll_measure T46_return_shape F19_cyclical_time
F22_days_to_expiry F23_option_expiries F27_session_proximity F13_jsu_probability G02_gap_report M05_ridge M16_pricer_evaluation
F34_grid S03_sink_by_instrument S04_many_instruments S20_input_map S15_parameter_tables O02_sorted_parameters O07_epoch_permutation A10_sampled_periods W21_lookback_windows T06_spread_zscore
T47_spread_variance_correlation T53_horizon_target T44_dft_magnitude J10_model_lookup M09_tree_histogram M12_expert_gating M12_load_balance""".split()


@pytest.mark.parametrize("name", CHOSEN)
def test_twin(spark, sf, name):
    assert_same(catalog.queries()[name](spark, sf), catalog.oracles()[name], sf)


def test_parameters_and_prices(spark, sf):
    """Each row with its own time, the parameters used for it, and the price from them."""
    assert_same(df := catalog.queries()["F17_parameters_at"](spark, sf), catalog.oracles()["F17_parameters_at"], sf)
    rows = df.toPandas()
    plain = catalog.queries()["F13_jsu_probability"](spark, sf).toPandas().set_index("rn")
    assert len(rows) == len(plain) and np.allclose(rows.p, plain.p[rows.rn], equal_nan=True)
    assert (rows.valid == (rows.tte_ms >= 16_000)).all() and set(rows.strategy[~rows.valid]) == {"clamp"} and set(rows.strategy[rows.valid]) == {"direct"}


def test_means_of_all_minutes_and_rows(spark, sf):
    """Every minute of the week, on all rows as well as on those of training."""
    assert_same(df := catalog.queries()["A07_mean_by_minute_of_week"](spark, sf), catalog.oracles()["A07_mean_by_minute_of_week"], sf)
    rows = df.orderBy("mow").toPandas()
    plain = catalog.queries()["J04_dense_domain_join"](spark, sf).orderBy("mow").toPandas()
    assert rows.mow.tolist() == list(range(10_080)) and np.allclose(rows["mean"], plain["mean"], equal_nan=True)
    assert 0 < rows.train_n.sum() < rows.n.sum() and rows.train_mean.notna().sum() == (rows.train_n > 0).sum()


ROWS_ONLY = "F16_jsu_spline M02_fourier_seasonality"


@pytest.mark.parametrize("name", ROWS_ONLY.split())
def test_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
