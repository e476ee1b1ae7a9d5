"""Operators: functions from DataFrames to a DataFrame."""

from meterloom.functions.arma import Order
from meterloom.operators.combine import MEASUREMENTS, add_peaks
from meterloom.operators.forecast import (
    arma_residuals,
    auto_arima,
    backtest,
    fit_ar,
    fit_orders,
    forecast_arima,
    forecast_models,
    order_grid,
)
from meterloom.operators.profile import (
    adjusted_series,
    normalize_index,
    pack_profile,
    peaks,
    periodic_index,
    with_profile,
)
from meterloom.operators.select import (
    assign_key,
    calendar_expand,
    dedupe,
    filter_day,
    filter_key,
    select_days,
    union_series,
    with_value,
)
from meterloom.operators.series import (
    autocovariance,
    center,
    difference,
    gram,
    hourly_sum,
    integrate,
    rmse,
    series_stats,
)
from meterloom.operators.smooth import centered_ma, moving_average, raw_index
from meterloom.operators.synth import (
    draw,
    gaussian,
    number_profiles,
    peak_amplify,
    synth_activity,
    synth_assign,
    synth_grid,
    synth_ids,
    synth_readings,
    synth_temperature,
    thermal_load,
    uniform,
)
from meterloom.operators.thermal import (
    activity_profile,
    activity_residual,
    fit_thermal_ar,
    lag_features,
)
from meterloom.operators.wordcount import tokens, wordcount

__all__ = [name for name in dir() if not name.startswith("_")]
