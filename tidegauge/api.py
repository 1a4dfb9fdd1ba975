"""Series with their operators as methods, for chains: each call returns a new object of the same kind."""

from __future__ import annotations

from dataclasses import replace

from .operators import filling, formatting, lab, reliability, report, smoothing, stats, tagging
from .plans.series import SeriesFrame
from .sources import sinks


def _methods(cls, *functions):
    for f in functions:
        setattr(cls, f.__name__, f)
    return cls


class Series(SeriesFrame):
    """Validation, statistics and export; the base of the other kinds."""

    def set_tag(self, tag: str):
        return replace(self, tag=tag)

    def set_time_unit(self, unit: str):
        return replace(self, time_unit=unit)

    def set_units(self, units: dict):
        return replace(self, units=dict(units))

    def index(self):
        return self.df.select(self.time)

    def to_float(self, *columns: str, lenient: bool = False):
        return self.with_df(formatting.to_float(self.df, *(columns or tuple(self.columns)), lenient=lenient))

    def replace_value(self, old, new):
        return self.with_df(formatting.replace_value(self.df, old, new))


_methods(
    Series, tagging.add_valid, tagging.reset_valid, tagging.tag_nan, tagging.tag_doubles, tagging.tag_extremes, tagging.slopes, tagging.moving_slope_filter, tagging.moving_average_filter, tagging.blank, tagging.get_highs, tagging.percent_left,
    smoothing.moving_average, smoothing.savgol, stats.averages, stats.deviations, stats.calc_ratio, stats.compare_ratio, stats.correlation, stats.prediction_interval, stats.daily_profile,
    formatting.head, formatting.tail, formatting.set_index, formatting.relative_time, formatting.fill_index, formatting.drop_duplicates, formatting.reindex_times, report.analysed, report.wide, sinks.write_series, sinks.write_west, sinks.to_west,
)


class OnlineSeries(Series):
    """Sensors that measure all the time: gap filling and its reliability besides."""


_methods(
    OnlineSeries, stats.daily_average, formatting.total_proportional, filling.add_filled, filling.reset_fillmeta, filling.fill_interpolation, filling.fill_ratio, filling.fill_correlation, filling.fill_standard, filling.fill_model, filling.fill_daybefore, filling.warn_of_rain,
    reliability.create_gaps, reliability.filling_error, reliability.check_filling_error, lab.drop_peaks, lab.select_slope,
)


class LabExperiment(Series):
    """Offline experiments: hours, concentrations, removal."""


_methods(LabExperiment, lab.hours, lab.add_conc, lab.check_ph, lab.warn_of_ph, lab.in_out, lab.removal, lab.calc_slope)


class LabSeries(Series):
    """Sensors in the laboratory: peaks and slopes."""


_methods(LabSeries, lab.drop_peaks, lab.select_slope)
