"""Column expressions: range predicates and time conversion."""

from .ranges import in_range, prior_in_range
from .timeconv import DAY, days_from_windows_serial, micros_of_day, per_unit

__all__ = ["DAY", "days_from_windows_serial", "in_range", "micros_of_day", "per_unit", "prior_in_range"]
