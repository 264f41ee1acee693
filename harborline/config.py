"""Thresholds, scenarios, holiday rules and minimum volumes, all held as data."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# Ship modes from fastest to slowest, regions in report order.
SHIP_MODES = ["Same Day", "First Class", "Second Class", "Standard Class"]
REGIONS = ["Central", "East", "South", "West"]

# Business days allowed per ship mode.
BASE_DAYS = {"Same Day": 0, "First Class": 1, "Second Class": 2, "Standard Class": 5}
CALIBRATED_DAYS = {"Same Day": 0, "First Class": 2, "Second Class": 3, "Standard Class": 4}

# Scenario order in every report.
SCENARIOS = ["base", "calibrated", "strict", "lenient"]

EXPECTED_ROWS = 9994

# Minimum volumes used in the reports.
MIN_CELL_ORDERS = 30
MIN_SUBCATEGORY_ORDERS = 50
MIN_STATE_ORDERS = 100
MIN_MONTH_ORDERS = 100


@dataclass(frozen=True)
class Thresholds:
    """Two explicit mappings plus shifts of the calibrated one."""

    base: dict[str, int]
    calibrated: dict[str, int]
    step: int = 1
    pinned: tuple[str, ...] = ("Same Day",)

    def rows(self) -> list[tuple[int, str, str, int]]:
        """(rank, scenario, ship mode, days) in report order."""
        shifted = {
            "strict": self._shift(-self.step),
            "lenient": self._shift(self.step),
        }
        mappings = {"base": self.base, "calibrated": self.calibrated, **shifted}
        return [
            (rank, scenario, mode, days)
            for rank, scenario in enumerate(SCENARIOS)
            for mode, days in mappings[scenario].items()
        ]

    def _shift(self, days: int) -> dict[str, int]:
        return {
            mode: limit if mode in self.pinned else limit + days
            for mode, limit in self.calibrated.items()
        }


THRESHOLDS = Thresholds(BASE_DAYS, CALIBRATED_DAYS)

# Federal holidays by date (month, day) ...
FIXED_HOLIDAYS = [(1, 1), (7, 4), (11, 11), (12, 25)]
# ... that came later (first year, month, day) ...
LATER_HOLIDAYS = [(2021, 6, 19)]
# ... and by rule (month, ISO weekday, nth; -1 is the last one).
FLOATING_HOLIDAYS = [(1, 1, 3), (2, 1, 3), (5, 1, -1), (9, 1, 1), (10, 1, 2), (11, 4, 4)]


def federal_holidays(first: dt.date, last: dt.date) -> list[dt.date]:
    """Observed federal holidays between two dates, both included."""
    days = []
    # The year after ``last`` counts: its 1 January may be observed on 31 December.
    for year in range(first.year, last.year + 2):
        later = [(month, day) for since, month, day in LATER_HOLIDAYS if year >= since]
        for month, day in [*FIXED_HOLIDAYS, *later]:
            date = dt.date(year, month, day)
            # Saturday is observed on Friday, Sunday on Monday.
            days.append(date + dt.timedelta(days={6: -1, 7: 1}.get(date.isoweekday(), 0)))
        for month, weekday, nth in FLOATING_HOLIDAYS:
            days.append(_nth_weekday(year, month, weekday, nth))
    return sorted(day for day in days if first <= day <= last)


def _nth_weekday(year: int, month: int, weekday: int, nth: int) -> dt.date:
    if nth < 0:
        end = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)
        return end - dt.timedelta(days=(end.isoweekday() - weekday) % 7)
    start = dt.date(year, month, 1)
    return start + dt.timedelta(days=(weekday - start.isoweekday()) % 7 + 7 * (nth - 1))


# The source covers 2014 to 2017 with shipments up to early January 2018.
HOLIDAYS = federal_holidays(dt.date(2014, 1, 1), dt.date(2018, 1, 1))
