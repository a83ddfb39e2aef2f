"""Run settings bound into every plan as literals."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class DateRung:
    """One step of the date ladder: a label, a shape with three groups, and how the groups
    make an ISO text. Reading a date is then a plain cast, far cheaper than a date pattern."""

    label: str
    shape: str
    iso: str
    swapped_label: str | None = None  # the same text read with day and month exchanged
    swapped_iso: str | None = None


# Formats in the order they are tried. The shapes are disjoint.
DATE_LADDER: tuple[DateRung, ...] = (
    DateRung("%Y-%m-%d", r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1-$2-$3"),
    DateRung("%m/%d/%Y", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2", "%d/%m/%Y", "$3-$2-$1"),
    DateRung("%d-%m-%Y", r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$2-$1", "%m-%d-%Y", "$3-$1-$2"),
)


@dataclass(frozen=True)
class RunConfig:
    as_of: dt.date = dt.date(2026, 6, 2)
    window_days: int = 30
    price_tolerance: float = 0.01
    return_rate_alert: float = 0.10
    guest_id: str = "GUEST"
    unknown_label: str = "Unknown"
    key_cap: int = 50
    strict_dates: bool = True
    # Beginnings of ids that the feed reserves for unknown stores and products: orphans, whatever the
    # cleaned tables hold.
    reserved_stores: tuple[str, ...] = ()
    reserved_products: tuple[str, ...] = ()
    ladder: tuple[DateRung, ...] = DATE_LADDER

    @property
    def window_start(self) -> dt.date:
        return self.as_of - dt.timedelta(days=self.window_days - 1)

    def sql_args(self) -> dict[str, object]:
        """Named parameters shared by every metric statement."""
        return {
            "as_of": self.as_of,
            "window_start": self.window_start,
            "first_key": int(self.window_start.strftime("%Y%m%d")),
            "last_key": int(self.as_of.strftime("%Y%m%d")),
            "alert": self.return_rate_alert,
            "guest_id": self.guest_id,
        }


# Reference date of the feed built from the TPC-H style tables (order dates end in 2001).
# It plants unknown ids under two beginnings, which keys of a large table reach too.
FEED_CONFIG = RunConfig(as_of=dt.date(2001, 8, 1), reserved_stores=("S9999",), reserved_products=("P9999999",))
