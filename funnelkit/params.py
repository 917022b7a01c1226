"""Report parameters.

The reference hard-codes its reporting window (fiscal year start 1 July, a
15-month window, and a one-year-earlier load window for the rep counts).  Here
they are parameters; the defaults place the same window shape inside the test
data's date range (1995-2001).
"""

from __future__ import annotations

from dataclasses import dataclass

from funnelkit.plans.activities import DateWindow


@dataclass(frozen=True)
class ReportParams:
    start: str = "1997-07-01"
    end: str = "1998-10-01"
    history_start: str = "1996-07-01"

    @property
    def window(self) -> DateWindow:
        return DateWindow(self.start, self.end)


DEFAULT = ReportParams()
