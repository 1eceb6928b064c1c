"""Opportunity/attempt statistics over turn-based game logs, as Spark jobs.

Everything here is ``DataFrame -> DataFrame`` or ``Column -> Column``: no action
runs inside the library, so Catalyst sees one plan from scan to report.
"""

__all__ = ["schemas", "functions", "operators", "plans", "sources", "streaming"]
