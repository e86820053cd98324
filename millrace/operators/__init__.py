"""Tables and what can be computed over them."""

from millrace.operators import aggregates, stats, windows
from millrace.operators.table import Grouped, PlanError, Table, asc, desc

__all__ = ["Grouped", "PlanError", "Table", "aggregates", "asc", "desc", "stats", "windows"]
