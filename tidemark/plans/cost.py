"""What an access path costs, in rows of full width that pass a task.

A scan reads the needed columns of all rows.  An index reads its entries that match and the
changes since its copy; where it lacks columns, the rows of these entries are fetched by a
semi-join with the table, which costs a row FETCH_ROW times as much as reading it in a scan.
"""

from __future__ import annotations

FETCH_ROW = 19.0


def scan_cost(rows: float, width: float) -> float:
    return rows * width


def index_cost(rows: float, share: float, width: float, changes: float, covering: bool) -> float:
    matching = rows * share
    entries = matching * width + changes
    return entries if covering else entries + FETCH_ROW * matching * width
