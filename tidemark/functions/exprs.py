"""Columns for bound expressions; the dialect's departures from Spark SQL are all here.

* Sorts: ascending puts NULL last, descending first.
* AND and OR read NULL as FALSE.  At the top of a filter Spark's three-valued result drops
  the same rows, so operands are coalesced only below NOT or a comparison, where it shows;
  coalesced conjuncts would not be pushed into the scan.
* NaN never equals a join key; comparing, sorting or taking MIN/MAX of it is an error.
* SUM and AVG of BIGINT are exact whatever the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.plans.bound import BinaryOp, ColumnRef, Constant, Negation
from tidemark.types import SPARK

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
_NAN = "NaN can't be compared"


def no_nan(column: Column) -> Column:
    """``column`` itself; NaN fails the query."""
    return F.when(F.isnan(column), F.raise_error(F.lit(_NAN)).cast("double")).otherwise(column)


def predicate(expr, top: bool = True) -> Column:
    """The Column of a bound expression; ``top`` where only TRUE counts."""
    if isinstance(expr, ColumnRef):
        return F.col(f"`{expr.slot}`")
    if isinstance(expr, Constant):
        return F.lit(expr.value).cast(SPARK[expr.type]) if expr.type else F.lit(None)
    if isinstance(expr, Negation):
        return ~predicate(expr.operand, False)
    assert isinstance(expr, BinaryOp)
    if expr.op in ("AND", "OR"):
        left, right = predicate(expr.left, top), predicate(expr.right, top)
        if not top:
            left, right = F.coalesce(left, F.lit(False)), F.coalesce(right, F.lit(False))
        return left & right if expr.op == "AND" else left | right
    left, right = predicate(expr.left, False), predicate(expr.right, False)
    for side, operand in (("left", expr.left), ("right", expr.right)):
        if isinstance(operand, ColumnRef) and operand.type == "DOUBLE" and operand.may_be_nan:
            left, right = (no_nan(left), right) if side == "left" else (left, no_nan(right))
    return _COMPARE[expr.op](left, right)


def join_key(expr: BinaryOp) -> Column:
    """An equality between two relations: NaN matches nothing."""
    left, right = predicate(expr.left, False), predicate(expr.right, False)
    out = left == right
    if isinstance(expr.left, ColumnRef) and expr.left.type == "DOUBLE":
        out = out & ~F.isnan(left)
    return out


def exact_sum(column: Column) -> Column:
    """Sum of a BIGINT column as DECIMAL(38, 0), from two sums of halves that can't
    overflow before 2^31 rows of extreme values."""
    high = F.sum(F.shiftright(column, 32)).cast("decimal(38,0)") * F.lit(2**32).cast("decimal(12,0)")
    return (high + F.sum(column.bitwiseAND(F.lit(0xFFFFFFFF))).cast("decimal(38,0)")).cast("decimal(38,0)")


def aggregate(function: str, argument: ColumnRef | None) -> Column:
    """COUNT, SUM, AVG, MIN or MAX."""
    if argument is None:
        return F.count(F.lit(1))
    column = F.col(f"`{argument.slot}`")
    if function == "COUNT":
        return F.count(column)
    if function in ("MIN", "MAX"):
        column = no_nan(column) if argument.type == "DOUBLE" and argument.may_be_nan else column
        return F.min(column) if function == "MIN" else F.max(column)
    if argument.type == "BIGINT":
        total = exact_sum(column)
        return total.cast("bigint") if function == "SUM" else total.cast("double") / F.count(column)
    return F.sum(column) if function == "SUM" else F.avg(column)


def ordering(column: Column, descending: bool) -> Column:
    return column.desc_nulls_first() if descending else column.asc_nulls_last()
